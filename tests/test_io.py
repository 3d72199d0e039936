"""Files in and out: GeoTIFF scenes, masks, PNG layers, the upload stream."""

import struct
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import SMALL
from tidemark.plans import service
from tidemark.sources import images
from tidemark.streaming import uploads


def tiff(values: np.ndarray, crs: int | None = 32639, bands: int = 1, nodata: str | None = "-9999", deflate: bool = True) -> bytes:
    """A small float file with strips of four rows."""
    h, w = values.shape
    strips = [values[i : i + 4].astype("<f4").tobytes() for i in range(0, h, 4)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    at, starts = 8, []
    for s in strips:
        starts.append(at)
        at += len(s)
    tags = [(256, "I", (w,)), (257, "I", (h,)), (258, "H", (32,)), (259, "H", (8 if deflate else 1,)), (273, "I", tuple(starts)), (277, "H", (bands,)), (278, "I", (4,)), (279, "I", tuple(map(len, strips))), (339, "H", (3,)), (33550, "d", (10.0, 10.0, 0.0)), (33922, "d", (0.0, 0.0, 0.0, 5e5, 3e6, 0.0))]
    if crs:
        tags.append((34735, "H", (1, 1, 0, 1, 3072, 0, 1, crs)))
    if nodata:
        tags.append((42113, "s", (nodata.encode() + b"\0",)))
    kinds = {"H": 3, "I": 4, "d": 12, "s": 2}
    entries, extra, beyond = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, k, v in tags:
        packed = v[0] if k == "s" else struct.pack(f"<{len(v)}{k}", *v)
        n = len(packed) if k == "s" else len(v)
        if len(packed) > 4:
            packed, extra = struct.pack("<I", beyond + len(extra)), extra + packed
        entries += struct.pack("<HHI", tag, kinds[k], n) + packed.ljust(4, b"\0")
    return b"II" + struct.pack("<HI", 42, at) + b"".join(strips) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


def dark_square(size=48):
    rng = np.random.default_rng(0)
    v = rng.uniform(80, 120, (size, size)).astype(np.float32)
    v[10:26, 12:30] = 1.0
    v[0, 0] = -9999
    return v


def test_read(spark):
    v = dark_square()
    files = spark.createDataFrame([("x/a_scene.tif", tiff(v)), ("x/b.tif", tiff(v[:, :20], deflate=False))], "path string, content binary")
    r = images.read_scenes(spark, files)
    meta = {s["scene_id"]: s for s in r.scenes.collect()}
    assert (meta["a_scene"]["height"], meta["b"]["width"], meta["b"]["nodata"], meta["b"]["crs"], meta["b"]["e"], meta["b"]["f"]) == (48, 20, -9999.0, "EPSG:32639", -10.0, 3e6)
    got = {(p["row"], p["col"]): p["value"] for p in r.pixels.filter("scene_id = 'a_scene'").collect()}
    assert got == {(i, j): float(v[i, j]) for i in range(48) for j in range(48)}


def test_refused():
    v = dark_square(8)
    for bad in (b"GIF89a..", tiff(v, crs=None), tiff(v, bands=3)):
        with pytest.raises(images.SceneError):
            images.read_header(bad)


def test_mask_and_layer_files(spark, tmp_path):
    cells = [("s", r, c) for r in range(300) for c in range(7) if (r * c) % 5 == 1]
    mask = spark.createDataFrame(cells, "scene_id string, row long, col long")
    scenes = spark.createDataFrame([("s", 300, 7, "EPSG:4326", 0.1, 50.0, -0.1, 27.0), ("none", 3, 2, "EPSG:4326", 0.1, 50.0, -0.1, 27.0)], "scene_id string, height long, width long, crs string, a double, c double, e double, f double")
    paths = {r["scene_id"]: r["path"] for r in images.write_masks(mask, scenes, f"file://{tmp_path}/m").collect()}
    with open(paths["s"], "rb") as f:
        data = f.read()
    header = images.read_header(data)
    back = np.concatenate([v for _, v in images.read_strips(data, header)])
    assert (header["crs"], header["c"], header["f"]) == ("EPSG:4326", 50.0, 27.0) and {("s", *map(int, x)) for x in np.argwhere(back == 1)} == set(cells)
    with open(paths["none"], "rb") as f:
        data = f.read()
    assert not np.concatenate([v for _, v in images.read_strips(data, images.read_header(data))]).any()
    layer = mask.withColumns({"red": F.lit(200), "green": F.col("col").cast("int"), "blue": F.lit(3)})
    (path,) = (r["path"] for r in images.write_layers(layer, scenes.filter("scene_id = 's'"), f"file://{tmp_path}/p").collect())
    with open(path, "rb") as f:
        png = f.read()
    at, idat = 8, b""
    while at < len(png):
        n, kind = struct.unpack_from(">I4s", png, at)
        assert zlib.crc32(png[at + 4 : at + 8 + n]) == struct.unpack_from(">I", png, at + 8 + n)[0]
        idat += png[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(300, 22)[:, 1:].reshape(300, 7, 3)
    assert {("s", *map(int, x)) for x in np.argwhere(rows[:, :, 0] == 200)} == set(cells) and rows[1, 1].tolist() == [200, 1, 3]


def test_upload_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "first.tif").write_bytes(tiff(dark_square()))
    cfg = replace(SMALL, screener_threshold=0.05, mask=0.5)
    for _ in range(2):  # nothing new the second time
        uploads.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), cfg).awaitTermination(120)
    regions = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(regions) == 1 and regions[0]["content_id"].startswith("upload-") and 250 < regions[0]["n_pixels"] <= 288


def test_export_and_responses(spark, tmp_path):
    regions = spark.createDataFrame([("s", 1, 0.5, "Low"), ("s", 2, 2.0, "Moderate")], "scene_id string, region_id long, area_km2 double, severity string")
    service.export_regions(regions, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True).collect()
    assert [r["region_id"] for r in back] == ["2", "1"]
    summary = spark.createDataFrame([("s", 2.5), ("t", 0.0)], "scene_id string, total_area_km2 double")
    got = {r["scene_id"]: r["response"] for r in service.responses(summary, regions, SMALL).collect()}
    assert got["s"].index('"region_id":2') < got["s"].index('"region_id":1') and '"total_area_km2":0.0' in got["t"]
    assert service.config_hash(SMALL) != service.config_hash(replace(SMALL, seed=1))
