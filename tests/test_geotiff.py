"""The GeoTIFF source: layouts, compressions, block ranges, headers."""

import json
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.plans import service
from tidemark.sources import geotiff, images
from tidemark.sources.rasters import Raster


def built(values: np.ndarray, tile: int | None, compression: int, predictor: int = 1, big: bool = False, order: str = "<", rows: int = 7, affine=(10.0, 0.0, 5e5, 0.0, -10.0, 3e6), crs="EPSG:32639", scope=None) -> bytes:
    """A whole file in memory, from the parts that tasks make."""
    h, w = values.shape
    if tile:
        padded = np.pad(values, ((0, -h % tile), (0, -w % tile)), mode="edge")
        blocks = [padded[i : i + tile, j : j + tile] for i in range(0, h, tile) for j in range(0, w, tile)]
    else:
        blocks = [values[i : i + rows] for i in range(0, h, rows)]
    data = [geotiff.block_bytes(b, compression, predictor) for b in blocks]
    head, tail = geotiff.frame(h, w, tile or rows, tile, values.dtype.str[1:], compression, predictor, -9999.0, crs, affine, [len(d) for d in data], "a scene", scope, big)
    return head + b"".join(data) + tail


def whole(data: bytes) -> tuple[geotiff.Header, np.ndarray]:
    read = geotiff.bytes_reader(data)
    h = geotiff.header(read)
    out = np.full((h.height, h.width), np.nan, np.float32)
    for k, (at, n) in enumerate(geotiff.block_ranges(read, h, 0, h.blocks)):
        top, left = h.corner(k)
        block = geotiff.block_values(read(at, n), h, k)
        out[top : top + block.shape[0], left : left + block.shape[1]] = block
    return h, out


VALUES = np.random.default_rng(3).normal(0, 50, (45, 37)).round(1)


@pytest.mark.parametrize("kind", ["f4", "f8", "u1", "i2", "u2", "i4"])
@pytest.mark.parametrize("compression", [geotiff.PLAIN, geotiff.LZW, geotiff.DEFLATE])
@pytest.mark.parametrize("tile", [None, 16])
@pytest.mark.parametrize("big", [False, True])
def test_layouts_give_the_same_pixels(kind, compression, tile, big):
    values = np.abs(VALUES).astype(kind) if kind[0] == "u" else VALUES.astype(kind)
    for predictor in (1, 2, 3) if kind[0] == "f" else (1, 2):
        h, got = whole(built(values, tile, compression, predictor, big))
        assert (got == values.astype(np.float32)).all(), predictor
        assert (h.height, h.width, h.nodata, h.crs, h.affine) == (45, 37, -9999.0, "EPSG:32639", (10.0, 0.0, 5e5, 0.0, -10.0, 3e6))


def test_rotation_scope_and_system_are_kept():
    h, _ = whole(built(VALUES.astype("f4"), None, geotiff.PLAIN, affine=(7.0, 2.0, 1.0, -2.0, -7.0, 9.0), crs="EPSG:4326", scope="fixed_db"))
    assert h.affine == (7.0, 2.0, 1.0, -2.0, -7.0, 9.0) and h.crs == "EPSG:4326" and h.scope == "fixed_db" and h.description == "a scene"


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 40))
def test_lzw_round_trip(data, times):
    assert geotiff.lzw_decoded(geotiff.lzw_encoded(data * times)) == data * times


def test_lzw_known_answer_and_long_tables():
    codes = (256, 45, 258, 258, 65, 259, 66, 257)  # the textbook's example "-----A---B", in codes of 9 bits
    bits = "".join(f"{c:09b}" for c in codes)
    assert geotiff.lzw_decoded(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")) == b"-----A---B"
    noise = np.random.default_rng(0).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    assert geotiff.lzw_decoded(geotiff.lzw_encoded(noise)) == noise  # clears its table some times


def test_packbits_known_answer():
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    assert geotiff.packbits_decoded(packed) == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa")


def test_big_endian_files():
    values = VALUES.astype(">i2")
    tags = [(256, 37), (257, 45), (258, 16), (259, 1), (273, 8), (277, 1), (278, 45), (279, values.nbytes), (339, 2)]
    at = 8 + values.nbytes
    at += at % 2
    extra_at = at + 2 + 12 * (len(tags) + 3) + 4
    scale, tie, keys = struct.pack(">3d", 2.0, 3.0, 0.0), struct.pack(">6d", 0, 0, 0, 10.0, 20.0, 0), struct.pack(">8H", 1, 1, 0, 1, 2048, 0, 1, 4326)
    entries = b"".join(struct.pack(">HHII", t, 4, 1, v) for t, v in tags)
    entries += struct.pack(">HHII", 33550, 12, 3, extra_at) + struct.pack(">HHII", 33922, 12, 6, extra_at + 24) + struct.pack(">HHII", 34735, 3, 8, extra_at + 72)
    data = b"MM" + struct.pack(">HI", 42, at) + values.tobytes().ljust(at - 8, b"\0") + struct.pack(">H", len(tags) + 3) + entries + struct.pack(">I", 0) + scale + tie + keys
    h, got = whole(data)
    assert h.crs == "EPSG:4326" and h.affine == (2.0, 0.0, 10.0, 0.0, -3.0, 20.0) and (got == values.astype(np.float32)).all()


def test_refused():
    good = built(VALUES.astype("f4"), None, geotiff.DEFLATE)
    for bad in (b"", b"II*\0", b"GIF89a" + bytes(20), built(VALUES.astype("f4"), None, 7)):
        with pytest.raises(geotiff.SceneError):
            geotiff.header(geotiff.bytes_reader(bad))
    assert geotiff.header(geotiff.bytes_reader(good)).nodata == -9999.0


def raster(spark, values):
    h, w = values.shape
    cells = spark.createDataFrame([("one", int(r), int(c), float(values[r, c])) for r in range(h) for c in range(w) if not np.isnan(values[r, c])], "scene_id string, row long, col long, value double")
    scenes = spark.createDataFrame([("one", h, w, -1.5, "EPSG:4326", 0.01, 0.0, 50.0, 0.0, -0.01, 27.0), ("none", 20, 33, None, "EPSG:32639", 7.0, 1.0, 0.0, 1.0, -7.0, 0.0)], images.SCENES)
    return Raster(cells, scenes)


@pytest.mark.parametrize(("tile", "compression", "predictor", "big"), [(None, geotiff.DEFLATE, 1, False), (32, geotiff.LZW, 3, False), (16, geotiff.DEFLATE, 2, True)])
def test_written_scenes_come_back_by_blocks(spark, tmp_path, tile, compression, predictor, big):
    values = VALUES.astype(np.float32)
    values[5:9, 3:30] = np.nan
    written = images.write_scenes(raster(spark, values), f"file://{tmp_path}/s", tile, compression, predictor, big).collect()
    assert sorted(r["scene_id"] for r in written) == ["none", "one"]
    back = images.read_scenes(spark, f"{tmp_path}/s/*.tif", task_bytes=512)
    assert back.pixels.filter("scene_id = 'one'").rdd.getNumPartitions() > 3  # one file, many tasks
    got = {(r["row"], r["col"]): r["value"] for r in back.pixels.filter("scene_id = 'one' and not isnan(value)").collect()}
    assert got == {(r, c): float(values[r, c]) for r in range(45) for c in range(37) if not np.isnan(values[r, c])}
    assert back.pixels.count() == 45 * 37 + 20 * 33
    meta = {r["scene_id"]: r for r in back.scenes.collect()}
    assert (meta["one"]["height"], meta["one"]["width"], meta["one"]["nodata"], meta["one"]["crs"], meta["one"]["c"]) == (45, 37, -1.5, "EPSG:4326", 50.0)
    assert [meta["none"][k] for k in "abcdef"] == [7.0, 1.0, 0.0, 1.0, -7.0, 0.0] and meta["none"]["nodata"] is None
    some = images.read_scenes(spark, f"{tmp_path}/s/*.tif", 512, ["one"], (6, 8))
    assert {r["row"] for r in some.pixels.collect()} == {6, 7, 8} and some.pixels.count() == 3 * 37 and some.scenes.count() == 1
    frame = spark.read.format("binaryFile").load(f"{tmp_path}/s/*.tif")
    assert images.read_scenes(spark, frame).pixels.exceptAll(back.pixels).count() == 0


def test_scenes_and_rows_prune_files_and_blocks(tmp_path):
    """Counts bytes: rows leave blocks unread, scenes files, and headers take no pixel."""
    values = np.random.default_rng(1).normal(size=(512, 256)).astype("f4")
    (tmp_path / "a.tif").write_bytes(built(values, 64, geotiff.PLAIN))
    size = (tmp_path / "a.tif").stat().st_size
    files = json.dumps([("a", str(tmp_path / "a.tif"), size), ("b", str(tmp_path / "missing.tif"), 10)])
    taken = []
    plain = images._File.read

    def counted(self, at, n):
        taken.append(n)
        return plain(self, at, n)

    images._File.read = counted
    try:
        for wanted, most in ((("row", 130), 4 * 64 * 64 * 4 + 2000), (None, size + 2000)):
            taken.clear()
            reader = images._Reader({"files": files, "taskBytes": "100000", "scenes": '["a"]', **({"rows": "[130, 130]"} if wanted else {})})
            rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
            assert rows == (64 * 256 if wanted else 512 * 256) and sum(taken) < most + 2000 * len(reader.partitions())
        taken.clear()
        reader = images._Reader({"files": json.dumps([("a", str(tmp_path / "a.tif"), size)]), "read": "headers"})
        ((row,),) = ([*reader.read(p)] for p in reader.partitions())
        assert row[:3] == ("a", 512, 256) and sum(taken) < 1500
    finally:
        images._File.read = plain


def test_scene_list(spark, tmp_path):
    (tmp_path / "gulf_one.tif").write_bytes(built(VALUES.astype("f4"), None, geotiff.PLAIN, affine=(0.01, 0.0, 50.0, 0.0, -0.01, 27.0), crs="EPSG:4326"))
    (tmp_path / "far.tif").write_bytes(built(VALUES.astype("f4"), 16, geotiff.LZW, crs="EPSG:3857"))
    (tmp_path / "left_out.tif").write_bytes(built(VALUES.astype("f4"), 16, geotiff.LZW))
    headers = images.scene_headers(spark, f"{tmp_path}/*.tif")
    names = spark.createDataFrame([("gulf_one",), ("far",), ("no such file",)], "scene_id string")
    titles = spark.createDataFrame([("far", "Far away")], "scene_id string, title string")
    got = {r["scene_id"]: r for r in service.scene_list(headers, titles, names).collect()}
    assert set(got) == {"gulf_one", "far"} and got["gulf_one"]["title"] == "gulf one" and got["far"]["title"] == "Far away"
    assert got["gulf_one"]["region_label"] == "Arabian Gulf" and got["gulf_one"]["inside_validated_bounds"] and abs(got["gulf_one"]["east"] - 50.37) < 1e-9
    assert got["far"]["west"] is None and not got["far"]["inside_validated_bounds"]


def test_written_blocks_add_up(spark, tmp_path):
    """A layer of many blocks is one valid stream; a mask keeps rotation and scope."""
    cells = spark.range(3000).select(F.lit("s").alias("scene_id"), (F.col("id") % 1000).alias("row"), (F.col("id") % 7).alias("col"), F.lit(9).alias("red"), (F.col("id") % 250).cast("int").alias("green"), F.lit(1).alias("blue"))
    scenes = spark.createDataFrame([("s", 1000, 7, "EPSG:32639", 2.0, 0.5, 1.0, 0.5, -2.0, 3.0, "fixed_db")], "scene_id string, height long, width long, crs string, a double, b double, c double, d double, e double, f double, scope string")
    (path,) = (r["path"] for r in images.write_layers(cells, scenes, f"file://{tmp_path}/p").collect())
    png, at, idat = open(path, "rb").read(), 8, b""
    while at < len(png):
        n, kind = struct.unpack_from(">I4s", png, at)
        idat += png[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    assert len(zlib.decompress(idat)) == 1000 * 22  # the checksum of all blocks is right
    (path,) = (r["path"] for r in images.write_masks(cells, scenes, f"file://{tmp_path}/m").collect())
    h, mask = whole(open(path, "rb").read())
    assert h.affine == (2.0, 0.5, 1.0, 0.5, -2.0, 3.0) and h.scope == "fixed_db" and h.blocks == 4
    assert {tuple(map(int, x)) for x in np.argwhere(mask == 1)} == {(i % 1000, i % 7) for i in range(3000)}
