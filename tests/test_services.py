"""Batched scorers, the stored coast, intervals, layers, guards and scratch tables."""

import json
import math
import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests_support import dark_square, tiff
from tidemark.config import DEFAULT, SMALL, operating_guard
from tidemark.operators import coastline, quality, regions, shared
from tidemark.plans import detection, layers, service
from tidemark.sources.images import read_scenes
from tidemark.sources.rasters import Raster
from tidemark.streaming import uploads


@pytest.fixture(scope="module")
def raster(spark):
    files = spark.createDataFrame([("x/one.tif", tiff(dark_square())), ("x/two.tif", tiff(dark_square(30)))], "path string, content binary")
    r = read_scenes(spark, files)
    return Raster(shared.write_shared(r.pixels), shared.write_shared(r.scenes))


CFG = replace(SMALL, screener_threshold=0.05, mask=0.5)


def test_batches_of_tiles_give_what_single_tiles_give(spark, raster):
    def make():
        def score(values, valid):
            assert values.shape == valid.shape and values.shape[1:] == (16, 16) and values.dtype == np.float32
            return (values < 0.3).mean(axis=(1, 2)) + len(values) * 1e-12

        return score

    def segment(values, valid):
        return 1.0 - values

    results = {}
    for batch in (1, 5, 64):
        found = detection.learned(raster, CFG, detection.batch_scorer(make, batch=batch), detection.batch_scorer(lambda: segment, "segmenter", batch))
        results[batch] = {tuple(r) for r in found.mask.collect()}
        scores = [r["p_oil"] for r in found.tiles.filter("eligible").collect()]
        sizes = {round((p * 1e12) % 1e3) for p in scores}  # how many tiles were scored together
        assert max(sizes) <= max(batch, 1) * 1.0 + 300
    plain = detection.learned(raster, CFG)
    assert results[1] == results[5] == results[64] == {tuple(r) for r in plain.mask.collect()} and len(results[1]) > 200


def test_calls_of_a_batched_scorer(spark, raster, tmp_path):
    """One call for up to 64 tiles, and the model is made once a task."""
    log = str(tmp_path / "calls")

    def make():
        with open(log, "a") as f:
            f.write("made\n")

        def score(values, valid):
            with open(log, "a") as f:
                f.write(f"{len(values)}\n")
            return np.full(len(values), 0.5)

        return score

    tiles = detection.partitioned(raster, CFG).filter("eligible")
    cells = detection.model_inputs(raster, tiles, CFG).coalesce(1)
    n = detection.batch_scorer(make)(cells, CFG).coalesce(1).count()
    calls = open(log).read().split()
    sizes = [int(c) for c in calls if c != "made"]
    assert sum(sizes) == n == tiles.count() and len(sizes) <= math.ceil(n / 64) + calls.count("made") and len(sizes) < n


def test_scorers_are_held_to_their_contract(spark, raster):
    wrong = detection.batch_scorer(lambda: lambda values, valid: np.zeros((len(values), 2)))
    with pytest.raises(PySparkException, match="gave the shape"):
        detection.learned(raster, CFG, wrong)
    with pytest.raises(PySparkException, match="left out the tile"):
        detection.learned(raster, CFG, lambda cells, cfg: detection.dark_fraction(cells, cfg).filter("x > 0"))


def test_dark_record_and_layers(spark, raster):
    found = detection.learned(raster, replace(CFG, screener_threshold=0.9))
    dark = shared.write_shared(detection.undetected_dark(raster, found, CFG))
    rows = {(r["scene_id"], r["category"]): r for r in detection.dark_categories(dark, raster.scenes, CFG).collect()}
    assert len(rows) == 4 and rows["one", "total"]["region_count"] >= rows["one", "rejected_by_screener"]["region_count"]
    record = {r["scene_id"]: r["record"] for r in detection.dark_record(detection.dark_categories(dark, raster.scenes, CFG), CFG).collect()}["one"]
    assert record["total_area_km2"] == rows["one", "total"]["area_km2"] and set(record["categories"]) == {"rejected_by_screener"} and record["minimum_blob_px"] == CFG.min_blob and record["opening_radius"] == 1
    grey = {(r["scene_id"], r["row"], r["col"]): r["red"] for r in layers.layer_cells(raster, found, "sar", CFG).collect()}
    assert len(grey) == 48 * 48 + 30 * 30 and grey["one", 0, 0] == 0
    tinted = layers.layer_cells(raster, found, "undetected", CFG, dark, rejected=True).collect()
    gone, marked, oil = ({(c["scene_id"], c["row"], c["col"]) for c in df.collect()} for df in (layers.covered(found.rejected.select("scene_id", "y", "x"), CFG), dark.filter("rejected_by_screener"), found.mask))
    for r in tinted:
        key, v = (r["scene_id"], r["row"], r["col"]), grey[r["scene_id"], r["row"], r["col"]]
        if key in gone and key not in oil:
            v = np.rint(v * (1 - 0.24) + 229 * 0.24)
        if key in marked:
            v = np.rint(v * (1 - 0.62) + 229 * 0.62)
        if key in oil:
            v = np.rint(v * (1 - 0.42) + 214 * 0.42)
        assert r["red"] == int(v)
    for bad in ("nothing", "undetected"):
        with pytest.raises(ValueError):
            layers.layer_cells(raster, found, bad, CFG)


def test_stored_coast_is_read_near_the_box_only(spark, tmp_path):
    rng = np.random.default_rng(2)
    n = 40_000
    x, y = rng.uniform(-180, 180, n), rng.uniform(-90, 90, n)
    rows = np.stack([x, y, np.minimum(x + 0.1, 180), np.minimum(y + 0.1, 90)], 1).tolist()
    coast = spark.createDataFrame([tuple(r) for r in rows], "x1 double, y1 double, x2 double, y2 double")
    path = str(tmp_path / "coast")
    coastline.store_coast(coast, path, row_group_bytes=16 << 10)
    stored = coastline.stored_coast(spark, path)
    near = coastline.in_box(stored, 47.0, 22.0, 57.0, 31.0)
    found = sorted((r["x1"], r["y1"]) for r in near.collect())
    assert found == sorted((a, b) for a, b, c, d in rows if c >= 47 and a <= 57 and d >= 22 and b <= 31) and found
    plan = near._jdf.queryExecution().executedPlan()
    text = near._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(x_max), IsNotNull(x_min)" in text or "GreaterThanOrEqual(x_max,47.0)" in text
    plan.execute().count()
    leaves = plan.collectLeaves()
    assert leaves.apply(0).metrics().apply("numOutputRows").value() < n / 8  # row groups elsewhere were passed over
    scenes = spark.createDataFrame([("a", 100, 100, None, "EPSG:4326", 0.01, 0.0, 50.0, 0.0, -0.01, 27.0), ("b", 100, 100, None, "EPSG:32639", 10.0, 0.0, 5e5, 0.0, -10.0, 3e6)], "scene_id string, height long, width long, nodata double, crs string, a double, b double, c double, d double, e double, f double")
    key = lambda df: sorted(tuple(round(v, 3) for v in (r["x1"], r["y1"], r["x2"], r["y2"])) + (r["scene_id"],) for r in df.collect())
    assert key(regions.scene_coast(scenes, stored)) == key(regions.scene_coast(scenes, coast)) and regions.scene_coast(scenes, stored).count() > 0
    many = spark.range(400).select((F.col("id") - 200.0).alias("west"), F.lit(-80.0).alias("south"), (F.col("id") - 199.5).alias("east"), F.lit(80.0).alias("north"))
    assert coastline.near_boxes(stored, many).count() > 0.8 * n and coastline.near_boxes(stored, many.limit(0)).count() == 0


def test_curve_keeps_neighbours_together(spark):
    got = {(r["x"], r["y"]): r["p"] for r in spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y")).withColumn("p", coastline.curve_place(F.col("x"), F.col("y"), (0, 0, 1 << 16, 1 << 16))).collect()}
    assert all(p == sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(3)) for (x, y), p in got.items())


def test_intervals_and_ranks_equal_plain_versions(spark):
    rng = np.random.default_rng(4)
    units = [(i, int(a), int(b), int(c)) for i, (a, b, c) in enumerate(rng.integers(0, 30, (60, 3)))]
    df = spark.createDataFrame(units, "unit long, tp long, fp long, fn long")
    got = {r["measure"]: r for r in quality.quality_intervals(df, "unit", 80, seed=7).collect()}

    def weight(unit, rep):
        h = (unit % 2147483647 * 48271 + rep * 69621 + 7) % 2147483647
        for add in (12_345, 678_901):
            h = (h * h + add + rep) % 2147483647
        return next((k for k in range(8) if h / 2147483647 < round(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)), 7)), 8)

    every = np.array(units)[:, 1:]
    weights = np.array([[weight(u[0], r) for u in units] for r in range(1, 81)])
    assert abs(weights.mean() - 1) < 0.05 and abs(weights.var() - 1) < 0.1
    tp, fp, fn = (weights @ every).T
    for name, values, (a, b) in (("iou", tp / (tp + fp + fn), (0, 3)), ("precision", tp / (tp + fp), (0, 2))):
        assert [got[name]["low"], got[name]["high"]] == pytest.approx(np.quantile(values, [0.025, 0.975]), abs=1e-6)
        assert got[name]["value"] == pytest.approx(every[:, 0].sum() / every[:, a:b].sum(), abs=1e-6)
    none = {r["measure"]: r for r in quality.quality_intervals(df.limit(0), "unit").collect()}
    assert none["iou"]["value"] is None and none["iou"]["low"] is None
    x, y = rng.integers(0, 6, 200), rng.integers(0, 5, 200)
    pairs = spark.createDataFrame([*[(float(a), float(b + a)) for a, b in zip(x, y, strict=True)], (None, 1.0), (2.0, None)], "x double, y double")
    ranks = [np.array([np.mean(np.flatnonzero(np.sort(v) == a)) for a in v]) for v in (x.astype(float), (x + y).astype(float))]
    r = quality.rank_correlation(pairs, "x", "y").first()
    assert r["n"] == 200 and r["rank_correlation"] == pytest.approx(np.corrcoef(*ranks)[0, 1], abs=1e-6)
    assert quality.rank_correlation(pairs.filter("x = 1").withColumn("x", F.lit(1.0)), "x", "y").first()["rank_correlation"] is None


def test_reference_systems_without_known_areas_are_refused(spark):
    def area(crs, **parameters):
        scenes = spark.createDataFrame([("s", 2, 2, None, crs, 10.0, 0.0, 0.0, 0.0, -10.0, 30.0)], "scene_id string, height long, width long, nodata double, crs string, a double, b double, c double, d double, e double, f double")
        return regions.row_areas(scenes, replace(SMALL, **parameters)).first()["area_m2"]

    assert area("EPSG:32639") == area("LOCAL_METRIC") == area("EPSG:3035", metric_systems=("EPSG:3035",)) == 100.0
    for crs in ("EPSG:4269", "EPSG:2263", "", None, "some name"):
        with pytest.raises(PySparkException, match="no areas"):
            area(crs)


def test_guard_and_identity(tmp_path):
    operating_guard(DEFAULT)
    with pytest.raises(ValueError, match="mask.*min_blob"):
        operating_guard(replace(DEFAULT, mask=0.2, min_blob=3, coast_buffer_deg=1.0))
    with pytest.raises(FileNotFoundError, match="weights"):
        operating_guard(DEFAULT, (str(tmp_path / "none"),))
    f = tmp_path / "weights"
    f.write_text("a")
    files = (str(f), str(tmp_path / "none"))
    before = service.config_hash(SMALL, files)
    assert before == service.config_hash(SMALL, files) != service.config_hash(SMALL)
    f.write_text("ab")
    assert service.config_hash(SMALL, files) != before


def test_scratch_tables_go_with_their_block(spark):
    with shared.scratch():
        inner = shared.write_shared(spark.range(3))
        with shared.scratch():
            deepest = shared.write_shared(spark.range(2))._scratch.removeprefix("file://")
            assert os.path.isdir(deepest)
        assert not os.path.isdir(deepest) and inner.count() == 3
    assert not os.path.isdir(inner._scratch.removeprefix("file://"))


def test_uploads_know_the_coast_and_leave_no_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "first.tif").write_bytes(tiff(dark_square()))
    folder = shared.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    coast = spark.createDataFrame([(51.0, 27.0, 51.2, 27.2)], "x1 double, y1 double, x2 double, y2 double")
    uploads.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), CFG, coast_degrees=coast).awaitTermination(240)
    (r,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert 0 < r["distance_to_coast_km"] < 40 and json.loads(json.dumps(r["severity"])) in ("Critical", "High", "Moderate", "Low")
    assert {f for f in set(os.listdir(folder)) - before if f.startswith("tidemark-")} == set()
