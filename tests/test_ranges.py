"""Medians, positions and coast distances without a group in one task, scorer contracts, and the plans of the raster queries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import SMALL
from tidemark.operators import ranks, regions, shared, stats
from tidemark.plans import catalog, detection
from tidemark.sources.rasters import from_cells


def raster(spark, grids):
    cells = [(name, r, c, float(v)) for name, grid in grids.items() for r, row in enumerate(grid) for c, v in enumerate(row)]
    return from_cells(spark.createDataFrame(cells, "scene_id string, row long, col long, value double"))


def test_medians_are_exact(spark):
    rng = np.random.default_rng(1)
    grids = {"odd": rng.normal(size=(31, 33)), "even": rng.integers(0, 9, (20, 20)).astype(float), "one": np.array([[4.5]]), "two": np.array([[1.0, 2.0]]), "equal": np.full((25, 40), 7.0)}
    got = {r["scene_id"]: r["median"] for r in stats.scene_median(raster(spark, grids)).collect()}
    assert got == {k: pytest.approx(np.median(g.astype(np.float32).astype(float)), abs=1e-6) for k, g in grids.items()}


def test_positions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(20), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v long, i long").withColumn("_n", F.lit(1))
    got = {r["i"]: r["position"] for r in ranks.global_positions(df, ["g"], ["v", "i"]).collect()}
    for g in ("a", "b", None):
        assert [got[i] for _, i in sorted((v, i) for h, v, i in rows if h == g)] == list(range(1, sum(h == g for h, _, _ in rows) + 1))
    assert ranks.global_positions(df.limit(0), ["g"], ["v"]).count() == 0


def distance(p, s):
    a, b, p = np.array(s[:2]), np.array(s[2:]), np.array(p)
    d = b - a
    t = np.clip(((p - a) @ d) / (d @ d), 0, 1) if d @ d else 0
    return float(np.hypot(*(p - (a + t * d))))


@pytest.mark.parametrize("extent", [1.0, 300.0, 50_000.0])
def test_coast_distances_against_all_segments(spark, extent):
    rng = random.Random(3)
    coast = [(x, y, x + rng.uniform(-extent, extent), y + rng.uniform(-extent, extent)) for _ in range(150) for x, y in [(rng.uniform(-1e4, 9e4), rng.uniform(0, 6e4))]] + [(5.0, 5.0, 5.0, 5.0)]
    places = [(i, rng.uniform(-3e5, 4e5), rng.uniform(-2e5, 3e5)) for i in range(60)] + [(100 + i, *coast[i][:2]) for i in range(5)] + [(200, 5e6, -7e6)]
    df = spark.createDataFrame([("s", *p) for p in places], "scene_id string, region_id long, centroid_x double, centroid_y double")
    got = {r["region_id"]: r["distance_to_coast_km"] for r in regions.coast_distances(df, spark.createDataFrame(coast, "x1 double, y1 double, x2 double, y2 double")).collect()}
    assert len(got) == len(places)
    for i, x, y in places:
        assert got[i] == pytest.approx(min(distance((x, y), s) for s in coast) / 1000, abs=2e-6)
    one = spark.createDataFrame([(3.0, 4.0, 3.0, 4.0)], "x1 double, y1 double, x2 double, y2 double")
    assert regions.coast_distances(df, one).filter("distance_to_coast_km is null").count() == 0
    assert regions.coast_distances(df, one.limit(0)).filter("distance_to_coast_km is null").count() == len(places)


def test_tile_scope_scales_by_tile_and_repeats_edges(spark):
    rng = np.random.default_rng(4)
    grid = rng.normal(size=(20, 9))
    r = raster(spark, {"s": grid})
    cfg = type(SMALL)(tile=16, stride=14, norm_scope="tile")
    tiles = detection.components.write_shared(detection.partitioned(r, cfg))
    cells = detection.model_inputs(r, tiles, cfg).collect()
    wide = np.pad(grid, ((0, 0), (0, 7)), mode="edge")
    assert len(cells) == 2 * 256
    for y in (0, 4):
        tile = wide[y : y + 16]
        lo, hi = np.percentile(tile, [2, 98])
        want = np.clip((tile - lo) / (hi - lo), 0, 1)
        assert all(abs(c["norm"] - want[c["row"] - y, c["col"]]) < 1e-5 for c in cells if c["y"] == y)
    mask = detection.deterministic(r, cfg).mosaic
    assert mask.agg(F.max("col"), F.count("*")).first() == (8, 180)


def test_scorers_are_held_to_their_contract(spark):
    r = raster(spark, {"s": np.random.default_rng(5).normal(size=(30, 30))})
    seen = detection.tile_scorer(lambda values, valid: float(values[valid].mean()))
    plain = detection.screened(r, SMALL, seen).filter("eligible").select("p_oil").collect()
    assert len(plain) == 4 and all(0 <= p["p_oil"] <= 1 for p in plain)
    found = detection.learned(r, SMALL, detection.pass_all, detection.tile_scorer(lambda values, valid: 1 - values, "segmenter"))
    assert found.mosaic.count() == 900
    for bad in (lambda c, cfg: c.select("scene_id", "y", "x").distinct(), lambda c, cfg: c.select("scene_id", "y", "x").distinct().withColumn("p_oil", F.lit(1.5)), lambda c, cfg: c.select("scene_id", "y", "x").distinct().withColumn("p_oil", F.lit(None).cast("double")), lambda c, cfg: c.select("scene_id", "y", "x").withColumn("p_oil", F.lit(0.5))):
        with pytest.raises(Exception):  # noqa: B017 - Spark's own or ValueError
            detection.screened(r, SMALL, bad).count()
    with pytest.raises(Exception):  # noqa: B017
        detection.learned(r, SMALL, detection.pass_all, detection.tile_scorer(lambda values, valid: values[:3], "segmenter")).mask.count()


def test_broken_accounts_are_seen(spark):
    cells = lambda *at: spark.createDataFrame([("s", i, i) for i in at], "scene_id string, row long, col long")
    ask = lambda *x: tuple(detection.broken_accounts(*(cells(*y) for y in x)).first())
    assert ask((1, 2, 3), (1,), (2, 3)) == (0, 0, 0, 0)
    assert ask((1, 2, 3), (1, 2), (2, 3, 4)) == (1, 0, 1, 0)
    assert ask((1, 2, 3), (1,), (2, 2)) == (0, 1, 0, 1)


@pytest.mark.parametrize("name", ["normalize_scene", "connected_components", "mask_set_ops", "coast_distance", "infill_median", "scene_median", "display_uint8"])
def test_plans_have_no_cartesian_product(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("orders.parquet") <= 4


def test_scratch_is_shared_and_goes_when_superseded(spark):
    folder = shared.shared_dir(spark)
    assert folder == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")
    df = shared.write_shared(spark.range(3), "x")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(path) and df.count() == 3
    shared.discard(df)
    assert not files.exists(path)
    shared.discard(spark.range(1))
