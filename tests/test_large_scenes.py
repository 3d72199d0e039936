"""Scenes, coasts and files that are larger than what one task holds at small sizes."""

import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.functions import planes
from tidemark.functions.geodesy import utm_forward, with_local_plane
from tidemark.llm import support
from tidemark.operators import regions, stats
from tidemark.operators.regions import scene_coast, scene_coast_totals
from tidemark.sources import geotiff, images
from tidemark.sources.rasters import Raster, from_cells


@pytest.mark.parametrize(("height", "width"), [(3, 7), (130, 128)])
def test_percentiles_of_large_scenes_are_those_of_all_pixels(spark, height, width):
    i = F.col("id")
    cells = spark.range(height * width).select(F.lit("s").alias("scene_id"), F.floor(i / width).alias("row"), (i % width).alias("col"), (F.pmod(F.hash("id"), F.lit(7919)) / 8).alias("value"))
    r = from_cells(cells.union(cells.withColumns({"scene_id": F.lit("t"), "value": F.lit(2.5)})))
    values = np.array([x["value"] for x in cells.collect()])
    want = {"s": [round(float(np.percentile(values, q)), 6) for q in (2, 98)], "t": [2.5, 2.5]}
    for most in (10, DEFAULT.max_samples):
        assert {x["scene_id"]: [x["lo"], x["hi"]] for x in stats.scene_percentiles(r, replace(DEFAULT, max_samples=most)).collect()} == want


def test_coast_totals_count_copies_and_broadcast_no_pairs(spark):
    grid = ["'EPSG:4326' AS crs", "0.01D AS a", "0.0D AS b", "0.0D AS d", "-0.01D AS e", "100L AS height", "100L AS width"]
    scenes = spark.range(40).selectExpr("cast(id as string) AS scene_id", *grid, "40.0D + id % 10 AS c", "10.0D + id % 4 AS f")
    line = spark.range(30).selectExpr("44.0D + id % 5 / 10 AS x1", "9.0D + id % 3 AS y1", "44.1D + id % 5 / 10 AS x2", "12.5D - id % 2 AS y2")
    cut = scene_coast(scenes, line)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in plan.split("\n") if "BroadcastHashJoin [gx" in p or "BroadcastNestedLoop" in p]
    want = cut.groupBy("scene_id").agg(F.max("search_deg").alias("d"), F.count(F.lit(1)).alias("n"), (F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))) / 1000).alias("l"))
    have = {r["scene_id"]: r for r in scene_coast_totals(scenes, line).collect()}
    rows = want.collect()
    assert len(rows) == len(have) and {r["d"] for r in rows} == {2.0, 5.0}
    assert all(have[r["scene_id"]]["n_segments"] == r["n"] and have[r["scene_id"]]["search_deg"] == r["d"] and abs(have[r["scene_id"]]["length_km"] - r["l"]) < 1e-3 for r in rows)


def test_far_points_are_measured_against_few_segments(spark, monkeypatch):
    """Points ten lengths off the coast: exact, each segment in one cell, and also where tables are cut to what is asked for."""
    coast = spark.range(2000).selectExpr("id * 10.0D AS x1", "pmod(hash(id), 1000) * 1.0D AS y1", "id * 10.0D + 10 AS x2", "pmod(hash(id + 1), 1000) * 1.0D AS y2")
    points = spark.range(60).selectExpr("'s' AS scene_id", "id AS region_id", "id * 20.0D AS centroid_x", "-200000.0D - id AS centroid_y")
    grid, _ = regions._coast_grid(coast)
    assert grid.count() == 2000
    seg = np.array([[r[k] for k in ("x1", "y1", "x2", "y2")] for r in coast.collect()])
    a, d = seg[:, :2], seg[:, 2:] - seg[:, :2]

    def nearest(p):
        t = np.clip(((p - a) * d).sum(1) / (d * d).sum(1), 0, 1)[:, None]
        return np.sqrt(((p - a - t * d) ** 2).sum(1)).min() / 1000

    want = {r["region_id"]: nearest(np.array([r["centroid_x"], r["centroid_y"]])) for r in points.collect()}
    monkeypatch.setattr(regions, "MOST_CELLS", 10)
    have = {r["region_id"]: r["distance_to_coast_km"] for r in regions.coast_distances(points, coast).collect()}
    assert set(have) == set(want) and all(abs(have[k] - want[k]) < 2e-6 for k in want)


def test_small_shares_are_bounded_and_small_blocks_are_read_together(spark, tmp_path):
    """Tasks of a read don't grow without end where shares are small; a batch holds many small blocks."""
    files = json.dumps([["a", "a.tif", 400_000_000], ["b", "b.tif", 5_000_000]])
    assert len(images._Reader({"files": files, "taskBytes": "4096"}).partitions()) <= images.MOST_SHARES + 2
    assert len(images._Reader({"files": files, "taskBytes": str(8 << 20)}).partitions()) == 48 + 1
    cells = spark.range(300 * 40).selectExpr("'a' AS scene_id", "id div 40 AS row", "id % 40 AS col", "IF(id % 7 = 0, NULL, id / 8) AS value")
    scenes = spark.sql("SELECT 'a' AS scene_id, 300L AS height, 40L AS width, CAST(NULL AS DOUBLE) AS nodata, 'EPSG:4326' AS crs, 0.01D AS a, 0.0D AS b, 6.0D AS c, 0.0D AS d, -0.01D AS e, 22.0D AS f")
    images.write_scenes(Raster(cells, scenes), f"file://{tmp_path}", tile=16, compression=geotiff.LZW, predictor=3).count()
    path = f"{tmp_path}/a.tif"
    read = images._File(path).read
    batches = list(images._cells("a", (h := geotiff.header(read)), read, 0, h.blocks, (0, 1 << 62)))
    assert h.blocks == 57 and len(batches) == 1
    have = {(r, c): v for r, c, v in zip(*(batches[0].column(k).to_pylist() for k in (1, 2, 3)), strict=True)}
    assert len(have) == 12_000 and all((v != v) if (i := r * 40 + c) % 7 == 0 else v == i / 8 for (r, c), v in have.items())


def test_first_words_are_encoded_once():
    encoder = support.byte_level_encoder(support.tokenizer_file("byte_bpe_50k.json"))
    asked, whole = [], encoder._whole
    encoder._whole = lambda text: asked.append(text) or whole(text)
    texts = ["The end", "The", "Then the end", "The  end", "", "The end"] * 3
    have = [x.tolist() for x in encoder.encode(texts)]
    assert have == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(set(asked)) == ["The", "The  end", "Then"] and asked.count("The") == 1


def test_planes_of_arrays_are_those_of_columns(spark):
    rows = spark.range(2000).selectExpr("pmod(hash(id), 3600) / 10D - 180 AS lon0", "pmod(hash(id, 1), 1600) / 10D - 80 AS lat0", "pmod(hash(id, 2), 1400) / 100D - 7 AS dx", "pmod(hash(id, 3), 1400) / 100D - 7 AS dy")
    rows = rows.selectExpr("lon0", "lat0", "IF(dx > 6, lon0, lon0 + dx) AS lon", "IF(dx > 6, lat0, lat0 + dy) AS lat", "1 + cast(floor((lon0 + 180) / 6) AS int) AS zone", "lat0 < 0 AS below")
    local = with_local_plane(rows, "lon", "lat", "lon0", "lat0", "x", "y")
    p = local.withColumns(dict(zip(("ux", "uy"), utm_forward(F.col("lon"), F.col("lat"), F.col("zone"), F.col("below")), strict=True))).toPandas()
    v = {k: p[k].to_numpy() for k in p}
    x, y = planes.local_plane(v["lon"], v["lat"], v["lon0"], v["lat0"], np.arange(len(p)))
    ux, uy = planes.utm_plane(v["lon"], v["lat"], v["zone"], v["below"])
    assert np.abs(x - v["x"]).max() < 1e-6 and np.abs(y - v["y"]).max() < 1e-6 and np.abs(ux - v["ux"]).max() < 1e-6 and np.abs(uy - v["uy"]).max() < 1e-6
    assert ((v["lon"] == v["lon0"]) & (x == 0) & (y == 0)).any()


def test_pairs_of_coast_totals_are_no_rows(spark, monkeypatch):
    """Scenes and segments that all differ: pairs are gone through block by block, and the blocks are dealt out over all tasks."""
    grid = ["100L AS height", "100L AS width", "0.0D AS b", "0.0D AS d"]
    plain = spark.range(300).selectExpr("cast(id as string) AS scene_id", *grid, "'EPSG:4326' AS crs", "0.01D AS a", "-0.01D AS e", "30.0D + id % 30 AS c", "10.0D + pmod(hash(id), 22000) / 1000 AS f")
    utm = spark.range(60).selectExpr("concat('u', id) AS scene_id", *grid, "IF(id % 2 = 0, 'EPSG:32639', 'EPSG:32738') AS crs", "1000D AS a", "-1000D AS e", "200000D + id * 7001 AS c", "IF(id % 2 = 0, 2500000D + id * 10007, 9990000D) AS f")
    scenes = plain.unionByName(utm).unionByName(utm.limit(3).withColumns({"scene_id": F.concat(F.lit("x"), "scene_id"), "crs": F.lit("LOCAL")}))
    some = spark.range(700).selectExpr("48D + id % 50 / 10 AS x1", "24D + pmod(hash(id), 11000) / 2000 AS y1", "48D + (id + 1) % 50 / 10 AS x2", "24D + pmod(hash(id + 1), 11000) / 2000 AS y2")
    flat = spark.sql("SELECT 44D AS x1, -3D AS y1, 46D AS x2, -3D AS y2 UNION ALL SELECT 45D, -9D, 45D, 2D UNION ALL SELECT 170D, 1D, NULL, 1D")
    coast = some.union(some.limit(5)).union(flat)
    cut = scene_coast(scenes, coast)
    want = {r[0]: r for r in cut.groupBy("scene_id").agg(F.max("search_deg"), F.count(F.lit(1)), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))) / 1000).collect()}
    dealt, kind = [], type(scenes)
    run = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, *a: dealt.append([r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]) or run(df, *a))
    monkeypatch.setattr(regions, "_cut_coast", None)
    monkeypatch.setattr(regions, "BLOCK", 50)
    have = {r["scene_id"]: r for r in scene_coast_totals(scenes, coast).collect()}
    assert set(have) == set(want) and {r[1] for r in want.values()} == {2.0, 5.0} and any(k.startswith("u") for k in want) and len(want) < 360
    assert all(have[k]["search_deg"] == r[1] and have[k]["n_segments"] == r[2] and abs(have[k]["length_km"] - r[3]) < 1e-3 for k, r in want.items())
    assert len(dealt) == 2 and all(len(d) == 4 and max(d) - min(d) <= 4 for d in dealt)
    assert scene_coast_totals(scenes, coast.limit(0)).count() == 0 == scene_coast_totals(scenes.limit(0), coast).count()


def test_shapes_of_regions_far_down_a_scene_are_those_at_its_top(spark):
    """Bars with clipped corners lie across the rows exactly, however large the numbers of their rows are and in whatever order they come."""
    bars = spark.range(1, 61).withColumnRenamed("id", "region_id").crossJoin(spark.range(27).selectExpr("id div 9 AS r", "id % 9 AS col")).filter("r = 1 or col between 1 + region_id % 3 and 7 - region_id % 3")

    def shapes(top):
        cells = bars.selectExpr("'s' AS scene_id", f"{top}L + region_id * 7 + r AS row", "col", "region_id").repartition(7, "col")
        return sorted(tuple(x) for x in regions.region_moments(cells).collect())

    want = shapes(0)
    assert len(want) == 60 and {x[4] for x in want} == {90.0}
    assert shapes(1_000_000_000) == want
