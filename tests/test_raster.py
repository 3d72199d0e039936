"""Hand-made cases of the raster engine, and brute force for its neighbourhood operators."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.config import CONFIDENCE_ORDER, DEFAULT, SMALL, Config
from tidemark.functions.geodesy import geographic_row_area, to_degrees, utm_forward, utm_inverse, with_local_plane
from tidemark.functions.labels import alert_level, detection_confidence
from tidemark.operators import components, morphology, stats, tiling
from tidemark.operators.graph import connected_components
from tidemark.operators.regions import clipped_segments, coast_distances, mask_area_km2, region_table, scene_bounds, scene_coast, scene_labels
from tidemark.plans import detection
from tidemark.sources.rasters import Raster, from_cells, located

CELLS = "scene_id string, row long, col long"


def mask(spark, text, scene="s"):
    rows = [(scene, r, c) for r, line in enumerate(text.split("\n")) for c, x in enumerate(line) if x == "#"]
    return spark.createDataFrame(rows, CELLS)


def dims(spark, h, w, scene="s"):
    return spark.createDataFrame([(scene, h, w)], "scene_id string, height long, width long")


def got(df):
    return {(r["row"], r["col"]) for r in df.collect()}


def raster(spark, values, scene="s"):
    """Rows of values; None is an invalid pixel."""
    cells = [(scene, r, c, v) for r, line in enumerate(values) for c, v in enumerate(line) if v is not None]
    df = spark.createDataFrame(cells, CELLS + ", value double")
    return from_cells(df, F.lit(len(values)), F.lit(len(values[0])))


@pytest.mark.parametrize(("length", "want"), [(256, [0]), (257, [0, 1]), (480, [0, 224]), (500, [0, 224, 244]), (100, [0])])
def test_starts(spark, length, want):
    assert spark.range(1).select(tiling.starts(F.lit(length).cast("long"), DEFAULT)).first()[0] == want


def test_starts_over_agrees_with_between(spark):
    for length in (5, 16, 17, 31, 44, 61):
        s = spark.range(1).select(tiling.starts(F.lit(length).cast("long"), SMALL)).first()[0]
        rows = spark.range(length).select("id", tiling.starts_over(F.col("id"), F.lit(length).cast("long"), SMALL).alias("k")).collect()
        for r in rows:
            assert sorted(r["k"]) == [x for x in s if x <= r["id"] < x + 16]


def test_exactly_a_fifth_invalid_is_eligible(spark):
    cfg = replace(SMALL, tile=10, stride=10)
    for n, want in ((20, True), (21, False)):
        values = [[None if r * 10 + c < n else 1.0 for c in range(10)] for r in range(10)]
        row = tiling.partitioned(raster(spark, values), cfg).first()
        assert row["eligible"] is want and row["n_invalid"] == n


def test_small_scene_is_padded(spark):
    r = raster(spark, [[1.0, 2.0, 3.0, 4.0, None]] * 3)
    cfg = replace(SMALL, tile=8, stride=7)
    padded = tiling.padded(r, cfg).collect()
    assert len(padded) == 8 * 4 and {x["value"] for x in padded if x["row"] == 7} == {1.0, 2.0, 3.0, 4.0}
    assert tiling.tile_validity(r, cfg).first()["n_invalid"] == 32  # the invalid edge is repeated


def test_collapsed_range_and_invalid_values(spark):
    flat = raster(spark, [[5.0] * 4] * 4)
    assert {r["norm"] for r in stats.normalised(flat).collect()} == {0.0}
    odd = raster(spark, [[1.0, float("nan"), float("inf"), None]])
    assert stats.valid_pixels(odd).count() == 1
    assert stats.scene_percentiles(raster(spark, [[float("nan")]])).count() == 0
    with_nodata = replace(odd.__class__(odd.pixels, odd.scenes.withColumn("nodata", F.lit(1.0))))
    assert stats.valid_pixels(with_nodata).count() == 0


def test_tile_scope_is_no_scene_scope(spark):
    with pytest.raises(ValueError):
        stats.normalised(raster(spark, [[1.0]]), replace(SMALL, norm_scope="tile"))
    with pytest.raises(ValueError):
        Config(norm_scope="other")


def test_infill_takes_the_median(spark):
    rows = stats.infilled(raster(spark, [[1.0, None, 9.0, 2.0]])).collect()
    assert [r["value"] for r in rows if not r["valid"]] == [2.0]


def test_labels(spark):
    rows = [(5.0, 1.0, 0.26), (5.1, 15.0, 0.7), (5.1, 14.9, float("nan")), (0.5, None, None), (0.5, float("nan"), 0.25), (1.0, 10.0, 0.9), (0.1, 9.9, 0.5)]
    df = spark.createDataFrame(rows, "a double, d double, p double").select(alert_level(F.col("a"), F.col("d")), detection_confidence(F.col("p")))
    assert [tuple(r) for r in df.collect()] == [("Moderate", "Medium"), ("High", "High"), ("Critical", "Low"), ("Low", "Low"), ("Low", "Low"), ("Low", "High"), ("Moderate", "Medium")]


def brute_erode(cells, h, w, shape, outside):
    out = set()
    for r in range(h):
        for c in range(w):
            if all(((r + dr, c + dc) in cells) if 0 <= r + dr < h and 0 <= c + dc < w else outside for dr, k in shape for dc in range(-k, k + 1)):
                out.add((r, c))
    return out


def test_morphology_against_brute_force(spark):
    rng = random.Random(4)
    h, w = 11, 13
    text = "\n".join("".join("#" if rng.random() < 0.8 else "." for _ in range(w)) for _ in range(h))
    m, d = mask(spark, text), dims(spark, h, w)
    cells = got(m)
    for shape in (morphology.disk(1), morphology.disk(2), morphology.square()):
        for outside in (True, False):
            assert got(morphology.eroded(m, d, shape, outside)) == brute_erode(cells, h, w, shape, outside)
    opened = morphology.opened(m, d, morphology.disk(1))
    assert got(opened) <= cells and got(morphology.opened(opened, d, morphology.disk(1))) == got(opened)
    ring = {(r, c) for r, c in got(morphology.closed(m, d)) - cells if r in (0, h - 1) or c in (0, w - 1)}
    assert not ring


def brute_components(cells, connectivity):
    left, out = set(cells), {}
    for start in sorted(cells):
        if start not in left:
            continue
        stack = [start]
        left.discard(start)
        while stack:
            r, c = stack.pop()
            out[(r, c)] = start
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    n = (r + dr, c + dc)
                    if n in left and (connectivity == 2 or abs(dr) + abs(dc) == 1):
                        left.discard(n)
                        stack.append(n)
    return out


@pytest.mark.parametrize("connectivity", [1, 2])
@pytest.mark.parametrize("block", [4, 1024])
def test_components_across_blocks(spark, connectivity, block):
    rng = random.Random(connectivity * 10 + block)
    text = "\n".join("".join("#" if rng.random() < 0.5 else "." for _ in range(17)) for _ in range(14))
    m = mask(spark, text)
    want = brute_components(got(m), connectivity)
    rows = components.cells(components.labelled_runs(m, connectivity, block)).collect()
    assert {(r["row"], r["col"]): (r["first_row"], r["first_col"]) for r in rows} == want


def test_component_size_edge_and_empty_mask(spark):
    m = mask(spark, "##..#\n....#\n....#")
    assert {r["region_id"] for r in components.label(m, min_pixels=2).collect()} == {1, 2}
    assert components.label(m, min_pixels=3).count() == 3
    empty = mask(spark, "...")
    assert components.label(empty).count() == 0
    assert detection.measure(raster(spark, [[1.0]]), empty).count() == 0


def test_holes(spark):
    m = mask(spark, "#####\n#...#\n#.#.#\n#####\n..#..")
    filled = got(components.holes_filled(m, dims(spark, 5, 5)))
    assert filled == got(m) | {(1, 1), (1, 2), (1, 3), (2, 1), (2, 3)}


def test_expansion_only_admits_eligible_tiles(spark):
    ring = [("s", i, j, not (i == 2 and j == 2), (i, j) != (2, 2) and 1 <= i <= 3 and 1 <= j <= 3) for i in range(5) for j in range(5)]
    t = spark.createDataFrame(ring, "scene_id string, gi long, gj long, eligible boolean, passed boolean")
    assert detection.expanded_pass_grid(t).count() == 8
    assert detection.expanded_pass_grid(t.withColumn("eligible", F.lit(True))).count() == 9


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(df, components.write_shared).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 200: 150}
    assert connected_components(df.limit(0), components.write_shared).count() == 0


def test_region_shapes_and_scene_labels(spark):
    r = raster(spark, [[1.0] * 30] * 4)
    bar = spark.createDataFrame([("s", 1, c, 1) for c in range(5, 25)], CELLS + ", region_id long")
    row = region_table(bar, r.scenes).first()
    assert row["n_pixels"] == 20 and row["centroid_col"] == 14.5 and abs(abs(row["orientation_deg"]) - 90) < 1e-9
    assert math.isclose(row["axis_major_length_px"], 4 * math.sqrt((20**2 - 1) / 12)) and row["axis_minor_length_px"] == 0
    none = scene_labels(region_table(bar.limit(0), r.scenes), r.scenes).first()
    assert (none["alert"], none["confidence"], none["n_regions"]) == ("Low", CONFIDENCE_ORDER[0], 0)


def test_coast_distance_is_exact_at_any_range(spark):
    rng = random.Random(1)
    segments = [(rng.uniform(-4e5, 4e5), rng.uniform(-4e5, 4e5)) for _ in range(30)]
    rows = [(x, y, x + rng.uniform(-9e3, 9e3), y + rng.uniform(-9e3, 9e3)) for x, y in segments]
    coast = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double")
    points = [("s", i, rng.uniform(-6e5, 6e5), rng.uniform(-6e5, 6e5)) for i in range(25)]
    regions = spark.createDataFrame(points, "scene_id string, region_id long, centroid_x double, centroid_y double")

    def d(px, py, x1, y1, x2, y2):
        t = max(0, min(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return math.hypot(px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1))

    found = {r["region_id"]: r["distance_to_coast_km"] for r in coast_distances(regions, coast).collect()}
    assert len(found) == 25
    for _, i, px, py in points:
        assert math.isclose(found[i], min(d(px, py, *s) for s in rows) / 1000, abs_tol=1e-6)
    assert {r[2] for r in coast_distances(regions, coast.limit(0)).collect()} == {None}


def test_clip(spark):
    coast = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0), (0.0, 20.0, 5.0, 20.0), (4.0, -5.0, 4.0, 15.0)], "x1 double, y1 double, x2 double, y2 double")
    assert {tuple(r) for r in clipped_segments(coast, 2, 2, 6, 6).collect()} == {(2.0, 2.0, 6.0, 6.0), (4.0, 2.0, 4.0, 6.0)}


def test_geodesy(spark):
    # one degree of latitude and of longitude at the equator and at 60 degrees north on the ellipsoid
    area = spark.range(1).select(geographic_row_area(F.lit(0), F.lit(-0.001), F.lit(0.0005), F.lit(0.001)), geographic_row_area(F.lit(0), F.lit(-0.001), F.lit(60.0005), F.lit(0.001))).first()
    assert math.isclose(area[0], 111.319491 * 110.574276, rel_tol=1e-6) and math.isclose(area[1], 55.800 * 111.412, rel_tol=1e-4)
    lon, lat = spark.range(1).select(*utm_inverse(F.lit(500_000.0), F.lit(4_649_776.22), 31)).first()
    assert math.isclose(lon, 3.0, abs_tol=1e-9) and math.isclose(lat, 42.0, abs_tol=1e-4)


def test_local_plane_is_that_of_the_ellipsoid(spark):
    # lengths of geodesics on WGS84: a degree of the equator, of the meridian, of both, and none
    rows = [(1.0, 0.0, 111319.490793), (0.0, 1.0, 110574.388558), (1.0, 1.0, 156899.568291), (0.0, 0.0, 0.0), (-1.0, 0.0, 111319.490793)]
    df = spark.createDataFrame([(0.0, 0.0, *r) for r in rows] + [(179.5, 0.0, -179.5, 0.0, 111319.490793)], "lon0 double, lat0 double, lon double, lat double, want double")
    for r in with_local_plane(df, "lon", "lat", "lon0", "lat0", "x", "y").collect():
        assert math.isclose(math.hypot(r["x"], r["y"]), r["want"], rel_tol=5e-8, abs_tol=1e-6)
        assert (r["x"] > 0) == (r["lon"] > 0 or r["lon0"] > 1) and (r["y"] > 1e-6) == (r["lat"] > 0)


def test_utm_there_and_back(spark):
    df = spark.createDataFrame([(50.2, 26.3, "EPSG:32639"), (-70.9, -33.4, "EPSG:32719"), (3.0, 42.0, "EPSG:32631"), (3.0, 42.0, "EPSG:3857"), (3.0, 42.0, None)], "lon double, lat double, crs string")
    zone = F.try_element_at(F.array(F.lit(39), F.lit(19), F.lit(31)), F.when(F.col("lon") > 50, 1).when(F.col("lon") < 0, 2).otherwise(3))
    x, y = utm_forward(F.col("lon"), F.col("lat"), zone, F.col("lat") < 0)
    at = df.withColumns({"x": x, "y": y})
    lon, lat = to_degrees(F.col("crs"), F.col("x"), F.col("y"))
    rows = at.withColumns({"lon2": lon, "lat2": lat}).collect()
    for r in rows[:3]:
        assert math.isclose(r["lon"], r["lon2"], abs_tol=1e-9) and math.isclose(r["lat"], r["lat2"], abs_tol=1e-9)
    assert math.isclose(rows[2]["x"], 500_000.0, abs_tol=1e-6) and [(r["lon2"], r["lat2"]) for r in rows[3:]] == [(None, None)] * 2


def test_coast_is_searched_twice_and_no_farther(spark):
    grid = "scene_id string, height long, width long, crs string, a double, b double, c double, d double, e double, f double"
    place = lambda name, west, crs="EPSG:4326": (name, 100, 100, crs, 0.01, 0.0, west, 0.0, -0.01, 26.0)
    scenes = spark.createDataFrame([place("near", 50.0), place("far", 46.0), place("none", 40.0), place("unknown", 50.0, "LOCAL")], grid)
    coast = spark.createDataFrame([(52.5, 20.0, 52.5, 30.0), (50.2, 40.0, 50.4, 41.0)], "x1 double, y1 double, x2 double, y2 double")
    found = {r["scene_id"]: r for r in scene_coast(scenes, coast).collect()}
    assert {k: r["search_deg"] for k, r in found.items()} == {"near": 2.0}  # the far scene's window ends at 52 degrees
    wider = {r["scene_id"]: r["search_deg"] for r in scene_coast(scenes, coast, replace(DEFAULT, coast_fallback_deg=6.0)).collect()}
    assert wider == {"near": 2.0, "far": 6.0}
    # the stretch within 2 degrees: from 23 to 28 north, 2 degrees east of the scene's middle
    length = math.hypot(found["near"]["x2"] - found["near"]["x1"], found["near"]["y2"] - found["near"]["y1"])
    assert math.isclose(length, 5 * 110_800, rel_tol=2e-3) and math.isclose(found["near"]["x1"], 2 * 102_000, rel_tol=2e-2)


def test_regions_in_degrees(spark):
    bar = mask(spark, "....\n.##.\n....").withColumn("region_id", F.lit(1).cast("long"))
    r = raster(spark, [[1.0] * 4] * 3)
    coast = spark.createDataFrame([(51.0, 25.0, 51.0, 28.0)], "x1 double, y1 double, x2 double, y2 double")
    degrees = located(r, "EPSG:4326", 0.001, 50.0, 26.5)
    a = region_table(bar, degrees.scenes, coast_degrees=coast).first()
    assert math.isclose(a["centroid_lon"], 50.002, abs_tol=1e-9) and math.isclose(a["centroid_lat"], 26.4985, abs_tol=1e-9)
    assert math.isclose(a["distance_to_coast_km"], 99.48, abs_tol=0.1)
    x, y = spark.range(1).select(*utm_forward(F.lit(50.0), F.lit(26.5), 39)).first()
    metres = located(r, "EPSG:32639", 100.0, x, y)
    b = region_table(bar, metres.scenes, coast_degrees=coast).first()
    assert math.isclose(b["centroid_lon"], 50.002, abs_tol=1e-4) and math.isclose(b["distance_to_coast_km"], a["distance_to_coast_km"], rel_tol=2e-3)
    box = scene_bounds(metres.scenes).first()
    assert box["west"] <= 50.0 + 1e-9 < b["centroid_lon"] < box["east"] and box["south"] < b["centroid_lat"] < box["north"]
    assert scene_bounds(r.scenes).first()["west"] is None  # a grid of its own has no degrees
    assert region_table(bar, r.scenes, coast_degrees=coast).first()["distance_to_coast_km"] is None
    with pytest.raises(Exception, match="no reference system"):
        mask_area_km2(bar, Raster(r.pixels, r.scenes.withColumn("crs", F.lit(None).cast("string"))).scenes).collect()


def test_full_plans_on_a_dark_square(spark):
    size = 48
    values = [[0.0 if 10 <= r < 24 and 12 <= c < 30 else 100.0 + (r * 7 + c * 3) % 11 for c in range(size)] for r in range(size)]
    r = raster(spark, values)
    cfg = replace(SMALL, screener_threshold=0.05, mask=0.5)
    for found in (detection.learned(r, cfg), detection.deterministic(r, cfg)):
        assert {(10, 12), (23, 29)} <= got(detection.cleaned(found.mosaic.filter("prob >= 0.5").select(*CELLS.replace(" string", "").replace(" long", "").split(", ")), r.scenes, replace(cfg, opening_radius=0)))
        table = detection.measure(r, found.mask, found.mosaic)
        assert table.count() == 1
        assert abs(table.first()["n_pixels"] - 14 * 18) <= 4  # opening rounds the corners off
        dark = detection.undetected_dark(r, found, cfg)
        assert dark.join(found.mask, ["scene_id", "row", "col"]).count() == 0
    assert found.rejected.count() == 0
