"""The queries over rasters read from the tables, by name. Each returns longs, doubles, strings and booleans only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, SCREENED, SMALL
from ..functions.geodesy import azimuthal_equidistant, geographic_row_area, inverse_affine, utm_inverse
from ..functions.labels import alert_level, detection_confidence, inside_validated, operating_status, rank, region_label
from ..functions.pixels import at_least, below, blended, hex_channels, to_byte
from ..operators import coastline, components, morphology, quality, stats, tiling
from ..operators.contours import contours as outlines
from ..operators.contours import visible_parts
from ..operators.regions import clipped_segments, coast_distances, mask_area_km2, region_moments, region_table, scene_coast_totals, scene_labels
from ..operators.regions import scene_bounds as bounds_in_degrees
from ..operators.shared import scratch_path, write_shared
from ..sources import geotiff, images
from ..sources.rasters import Raster, embeddings_raster, events_raster, lineitem_raster, located, orders_raster, read_table, stored, supplier_coast, supplier_coast_degrees, supplier_scenes
from . import detection, layers, service

CELL = ["scene_id", "row", "col"]
#: Uniform prices have about 0.3 dark cells a tile; this threshold splits the tiles of the grid of line items.
GATED = replace(SMALL, screener_threshold=0.21)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _norm(raster: Raster) -> DataFrame:
    return stats.normalised(raster).select(*CELL, "value", "norm")


def _dark(raster: Raster) -> DataFrame:
    return stats.normalised(raster).filter(below(F.col("norm"), DEFAULT.dark)).select(CELL)


def _bright_mask(raster: Raster) -> DataFrame:
    return stats.normalised(raster).filter(below(F.col("norm"), 0.75)).select(CELL)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else c for c, t in df.dtypes])


def _wide_norm(df: DataFrame) -> DataFrame:
    return df.select(*CELL, F.round(F.col("norm").cast("double"), 6).alias("norm"))


def _eight_places(degrees: str) -> Column:
    """Rounded as a multiple of 1e-8: a half stays one in the product, where the degrees' own last bit may lie below it."""
    return (F.round(F.col(degrees) * 1e8) / 1e8).alias(degrees)


@query
def scene_percentiles(spark, sf_dir):
    return stats.scene_percentiles(orders_raster(spark, sf_dir)).union(stats.scene_percentiles(events_raster(spark, sf_dir)))


@query
def scene_percentiles_strided(spark, sf_dir):
    return stats.scene_percentiles(orders_raster(spark, sf_dir), step=7)


@query
def scene_median(spark, sf_dir):
    return stats.scene_median(events_raster(spark, sf_dir))


@query
def normalize_scene(spark, sf_dir):
    return _wide_norm(_norm(orders_raster(spark, sf_dir)))


@query
def normalize_tile_scope(spark, sf_dir):
    rows = tiling.tile_normalised(embeddings_raster(spark, sf_dir), SMALL)
    return rows.select(*tiling.TILE, "row", "col", F.round(F.col("norm").cast("double"), 6).alias("norm"))


@query
def tile_scope_inputs(spark, sf_dir):
    """What a scorer sees in tile scope: infilled cells of all tiles, scaled by each tile's own range."""
    r, cfg = lineitem_raster(spark, sf_dir), replace(SMALL, norm_scope="tile")
    rows = detection.model_inputs(r, tiling.tile_grid(r.scenes, cfg), cfg)
    return rows.select(*tiling.TILE, "row", "col", F.round(F.col("norm").cast("double"), 6).alias("norm"))


@query
def normalize_fixed_db(spark, sf_dir):
    return _wide_norm(stats.normalised(lineitem_raster(spark, sf_dir), replace(SMALL, norm_scope="fixed_db", fixed_lo=20_000.0, fixed_hi=60_000.0)))


@query
def valid_pixels(spark, sf_dir):
    r = events_raster(spark, sf_dir)
    have = stats.valid_pixels(r).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_valid"))
    return stats.invalid_cells(r).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_invalid"), F.min("row").alias("first_row")).join(have, "scene_id")


@query
def infill_median(spark, sf_dir):
    return stats.infilled(lineitem_raster(spark, sf_dir))


@query
def tile_starts(spark, sf_dir):
    s = orders_raster(spark, sf_dir).scenes
    rows = s.select(F.lit("y").alias("axis"), F.explode(tiling.starts(F.col("height"), SMALL)).alias("start"))
    return rows.union(s.select(F.lit("x").alias("axis"), F.explode(tiling.starts(F.col("width"), SMALL)).alias("start")))


@query
def tile_grid(spark, sf_dir):
    return tiling.tile_grid(orders_raster(spark, sf_dir).scenes, SMALL)


@query
def pad_edge(spark, sf_dir):
    """Vectors are narrower than these tiles, so their last component is repeated."""
    return tiling.padded(embeddings_raster(spark, sf_dir), replace(SMALL, tile=96, stride=84))


@query
def tile_invalid_fraction(spark, sf_dir):
    return _rounded(tiling.tile_validity(lineitem_raster(spark, sf_dir), SMALL).select(*tiling.TILE, "n_invalid", "invalid_fraction"))


@query
def tile_partition(spark, sf_dir):
    t = tiling.partitioned(lineitem_raster(spark, sf_dir), SMALL)
    return t.select(*tiling.TILE, "gi", "gj", "eligible", "touches_scene_boundary", "reason")


@query
def boundary_rejects(spark, sf_dir):
    t = tiling.partitioned(lineitem_raster(spark, sf_dir), replace(SMALL, exclude_boundary=True))
    return t.select(*tiling.TILE, "adjacent_to_nodata", "eligible", "reason")


@query
def overlap_average(spark, sf_dir):
    rows = tiling.stitched(tiling.tile_normalised(embeddings_raster(spark, sf_dir), SMALL).withColumnRenamed("norm", "prob"))
    return rows.select(*CELL, F.round(F.col("prob").cast("double"), 5).alias("prob"), "n_tiles")


@query
def classical_union(spark, sf_dir):
    """By row: cells that the graded segmenter or the dark rule marks."""
    r = orders_raster(spark, sf_dir)
    seg = _norm(r).withColumns({"seg": below(F.col("norm"), 0.1), "classical": below(F.col("norm"), DEFAULT.dark)})
    placed = tiling.on_tiles(seg.select(*CELL, "seg", "classical"), r.scenes, SMALL).groupBy(CELL).agg(F.bool_or("seg").alias("seg"), F.bool_or("classical").alias("classical"))
    return placed.groupBy("scene_id", "row").agg(F.count_if("seg").alias("n_seg"), F.count_if("classical").alias("n_classical"), F.count_if(F.col("seg") | F.col("classical")).alias("n_union"))


@query
def tile_coverage_count(spark, sf_dir):
    r = orders_raster(spark, sf_dir)
    return tiling.on_tiles(r.pixels.select(CELL), r.scenes, SMALL).groupBy(CELL).agg(F.count(F.lit(1)).alias("n_tiles"))


@query
def identity_stitch(spark, sf_dir):
    """Stitching what an identity segmenter returns gives the normalised scene again."""
    r = embeddings_raster(spark, sf_dir)
    norm = _norm(r)
    again = tiling.stitched(tiling.on_tiles(norm.select(*CELL, F.col("norm").alias("prob")), r.scenes, SMALL))
    both = again.join(norm, CELL)
    return both.select(*CELL, F.round(F.col("prob").cast("double"), 5).alias("prob"), (F.abs(F.col("prob") - F.col("norm")) < 1e-5).alias("same"))


@query
def erode_disk2(spark, sf_dir):
    r = embeddings_raster(spark, sf_dir)
    return morphology.eroded(_bright_mask(r), r.scenes, morphology.disk(2))


@query
def open_disk2(spark, sf_dir):
    r = embeddings_raster(spark, sf_dir)
    return morphology.opened(_bright_mask(r), r.scenes, morphology.disk(2))


def _gated_tiles(spark, sf_dir) -> DataFrame:
    return components.write_shared(detection.screened(lineitem_raster(spark, sf_dir), GATED, detection.dark_fraction))


def _grid(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    dims = tiles.groupBy("scene_id").agg((F.max("gi") + 1).alias("height"), (F.max("gj") + 1).alias("width"))
    return tiles.filter("passed").select("scene_id", F.col("gi").alias("row"), F.col("gj").alias("col")), dims


@query
def tile_screening(spark, sf_dir):
    t = _gated_tiles(spark, sf_dir)
    return t.select(*tiling.TILE, "eligible", F.round("p_oil", 6).alias("p_oil"), "passed")


@query
def close_grid(spark, sf_dir):
    return morphology.closed(*_grid(_gated_tiles(spark, sf_dir)))


@query
def fill_holes_grid(spark, sf_dir):
    return components.holes_filled(*_grid(_gated_tiles(spark, sf_dir)))


@query
def expand_pass_grid(spark, sf_dir):
    return _gated_tiles(spark, sf_dir).filter("final").select("scene_id", "gi", "gj")


@query
def tile_counters(spark, sf_dir):
    return _gated_tiles(spark, sf_dir).groupBy("scene_id").agg(F.count_if("passed").alias("base"), F.count_if(F.col("final") & ~F.col("passed")).alias("closing_added"), F.count_if("final").alias("final"))


@query
def connected_components(spark, sf_dir):
    return components.label(_dark(orders_raster(spark, sf_dir)))


@query
def components_four(spark, sf_dir):
    runs = components.labelled_runs(_dark(orders_raster(spark, sf_dir)), connectivity=1)
    return components.sized(runs)


@query
def remove_small(spark, sf_dir):
    dark = _dark(orders_raster(spark, sf_dir))
    return components.cells(components.at_least(components.labelled_runs(dark), SMALL.min_blob)).select(CELL)


def _regions(spark, sf_dir) -> tuple[Raster, DataFrame]:
    r = orders_raster(spark, sf_dir)
    return r, components.write_shared(components.label(_dark(r), min_pixels=SMALL.min_blob))


def _region_table(spark, sf_dir, coast: bool = False) -> tuple[Raster, DataFrame]:
    r, labelled = _regions(spark, sf_dir)
    prob = _norm(r).select(*CELL, (1.0 - F.col("norm").cast("double")).alias("prob"))
    return r, region_table(labelled, r.scenes, prob, supplier_coast(spark, sf_dir) if coast else None)


@query
def region_measurements(spark, sf_dir):
    t = _region_table(spark, sf_dir)[1]
    return t.select("scene_id", "region_id", "n_pixels", "area_km2", "centroid_row", "centroid_col", "mean_probability", "min_row", "max_row", "min_col", "max_col", F.round("centroid_x", 6).alias("centroid_x"), F.round("centroid_y", 6).alias("centroid_y"))


@query
def region_shapes(spark, sf_dir):
    m = region_moments(_regions(spark, sf_dir)[1])
    return m.select("scene_id", "region_id", *[F.round(c, 4).alias(c) for c in ("axis_major_length_px", "axis_minor_length_px", "orientation_deg")])


@query
def region_alert(spark, sf_dir):
    t = _region_table(spark, sf_dir, coast=True)[1]
    return t.select("scene_id", "region_id", "distance_to_coast_km", "severity", "confidence")


@query
def scene_alert(spark, sf_dir):
    r, t = _region_table(spark, sf_dir, coast=True)
    return scene_labels(t, r.scenes)


@query
def coast_distance(spark, sf_dir):
    """Nearest stretch of coast for every cell's centre."""
    cells = orders_raster(spark, sf_dir).pixels.select("scene_id", (F.col("row") * 128 + F.col("col")).alias("region_id"), (F.col("col") * 10.0 + 5).alias("centroid_x"), (F.col("row") * -10.0 - 5).alias("centroid_y"))
    return coast_distances(cells, supplier_coast(spark, sf_dir)).select("region_id", F.col("distance_to_coast_km").alias("distance_km"))


@query
def coast_bbox_clip(spark, sf_dir):
    return _rounded(clipped_segments(supplier_coast(spark, sf_dir), 15.0, -500.0, 905.0, 6000.0))


@query
def place_labels(spark, sf_dir):
    """Places of customers on a made-up map: longitude by key, latitude by balance."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", (30 + F.col("c_custkey") % 30).cast("double").alias("lon"), F.round(10 + (F.col("c_acctbal") + 1000) / 500, 6).alias("lat"))
    label = region_label(F.col("lon"), F.col("lat"))
    return c.select("c_custkey", label.alias("label"), inside_validated(label, F.col("lon"), F.col("lat")).alias("validated"))


@query
def row_geodesic_area(spark, sf_dir):
    s = orders_raster(spark, sf_dir).scenes.select("scene_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)).alias("row"))
    return s.select("scene_id", "row", F.round(geographic_row_area(F.col("row"), F.lit(-0.0001), F.lit(27.0), F.lit(0.0001)), 5).alias("area_m2"))


@query
def mask_area(spark, sf_dir):
    r = orders_raster(spark, sf_dir)
    return mask_area_km2(_dark(r), r.scenes)


def _geographic(spark, sf_dir) -> Raster:
    return located(orders_raster(spark, sf_dir), "EPSG:4326", 0.0005, 50.0, 27.0)


@query
def geographic_area(spark, sf_dir):
    """Area on the ellipsoid, row by row."""
    r = _geographic(spark, sf_dir)
    return mask_area_km2(_dark(r), r.scenes)


@query
def geographic_regions(spark, sf_dir):
    """Regions of a geographic scene: ellipsoidal areas, centroids in degrees, coast in the scene's local plane."""
    r = _geographic(spark, sf_dir)
    labelled = components.write_shared(components.label(_dark(r), min_pixels=SMALL.min_blob))
    t = region_table(labelled, r.scenes, coast_degrees=supplier_coast_degrees(spark, sf_dir))
    return t.select("region_id", "area_km2", _eight_places("centroid_lon"), _eight_places("centroid_lat"), "distance_to_coast_km", "severity")


@query
def scene_bounds(spark, sf_dir):
    """A UTM scene's box in degrees, by points along its edges."""
    return bounds_in_degrees(located(orders_raster(spark, sf_dir), "EPSG:32639", 10.0, 300_000.0, 2_900_000.0).scenes).select("scene_id", *[F.round(k, 8).alias(k) for k in ("west", "south", "east", "north")])


@query
def coast_search(spark, sf_dir):
    """How far each scene had to search for a coast, and what it found; scenes without any are left out."""
    return scene_coast_totals(supplier_scenes(spark, sf_dir), supplier_coast_degrees(spark, sf_dir))


@query
def projected_centres(spark, sf_dir):
    """Supplier places in a local azimuthal-equidistant plane, and UTM corners back to degrees."""
    s = read_table(spark, sf_dir, "supplier")
    key, y0 = F.col("s_suppkey"), F.col("s_acctbal")
    x, y = azimuthal_equidistant((48 + key % 7).cast("double"), 24 + y0 / 2000, F.lit(51.0), F.lit(26.0))
    lon, lat = utm_inverse(F.lit(300_000.0) + key * 10, F.lit(2_900_000.0) + y0, 39)
    row, col = inverse_affine(key * 10.0, y0, {k: F.lit(v) for k, v in zip("abcdef", (10.0, 0.0, 0.0, 0.0, -10.0, 0.0), strict=True)})
    named = {"x_m": (x, 3), "y_m": (y, 3), "utm_lon": (lon, 7), "utm_lat": (lat, 7), "row": (row, 6), "col": (col, 6)}
    return s.select("s_suppkey", *[F.round(v, n).alias(k) for k, (v, n) in named.items()])


def _found(spark, sf_dir) -> tuple[Raster, detection.Detection]:
    r = stored(lineitem_raster(spark, sf_dir))
    return r, detection.learned(r, replace(GATED, min_blob=5, opening_radius=1, mask=0.6))


@query
def rejected_tiles(spark, sf_dir):
    t = _gated_tiles(spark, sf_dir)
    return _rounded(detection.rejected_tiles(t, GATED).drop("adjacent_to_nodata"))


@query
def rejected_coverage(spark, sf_dir):
    t = _gated_tiles(spark, sf_dir)
    return tiling.covered(t.filter("not final").select(tiling.TILE), GATED)


@query
def screened_semi(spark, sf_dir):
    t = _gated_tiles(spark, sf_dir)
    return t.filter("eligible").select(tiling.TILE).join(t.filter("final").select(tiling.TILE), tiling.TILE, "left_semi")


@query
def screened_anti(spark, sf_dir):
    t = _gated_tiles(spark, sf_dir)
    return t.filter("eligible").select(tiling.TILE).join(t.filter("final").select(tiling.TILE), tiling.TILE, "left_anti")


@query
def rejection_summary(spark, sf_dir):
    return service.rejection_summary(detection.rejected_tiles(_gated_tiles(spark, sf_dir), GATED))


@query
def learned_detection(spark, sf_dir):
    """Two-pass detection: cells of the final mask."""
    return _found(spark, sf_dir)[1].mask


@query
def deterministic_detection(spark, sf_dir):
    r = lineitem_raster(spark, sf_dir)
    return detection.deterministic(r, replace(GATED, min_blob=5, opening_radius=1, mask=0.4)).mask


@query
def undetected_dark(spark, sf_dir):
    r, found = _found(spark, sf_dir)
    return detection.undetected_dark(r, found, replace(GATED, min_blob=4, opening_radius=1))


@query
def undetected_attribution(spark, sf_dir):
    r, found = _found(spark, sf_dir)
    return detection.diagnostic_summary(components.write_shared(detection.undetected_dark(r, found, replace(GATED, min_blob=4, opening_radius=1))), r.scenes)


@query
def dark_categories(spark, sf_dir):
    """All undetected dark areas and those of rejected tiles, with their components."""
    r, found = _found(spark, sf_dir)
    cfg = replace(GATED, min_blob=4, opening_radius=1)
    return detection.dark_categories(write_shared(detection.undetected_dark(r, found, cfg)), r.scenes, cfg)


@query
def footprint_layer(spark, sf_dir):
    """Colours of the segmented footprint over the scene, with rejected tiles tinted below."""
    r, found = _found(spark, sf_dir)
    cells = layers.layer_cells(r, found, "footprint", GATED, rejected=True)
    return cells.select(*CELL, *[F.col(c).cast("long").alias(c) for c in ("red", "green", "blue")])


@query
def attribution_invariants(spark, sf_dir):
    """Counts of cells that break the accounting of dark cells; all are 0. The layer is made another way than its parts: from the
    scene's own scaling and numbered components, with rejections joined tile by tile."""
    r, found = _found(spark, sf_dir)
    cfg = replace(GATED, min_blob=4, opening_radius=1)
    parts = write_shared(detection.undetected_dark(r, found, cfg))
    opened = morphology.opened(_dark(r).join(found.mask, CELL, "left_anti"), r.scenes, morphology.disk(1))
    layer = write_shared(components.label(opened, cfg.connectivity, cfg.min_blob).select(CELL))
    rejected = found.rejected.filter(F.col("reason") == SCREENED).select(tiling.TILE)
    held = tiling.on_tiles(layer, r.scenes, cfg).join(rejected, tiling.TILE, "left_semi").select(CELL).distinct()
    screener = held.join(found.mosaic.filter("prob > 0"), CELL, "left_anti")
    return detection.broken_parts(layer, screener, found.mask, parts)


def _truth(spark, sf_dir) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return o.select(F.lit("orders").alias("scene_id"), F.floor(F.col("o_orderkey") / 128).cast("long").alias("row"), (F.col("o_orderkey") % 128).alias("col"))


@query
def mask_set_ops(spark, sf_dir):
    found, truth = components.write_shared(_dark(orders_raster(spark, sf_dir))), _truth(spark, sf_dir)
    kinds = {"union": found.union(truth).distinct(), "intersect": found.intersect(truth), "missing": truth.exceptAll(found), "extra": found.exceptAll(truth)}
    rows = [df.withColumn("kind", F.lit(k)) for k, df in kinds.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3]).groupBy("kind", "row").agg(F.count(F.lit(1)).alias("n"), F.min("col").alias("first_col"))


@query
def mask_quality(spark, sf_dir):
    found, truth = _dark(orders_raster(spark, sf_dir)), _truth(spark, sf_dir)
    both = found.withColumn("p", F.lit(1)).join(truth.withColumn("t", F.lit(1)), CELL, "full_outer").groupBy("scene_id").agg(F.count("p").alias("p"), F.count("t").alias("t"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    tp = F.col("tp")
    return both.select("scene_id", tp.alias("true_positive"), ratio(tp, F.col("p") + F.col("t") - tp).alias("iou"), ratio(tp, F.col("p")).alias("precision"), ratio(tp, F.col("t")).alias("recall"))


@query
def quality_intervals(spark, sf_dir):
    """Quality of the dark mask against finished orders, with bootstrap intervals over the rows of the scene."""
    units = write_shared(quality.confusion(_dark(orders_raster(spark, sf_dir)), _truth(spark, sf_dir), ["row"]))
    return quality.quality_intervals(units, "row")


@query
def quality_ranks(spark, sf_dir):
    """Rank correlation, row by row, of how much is dark and how much of that is right."""
    units = quality.confusion(_dark(orders_raster(spark, sf_dir)), _truth(spark, sf_dir), ["row"])
    return quality.rank_correlation(units.select((F.col("tp") + F.col("fp")).alias("dark"), F.col("tp")), "dark", "tp")


@query
def coast_box_scan(spark, sf_dir):
    """The coast stored along a curve, and what a search box reads of it."""
    path = scratch_path(spark, "coast")
    coastline.store_coast(supplier_coast_degrees(spark, sf_dir), path)
    near = coastline.in_box(coastline.stored_coast(spark, path), 49.0, 24.0, 50.5, 27.0)
    return near.select("k", F.round("x1", 6).alias("x1"), F.round("y1", 6).alias("y1"), F.round("x2", 6).alias("x2"), F.round("y2", 6).alias("y2"))


@query
def display_uint8(spark, sf_dir):
    r = orders_raster(spark, sf_dir)
    shown = stats.dense_cells(r.scenes).join(_norm(r), CELL, "left")
    return shown.select(*CELL, to_byte(F.coalesce("norm", F.lit(0.0)), F.col("norm").isNotNull()).cast("long").alias("grey"))


@query
def blend_layer(spark, sf_dir):
    r = orders_raster(spark, sf_dir)
    grey = _norm(r).select(*CELL, to_byte(F.col("norm"), F.lit(True)).alias("grey"), below(F.col("norm"), DEFAULT.dark).alias("on"))
    red, green, blue = hex_channels("#ff8c1a")
    return grey.select(*CELL, *[blended(F.col("grey"), F.col("on"), v, DEFAULT.overlay_alpha).cast("long").alias(n) for n, v in (("red", red), ("green", green), ("blue", blue))])


@query
def mask_boundary(spark, sf_dir):
    return morphology.boundary(_dark(orders_raster(spark, sf_dir)))


@query
def contours(spark, sf_dir):
    """Every point of the dark cells' outlines, in order along its ring."""
    return outlines(_dark(orders_raster(spark, sf_dir))).drop("length")


@query
def visible_contours(spark, sf_dir):
    """The outlines' parts that finished orders don't hide."""
    r = orders_raster(spark, sf_dir)
    return visible_parts(outlines(_dark(r)), _truth(spark, sf_dir), r.scenes)


def _placed_events(spark, sf_dir) -> Raster:
    """The events' scenes on geographic grids, each at a place of its own."""
    r = events_raster(spark, sf_dir)
    n = F.length("scene_id").cast("double")
    place = {"crs": F.lit("EPSG:4326"), "a": F.lit(0.01), "b": F.lit(0.0), "c": 6 * n, "d": F.lit(0.0), "e": F.lit(-0.001), "f": 22 + n}
    return Raster(r.pixels, write_shared(r.scenes.withColumns(place), "scenes"))


@query
def scene_catalog(spark, sf_dir):
    """The events' scenes as tiled GeoTIFF files, listed again from their headers: places, titles and labels."""
    out = scratch_path(spark, "files")
    images.write_scenes(_placed_events(spark, sf_dir), out, tile=16, compression=geotiff.LZW, predictor=3).count()
    kinds = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("scene_id")).distinct()
    titles = kinds.filter(F.length("scene_id") % 2 == 0).withColumn("title", F.concat(F.lit("Scene "), "scene_id"))
    listed = service.scene_list(images.scene_headers(spark, f"{out}/*.tif"), titles)
    return _rounded(listed.select("scene_id", "title", "height", "width", "crs", "west", "south", "east", "north", "region_label", "inside_validated_bounds"))


@query
def geotiff_pixels(spark, sf_dir):
    """The same scenes' values, read back block by block: in single precision, as files hold them."""
    out = scratch_path(spark, "files")
    images.write_scenes(_placed_events(spark, sf_dir), out, tile=16, compression=geotiff.LZW, predictor=3).count()
    back = images.read_scenes(spark, f"{out}/*.tif", task_bytes=4096)
    return stats.valid_pixels(Raster(back.pixels, write_shared(back.scenes, "scenes"))).select(*CELL, F.round("value", 4).alias("value"))


@query
def content_id(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", service.content_id(F.col("text")).alias("content_id"))


@query
def lru_eviction(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("used"), (F.length("props") * 1000).cast("long").alias("size"))
    return service.newest(e, "key", "used", 8, "size", 250_000).select("key", "last_used", "bytes", "position", "running_bytes")


@query
def region_export(spark, sf_dir):
    t = _region_table(spark, sf_dir, coast=True)[1]
    return t.orderBy(F.desc("area_km2"), "region_id").select("region_id", "area_km2", "mean_probability", "severity", "confidence", F.round(100 * F.col("area_km2") / F.max("area_km2").over(_all()), 4).alias("bar_width"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy("scene_id")


@query
def analysis_response(spark, sf_dir):
    r, t = _region_table(spark, sf_dir, coast=True)
    s = service.scene_summary(t, r.scenes)
    return s.withColumn("status", operating_status())


@query
def confidence_classes(spark, sf_dir):
    """Alerts and confidence for every order line's made-up area, distance and support, as a check of all edges."""
    li = read_table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 8).alias("area"), F.when(F.col("l_linenumber") % 5 > 0, F.col("l_discount") * 400).alias("distance"), (F.col("l_tax") * 10).alias("p"))
    labels = li.select(alert_level(F.col("area"), F.round("distance", 6)).alias("alert"), detection_confidence(F.round("p", 6)).alias("confidence"))
    return labels.groupBy("alert", "confidence").agg(F.count(F.lit(1)).alias("n"), F.max(rank(F.col("alert"), ("Low", "Moderate", "High", "Critical"))).cast("long").alias("rank"))
