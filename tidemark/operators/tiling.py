"""Overlapping tiles: grids, containment as an equi-join key, eligibility, stitching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BOUNDARY, DEFAULT, INVALID, Config
from ..functions.pixels import scaled
from ..sources.rasters import Raster
from .stats import invalid_cells, valid_pixels

TILE = ["scene_id", "y", "x"]


def starts(length: Column, cfg: Config = DEFAULT) -> Column:
    """Ascending starts along an axis: multiples of the stride and a last tile at the far edge; 0 alone for short axes."""
    last = F.greatest(length - cfg.tile, F.lit(0).cast("long"))
    return F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(cfg.stride).cast("long")), F.array(last))))


def starts_over(p: Column, length: Column, cfg: Config = DEFAULT) -> Column:
    """Starts of the tiles that hold position ``p``: the key on which a pixel meets its tiles, at most three an axis."""
    last = F.greatest(length - cfg.tile, F.lit(0).cast("long"))
    low = F.greatest(F.lit(0).cast("long"), F.ceil((p - cfg.tile + 1) / cfg.stride))
    high = F.least(F.floor(p / cfg.stride), F.floor(last / cfg.stride))
    none = F.array().cast("array<bigint>")
    regular = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: k * cfg.stride)).otherwise(none)
    return F.array_distinct(F.concat(regular, F.when(p >= last, F.array(last)).otherwise(none)))


def tile_grid(scenes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``scene_id, gi, gj, y, x, height, width`` of every tile; gi and gj are places in the grid."""
    ys = scenes.select("scene_id", "height", "width", F.posexplode(starts(F.col("height"), cfg)).alias("gi", "y"))
    grid = ys.select("*", F.posexplode(starts(F.col("width"), cfg)).alias("gj", "x"))
    return grid.select("scene_id", F.col("gi").cast("long").alias("gi"), F.col("gj").cast("long").alias("gj"), "y", "x", "height", "width")


def on_tiles(cells: DataFrame, scenes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Each cell once for each tile that holds it, with the tile's ``y, x``."""
    sized = cells.join(scenes.select("scene_id", "height", "width"), "scene_id")
    rows = sized.withColumn("y", F.explode(starts_over(F.col("row"), F.col("height"), cfg))).withColumn("x", F.explode(starts_over(F.col("col"), F.col("width"), cfg)))
    return rows.drop("height", "width")


def padded(raster: Raster, cfg: Config = DEFAULT) -> DataFrame:
    """Cells of scenes that are smaller than a tile, with edges repeated up to its size: ``scene_id, row, col, value``."""
    tall = raster.scenes.select("scene_id", "height", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("height"), F.lit(cfg.tile)) - 1)).alias("row"))
    wide = tall.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("width"), F.lit(cfg.tile)) - 1)).alias("col"))
    # the dense cells look as small as the table of scenes that they come from; they must not be broadcast
    source = wide.hint("merge").select("scene_id", "row", "col", F.least("row", F.col("height") - 1).alias("_r"), F.least("col", F.col("width") - 1).alias("_c"))
    values = valid_pixels(raster).select("scene_id", F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
    return source.join(values, ["scene_id", "_r", "_c"]).select("scene_id", "row", "col", "value")


def tile_validity(raster: Raster, cfg: Config = DEFAULT) -> DataFrame:
    """The grid with ``n_invalid`` and ``invalid_fraction``. Repeated edges of small scenes count as they are."""
    small = (F.col("height") < cfg.tile) | (F.col("width") < cfg.tile)
    cells = valid_pixels(raster).join(raster.scenes.filter(~small).select("scene_id"), "scene_id", "left_semi").select("scene_id", "row", "col")
    repeated = padded(Raster(raster.pixels, raster.scenes.filter(small)), cfg).select("scene_id", "row", "col")
    grown = raster.scenes.withColumns({"height": F.greatest(F.col("height"), F.lit(cfg.tile)), "width": F.greatest(F.col("width"), F.lit(cfg.tile))})
    counts = on_tiles(cells.union(repeated), grown, cfg).groupBy(TILE).agg(F.count(F.lit(1)).alias("_n"))
    n = cfg.tile * cfg.tile
    left = tile_grid(raster.scenes, cfg).join(counts, TILE, "left").withColumn("n_invalid", n - F.coalesce("_n", F.lit(0)))
    return left.drop("_n").withColumn("invalid_fraction", F.col("n_invalid") / F.lit(float(n)))


def partitioned(raster: Raster, cfg: Config = DEFAULT) -> DataFrame:
    """``tile_validity`` with ``eligible`` and ``reason``. Only more than the limit is too much."""
    tiles = tile_validity(raster, cfg).withColumn("touches_scene_boundary", (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") + cfg.tile >= F.col("height")) | (F.col("x") + cfg.tile >= F.col("width")))
    bad = F.col("invalid_fraction") > cfg.max_invalid
    if not cfg.exclude_boundary:
        return tiles.withColumns({"adjacent_to_nodata": F.lit(None).cast("boolean"), "eligible": ~bad, "reason": F.when(bad, INVALID)})
    near = nodata_neighbourhood(raster)
    touched = on_tiles(near, raster.scenes, cfg).select(TILE).distinct().withColumn("_near", F.lit(True))
    tiles = tiles.join(touched, TILE, "left").withColumn("adjacent_to_nodata", F.coalesce("_near", F.lit(False))).drop("_near")
    edge = F.col("touches_scene_boundary") | F.col("adjacent_to_nodata")
    return tiles.withColumns({"eligible": ~bad & ~edge, "reason": F.when(bad, INVALID).when(edge, BOUNDARY)})


def nodata_neighbourhood(raster: Raster) -> DataFrame:
    """Invalid cells and their eight neighbours within the scene."""
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    moved = invalid_cells(raster).withColumn("_r", F.explode(near)).withColumn("_c", F.explode(near))
    wide = moved.select("scene_id", (F.col("row") + F.col("_r")).alias("row"), (F.col("col") + F.col("_c")).alias("col"))
    sized = wide.join(raster.scenes.select("scene_id", "height", "width"), "scene_id")
    return sized.filter("row between 0 and height - 1 and col between 0 and width - 1").select("scene_id", "row", "col").distinct()


def tile_normalised(raster: Raster, cfg: Config = DEFAULT) -> DataFrame:
    """Valid pixels on their tiles, scaled by each tile's own percentiles: ``scene_id, y, x, row, col, norm``."""
    return scaled_by_tile(on_tiles(valid_pixels(raster), raster.scenes, cfg), cfg).select(*TILE, "row", "col", "norm")


def scaled_by_tile(cells: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Cells on their tiles (scene_id, y, x, value, ...) with ``norm`` by each tile's own percentiles, in place of ``value``."""
    p = F.percentile("value", F.array(F.lit(cfg.lo_pct / 100), F.lit(cfg.hi_pct / 100)))
    bounds = cells.groupBy(TILE).agg(p.alias("p")).select(*TILE, F.round(F.col("p")[0], 6).alias("lo"), F.round(F.col("p")[1], 6).alias("hi"))
    return cells.join(bounds, TILE).withColumn("norm", scaled(F.col("value"), F.col("lo"), F.col("hi"))).drop("value", "lo", "hi")


def stitched(predictions: DataFrame) -> DataFrame:
    """Means of overlapping predictions (scene_id, row, col, prob): ``prob`` (single precision) and ``n_tiles``."""
    return predictions.groupBy("scene_id", "row", "col").agg(F.round(F.avg(F.col("prob").cast("double")), 6).cast("float").alias("prob"), F.count(F.lit(1)).alias("n_tiles"))


def covered(tiles: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Cells that any of ``tiles`` (scene_id, y, x) covers, each once."""
    span = F.sequence(F.lit(0).cast("long"), F.lit(cfg.tile - 1).cast("long"))
    rows = tiles.withColumn("_s", F.explode(span)).select("scene_id", "x", (F.col("y") + F.col("_s")).alias("row")).distinct()
    return rows.withColumn("_s", F.explode(span)).select("scene_id", "row", (F.col("x") + F.col("_s")).alias("col")).distinct()
