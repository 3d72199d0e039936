"""Scenes as relations, read from tables: ``pixels(scene_id, row, col, value)`` and ``scenes(scene_id, height, width, ...)``.

A cell without a row, or with a null value, is an invalid pixel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import write_shared

SCENE_COLUMNS = ("scene_id", "height", "width", "nodata", "crs", "a", "b", "c", "d", "e", "f")


@dataclass(frozen=True)
class Raster:
    pixels: DataFrame
    scenes: DataFrame


def scene_table(dims: DataFrame, pixel_m: float = 10.0) -> DataFrame:
    """Scenes of ``dims`` (scene_id, height, width) on a north-up metric grid whose upper left corner is the origin."""
    place = {"nodata": F.lit(None).cast("double"), "crs": F.lit("LOCAL_METRIC"), "a": F.lit(pixel_m), "b": F.lit(0.0), "c": F.lit(0.0), "d": F.lit(0.0), "e": F.lit(-pixel_m), "f": F.lit(0.0)}
    return dims.withColumns(place).select(*SCENE_COLUMNS)


def from_cells(cells: DataFrame, height: Column | None = None, width: Column | None = None) -> Raster:
    """A raster whose scenes reach to their largest row and column, or to the given constants."""
    reach = cells.groupBy("scene_id").agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    dims = reach.select("scene_id", (height if height is not None else F.col("_h")).cast("long").alias("height"), (width if width is not None else F.col("_w")).cast("long").alias("width"))
    scenes = write_shared(scene_table(dims), "scenes")  # a row a scene; later joins see its real size
    return Raster(cells.select("scene_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value")), scenes)


def stored(raster: Raster) -> Raster:
    """The raster with its pixels written, for plans that read them often and whose source has to compute them."""
    return Raster(write_shared(raster.pixels, "pixels"), raster.scenes)


def located(raster: Raster, crs: str, pixel: float, west: float, north: float) -> Raster:
    """The raster on another north-up grid: reference system, pixel size and upper left corner."""
    place = {"crs": F.lit(crs), "a": F.lit(pixel), "b": F.lit(0.0), "c": F.lit(west), "d": F.lit(0.0), "e": F.lit(-pixel), "f": F.lit(north)}
    return Raster(raster.pixels, write_shared(raster.scenes.withColumns(place), "scenes"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_raster(spark: SparkSession, sf_dir: str, width: int = 128) -> Raster:
    """Total prices in rows of 128 by order key."""
    o = read_table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return from_cells(o.select(F.lit("orders").alias("scene_id"), F.floor(key / width).cast("long").alias("row"), (key % width).alias("col"), F.col("o_totalprice").alias("value")), width=F.lit(width))


def embeddings_raster(spark: SparkSession, sf_dir: str) -> Raster:
    """Vectors as rows."""
    e = read_table(spark, sf_dir, "embeddings")
    return from_cells(e.select(F.lit("embeddings").alias("scene_id"), F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "value")))


def events_raster(spark: SparkSession, sf_dir: str) -> Raster:
    """A scene for each event type: users by days of January 2024, mean value of a cell."""
    e = read_table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    cells = e.select(F.col("event_type").alias("scene_id"), F.col("user_id").alias("row"), day.alias("col"), "value").filter("row is not null and col between 0 and 29")
    return from_cells(cells.groupBy("scene_id", "row", "col").agg(F.round(F.avg("value"), 6).alias("value")), width=F.lit(30))


def lineitem_raster(spark: SparkSession, sf_dir: str, side: int = 200) -> Raster:
    """Mean prices on a grid of order and part keys."""
    li = read_table(spark, sf_dir, "lineitem")
    cells = li.groupBy(F.lit("lineitem").alias("scene_id"), (F.col("l_orderkey") % side).alias("row"), (F.col("l_partkey") % side).alias("col")).agg(F.round(F.avg("l_extendedprice"), 6).alias("value"))
    return from_cells(cells, F.lit(side), F.lit(side))


def supplier_coast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments between neighbours by supplier key: ``x1, y1, x2, y2`` in metres. Joined on the key, which is dense."""
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 10.0).alias("x"), F.col("s_acctbal").alias("y"))
    after = s.select((F.col("k") - 1).alias("k"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return s.join(after, "k").select("k", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def supplier_coast_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same neighbours in longitude and latitude: rows of fifty points, a tenth of a degree apart, latitude by balance."""
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (48 + (F.col("s_suppkey") % 50) / 10).alias("x"), F.round(24 + F.col("s_acctbal") / 2000, 6).alias("y"))
    after = s.select((F.col("k") - 1).alias("k"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return s.join(after, "k").select("k", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def supplier_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A geographic scene of one degree for each supplier, some of them far from any coast."""
    s = read_table(spark, sf_dir, "supplier")
    west, north = (30 + F.col("s_suppkey") % 30).cast("double"), F.round(10 + (F.col("s_acctbal") + 1000) / 500, 6)
    dims = s.select(F.col("s_suppkey").cast("string").alias("scene_id"), F.lit(100).cast("long").alias("height"), F.lit(100).cast("long").alias("width"), west.alias("_w"), north.alias("_n"))
    grid = {"nodata": F.lit(None).cast("double"), "crs": F.lit("EPSG:4326"), "a": F.lit(0.01), "b": F.lit(0.0), "c": F.col("_w"), "d": F.lit(0.0), "e": F.lit(-0.01), "f": F.col("_n")}
    return dims.withColumns(grid).select(*SCENE_COLUMNS)
