"""Coast segments stored by a space-filling curve, so that a search box reads few row groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = ("x1", "y1", "x2", "y2")
BOX = ("x_min", "x_max", "y_min", "y_max")
WORLD = (-180.0, -90.0, 180.0, 90.0)
#: Cells an axis of the curve's grid (a power of two), and edge of the coarse cells that a search asks the file for, in degrees.
GRID, COARSE = 1 << 16, 10
#: Boxes that a scan's filter names at most; a search over more coarse cells asks for their common box.
MOST_BOXES = 32


def _spread(v: Column) -> Column:
    """The 16 bits of a number with a free bit before each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def curve_place(x: Column, y: Column, extent: tuple[float, float, float, float] = WORLD) -> Column:
    """Place on the Z-order curve over ``extent`` (west, south, east, north); what lies beyond counts as its edge."""

    def cell(v: Column, low: float, high: float) -> Column:
        return F.least(F.greatest(F.floor((v - low) / (high - low) * GRID), F.lit(0)), F.lit(GRID - 1)).cast("long")

    west, south, east, north = extent
    return _spread(cell(x, west, east)).bitwiseOR(F.shiftleft(_spread(cell(y, south, north)), 1))


def store_coast(coast: DataFrame, path: str, extent: tuple[float, float, float, float] = WORLD, row_group_bytes: int = 1 << 20) -> None:
    """Write segments x1, y1, x2, y2 (other columns stay) as Parquet with their boxes, dealt out and sorted by the places of their
    middles on the curve: near segments share a row group, whose least and greatest box values let a scan pass it over."""
    boxed = coast.withColumns({"x_min": F.least("x1", "x2"), "x_max": F.greatest("x1", "x2"), "y_min": F.least("y1", "y2"), "y_max": F.greatest("y1", "y2")})
    place = curve_place((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, extent)
    n = int(coast.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = boxed.withColumn("_place", place).repartitionByRange(n, "_place").sortWithinPartitions("_place").drop("_place")
    dealt.write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)


def stored_coast(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def in_box(coast: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Segments whose boxes meet a box; of a stored coast, a filter that the scan takes on."""
    return coast.filter((F.col("x_max") >= float(west)) & (F.col("x_min") <= float(east)) & (F.col("y_max") >= float(south)) & (F.col("y_min") <= float(north)))


def near_boxes(coast: DataFrame, boxes: DataFrame) -> DataFrame:
    """Segments of ``coast`` that can meet one of ``boxes`` (west, south, east, north). A stored coast is asked for the coarse cells that the
    boxes touch, 648 in the world at most; any other coast is given back as it is."""
    if not set(BOX) <= set(coast.columns):
        return coast

    def reach(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / COARSE), F.floor(F.col(high) / COARSE)))

    within = boxes.select(F.greatest("west", F.lit(-180.0)).alias("west"), F.greatest("south", F.lit(-90.0)).alias("south"), F.least("east", F.lit(180.0)).alias("east"), F.least("north", F.lit(90.0)).alias("north")).filter("west <= east and south <= north")
    cells = [(r[0], r[1]) for r in within.withColumn("cx", reach("west", "east")).select("cx", "south", "north").withColumn("cy", reach("south", "north")).select("cx", "cy").distinct().collect()]
    if not cells:
        return coast.limit(0)
    if len(cells) > MOST_BOXES:
        xs, ys = [c[0] for c in cells], [c[1] for c in cells]
        return in_box(coast, min(xs) * COARSE, min(ys) * COARSE, (max(xs) + 1) * COARSE, (max(ys) + 1) * COARSE)
    asked = [(F.col("x_max") >= float(x * COARSE)) & (F.col("x_min") <= float((x + 1) * COARSE)) & (F.col("y_max") >= float(y * COARSE)) & (F.col("y_min") <= float((y + 1) * COARSE)) for x, y in sorted(cells)]
    return coast.filter(reduce(lambda a, b: a | b, asked))
