"""Binary morphology on runs of a row, and on masks, relations of true cells (scene_id, row, col).

A run moved by a row offset of a shape stays one run, so an operation makes a row for each run and row of the shape, not for each
cell and cell of the shape. What many shapes cover a place is found by a sweep over the ends of runs in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["scene_id", "row", "col"]
Shape = list[tuple[int, int]]


def disk(radius: int) -> Shape:
    """Half-widths of a disk's rows: (row offset, largest column offset)."""
    return [(r, int((radius * radius - r * r) ** 0.5)) for r in range(-radius, radius + 1)]


def square(radius: int = 1) -> Shape:
    return [(r, radius) for r in range(-radius, radius + 1)]


def cross() -> Shape:
    return [(-1, 0), (0, 1), (1, 0)]


def runs_of(mask: DataFrame) -> DataFrame:
    """Maximal runs of true cells in a row: ``scene_id, row, c0, c1``. Cells may repeat."""
    island = F.col("col") - F.dense_rank().over(Window.partitionBy("scene_id", "row").orderBy("col"))
    return mask.select(*CELL, island.alias("_i")).groupBy("scene_id", "row", "_i").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("_i")


def cells_of(runs: DataFrame) -> DataFrame:
    return runs.select("scene_id", "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def _moved(runs: DataFrame, scenes: DataFrame, shape: Shape, begin, end) -> DataFrame:
    """Runs at each row of the shape within the scene, their ends changed by its half-width there: ``scene_id, row, height, c0, c1``."""
    rows = F.array(*[F.struct(F.lit(-r).alias("r"), F.lit(k).alias("k")) for r, k in shape])
    sized = runs.join(scenes.select("scene_id", "height", "width"), "scene_id").withColumn("_o", F.explode(rows))
    at = sized.select("scene_id", (F.col("row") + F.col("_o.r")).alias("row"), "height", begin(F.col("_o.k")).alias("c0"), end(F.col("_o.k")).alias("c1"))
    return at.filter("c0 <= c1 and row between 0 and height - 1")


def _swept(runs: DataFrame, need: Column) -> DataFrame:
    """Runs of the places that at least ``need`` (of row and height) of the runs cover. Equal ends are added up before the shuffle."""
    ends = F.array(F.struct(F.col("c0").alias("at"), F.lit(1).alias("step")), F.struct((F.col("c1") + 1).alias("at"), F.lit(-1).alias("step")))
    events = runs.select("scene_id", "row", "height", F.explode(ends).alias("_e")).groupBy("scene_id", "row", "height", F.col("_e.at").alias("at")).agg(F.sum("_e.step").alias("step"))
    line = Window.partitionBy("scene_id", "row", "height").orderBy("at")
    on = events.select("scene_id", "row", "height", "at", (F.sum("step").over(line) >= need).alias("on"))
    turns = on.withColumn("_was", F.lag("on", 1, False).over(line)).filter(F.col("on") != F.col("_was"))
    return turns.withColumn("c1", F.lead("at").over(line) - 1).filter("on").select("scene_id", "row", F.col("at").alias("c0"), "c1")


def dilated_runs(runs: DataFrame, scenes: DataFrame, shape: Shape) -> DataFrame:
    moved = _moved(runs, scenes, shape, lambda k: F.greatest(F.col("c0") - k, F.lit(0)), lambda k: F.least(F.col("c1") + k, F.col("width") - 1))
    return _swept(moved, F.lit(1))


def eroded_runs(runs: DataFrame, scenes: DataFrame, shape: Shape, outside: bool = True) -> DataFrame:
    """Places all of whose neighbours in the shape are true: within the shortened runs of each row of the shape. What lies beyond the
    scene counts as ``outside`` says."""
    if outside:
        begin, end = (lambda k: F.when(F.col("c0") > 0, F.col("c0") + k).otherwise(0)), (lambda k: F.when(F.col("c1") < F.col("width") - 1, F.col("c1") - k).otherwise(F.col("c1")))
        need = sum((F.when((F.col("row") + r).between(0, F.col("height") - 1), 1).otherwise(0) for r, _ in shape), F.lit(0))
    else:
        begin, end, need = (lambda k: F.col("c0") + k), (lambda k: F.col("c1") - k), F.lit(len(shape))
    return _swept(_moved(runs, scenes, shape, begin, end), need)


def opened_runs(runs: DataFrame, scenes: DataFrame, shape: Shape) -> DataFrame:
    """Erosion, where the outside counts as true, then dilation."""
    return dilated_runs(eroded_runs(runs, scenes, shape), scenes, shape)


def dilated(mask: DataFrame, scenes: DataFrame, shape: Shape) -> DataFrame:
    return cells_of(dilated_runs(runs_of(mask), scenes, shape))


def eroded(mask: DataFrame, scenes: DataFrame, shape: Shape, outside: bool = True) -> DataFrame:
    return cells_of(eroded_runs(runs_of(mask), scenes, shape, outside))


def opened(mask: DataFrame, scenes: DataFrame, shape: Shape) -> DataFrame:
    return cells_of(opened_runs(runs_of(mask), scenes, shape))


def closed(mask: DataFrame, scenes: DataFrame, shape: Shape | None = None) -> DataFrame:
    """Dilation, then erosion where the outside counts as false; so nothing is added on the outer ring."""
    shape = shape or square()
    return cells_of(eroded_runs(dilated_runs(runs_of(mask), scenes, shape), scenes, shape, outside=False))


def boundary(mask: DataFrame) -> DataFrame:
    """True cells with a 4-neighbour that isn't; beyond the scene nothing is."""
    runs = runs_of(mask)
    reach = runs.groupBy("scene_id").agg((F.max("row") + 2).alias("height"), (F.max("c1") + 2).alias("width"))  # so that every edge is inside
    inner = cells_of(eroded_runs(runs, reach, cross(), outside=False))
    return mask.select(CELL).distinct().join(inner, CELL, "left_anti")
