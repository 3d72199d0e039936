"""Outlines of masks: marching squares at one half as a relation of points, put in order around each ring by pointer doubling.

A point lies half way between a true cell and a neighbour in row or column that isn't; its coordinates are kept doubled, so that they
are integers. Every point has one successor, so rings are the cycles of a permutation. On the way round, true cells lie to the
right. A ring begins at its least point (by row, then column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .morphology import CELL, runs_of
from .ranks import ranked
from .shared import discard, write_shared

#: Edges of a square of four cell centres, clockwise.
_TOP, _RIGHT, _BOTTOM, _LEFT = range(4)


def crossings(mask: DataFrame) -> DataFrame:
    """Points between true cells and others, ``scene_id, y, x`` (doubled), each with the square that the outline enters there
    (``enters``: its upper left cell and the edge) and the one that it leaves (``leaves``). Beyond the mask nothing is true.

    Made from runs: their ends, and where the runs of two rows differ, so rows grow with the outline and not with the area."""
    runs = write_shared(runs_of(mask), "runs")

    def side(row, col, edge: int):
        return F.struct(row.cast("long").alias("i"), col.cast("long").alias("j"), F.lit(edge).alias("edge"))

    row, col = F.col("row"), F.col("col")
    west = runs.select("scene_id", "row", (F.col("c0") - 1).alias("col"))  # the true cell follows: up
    east = runs.select("scene_id", "row", F.col("c1").alias("col"))  # the true cell comes first: down
    up = west.select("scene_id", (2 * row).alias("y"), (2 * col + 1).alias("x"), side(row - 1, col, _BOTTOM).alias("enters"), side(row, col, _TOP).alias("leaves"))
    down = east.select("scene_id", (2 * row).alias("y"), (2 * col + 1).alias("x"), side(row, col, _TOP).alias("enters"), side(row - 1, col, _BOTTOM).alias("leaves"))
    ends = [(r, at, s) for r in (0, 1) for at, s in ((F.col("c0"), 1), (F.col("c1") + 1, -1))]
    told = F.array(*[F.struct((row - r).alias("row"), at.alias("at"), F.lit(s if r == 0 else 0).alias("above"), F.lit(s if r == 1 else 0).alias("below")) for r, at, s in ends])
    events = runs.select("scene_id", F.explode(told).alias("e")).groupBy("scene_id", "e.row", "e.at").agg(F.sum("e.above").alias("above"), F.sum("e.below").alias("below"))
    line = Window.partitionBy("scene_id", "row").orderBy("at")
    spans = events.select("scene_id", "row", F.sum("above").over(line).alias("above"), F.sum("below").over(line).alias("below"), "at", (F.lead("at").over(line) - 1).alias("to"))
    sides = spans.filter("above <> below").select("scene_id", "row", F.explode(F.sequence("at", "to")).alias("col"), "above")
    here, before = [side(row, col, _LEFT), side(row, col - 1, _RIGHT)], F.col("above") > 0
    across = sides.select("scene_id", (2 * row + 1).alias("y"), (2 * col).alias("x"), F.when(before, here[1]).otherwise(here[0]).alias("enters"), F.when(before, here[0]).otherwise(here[1]).alias("leaves"))
    return up.unionByName(down).unionByName(across)


def successors(points: DataFrame, join_high: bool = False) -> DataFrame:
    """``scene_id, point, next`` (structs y, x). Where two true cells of a square meet at a corner only, the outline passes between them
    and around each, or with ``join_high`` around both. A square has four points at most."""
    point = F.struct("y", "x")
    both = points.select("scene_id", "enters.i", "enters.j", F.struct(F.col("enters.edge").alias("edge"), point.alias("point")).alias("entry"), F.lit(None).cast("struct<edge:int,point:struct<y:bigint,x:bigint>>").alias("exit"))
    both = both.unionByName(points.select("scene_id", "leaves.i", "leaves.j", F.lit(None).cast("struct<edge:int,point:struct<y:bigint,x:bigint>>").alias("entry"), F.struct(F.col("leaves.edge").alias("edge"), point.alias("point")).alias("exit")))
    squares = both.groupBy("scene_id", "i", "j").agg(F.collect_list("entry").alias("entries"), F.collect_list("exit").alias("exits")).withColumn("entry", F.explode("entries"))
    beside = F.filter("exits", lambda e: (F.size("exits") == 1) | (e["edge"] == (F.col("entry.edge") + (1 if join_high else 3)) % 4))
    return squares.select("scene_id", F.col("entry.point").alias("point"), beside[0]["point"].alias("next"))


def ranked_rings(links: DataFrame) -> DataFrame:
    """``scene_id, ring, point, position, length`` of a permutation ``scene_id, point, next``: ``ring`` is the least point of a cycle, and
    ``position`` counts from 0 there.

    Pointer doubling: each point knows the least of the next 1, 2, 4, ... points and how far it is, until a step changes no
    least. The steps grow with the logarithm of the longest cycle; every step is one join of points by equality."""
    state, seen = write_shared(links.select("scene_id", "point", F.col("next").alias("to"), F.col("point").alias("least"), F.lit(0).cast("long").alias("ahead")), "rings"), None
    span = 1
    while True:
        sign = state.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(scene_id, point, least))")).first()
        if sign == seen:
            break
        seen = sign
        far = state.select("scene_id", F.col("point").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"), (F.col("ahead") + span).alias("_ahead"))
        both, nearer = state.join(far, ["scene_id", "to"]), F.col("least") <= F.col("_least")
        step = both.select("scene_id", "point", F.col("_to").alias("to"), F.when(nearer, F.col("least")).otherwise(F.col("_least")).alias("least"), F.when(nearer, F.col("ahead")).otherwise(F.col("_ahead")).alias("ahead"))
        last, state, span = state, write_shared(step, "rings"), 2 * span
        discard(last)
    sizes = write_shared(state.groupBy("scene_id", "least").agg(F.count(F.lit(1)).alias("length")), "ring-sizes")
    placed = state.join(sizes, ["scene_id", "least"])
    return placed.select("scene_id", F.col("least").alias("ring"), "point", ((F.col("length") - F.col("ahead")) % F.col("length")).alias("position"), "length")


def contours(mask: DataFrame, join_high: bool = False) -> DataFrame:
    """The outline of a mask (scene_id, row, col): ``scene_id, ring_row, ring_col, position, row, col, length`` of every point, rings named by
    their first point. Rings are closed: the last point is followed by the first. Cells may repeat; an empty mask has no ring."""
    rings = ranked_rings(successors(crossings(mask), join_high))
    half = lambda c: F.col(c) / 2.0
    return rings.select("scene_id", half("ring.y").alias("ring_row"), half("ring.x").alias("ring_col"), "position", half("point.y").alias("row"), half("point.x").alias("col"), "length")


RING = ["scene_id", "ring_row", "ring_col"]


def visible_parts(outline: DataFrame, occlusion: DataFrame, scenes: DataFrame) -> DataFrame:
    """``outline`` without what a mask hides: ``scene_id, ring_row, ring_col, part, position, row, col``; a ring that nothing hides is one closed
    part, others fall into parts between hidden points, past a ring's first point too. Parts of one point are left out.

    A point is hidden where the mask holds the cell nearest to it (halves to even numbers, within the scene). Points are
    ranked by a range sort, all and the visible ones, and the difference tells parts apart: no ring meets in one task.
    """
    near = outline.join(scenes.select("scene_id", "height", "width"), "scene_id")

    def cell(c: str, size: str):
        return F.least(F.greatest(F.rint(c).cast("long"), F.lit(0).cast("long")), F.col(size) - 1)

    hidden = occlusion.select(CELL).distinct().select("scene_id", F.col("row").alias("_r"), F.col("col").alias("_c"), F.lit(True).alias("_hit"))
    marked = near.select(*RING, "position", "row", "col", "length", cell("row", "height").alias("_r"), cell("col", "width").alias("_c")).join(hidden, ["scene_id", "_r", "_c"], "left")
    order = [*RING, "position"]
    every = write_shared(ranked(marked.select(*order, "row", "col", "length", F.coalesce("_hit", F.lit(False)).alias("hidden")), order).withColumnRenamed("_rank", "all"), "outline")
    seen = ranked(every.filter("not hidden"), order).withColumn("before", F.col("all") - F.col("_rank")).drop("_rank", "hidden")
    gone = ranked(every.filter("hidden"), order).select(*RING, F.col("_rank").alias("before"))
    rings = gone.groupBy(*RING).agg(F.min("before").alias("_first"), F.count(F.lit(1)).alias("_hidden"))
    parts = seen.join(rings, RING, "left").withColumn("_part", F.coalesce(F.col("before") - F.col("_first"), F.lit(0)))
    wrapped = F.col("_hidden").isNotNull() & (F.col("_part") == F.col("_hidden"))
    parts = parts.select(*RING, F.when(wrapped, 0).otherwise(F.col("_part")).alias("part"), F.when(wrapped, F.col("position") - F.col("length")).otherwise(F.col("position")).alias("position"), "row", "col")
    parts = write_shared(parts, "parts")
    long_enough = parts.groupBy(*RING, "part").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return parts.join(long_enough, [*RING, "part"])
