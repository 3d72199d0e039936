"""Connected components of masks, by runs: local union in bounded blocks, then stars over the blocks' borders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .ranks import global_positions
from .morphology import cells_of, runs_of
from .shared import write_shared

#: Edge of the square blocks that one task labels at a time.
BLOCK = 1024


def cut_runs(runs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Runs cut at the block borders that they cross."""
    pieces = runs.withColumn("_x", F.explode(F.sequence(F.floor(F.col("c0") / block), F.floor(F.col("c1") / block))))
    return pieces.select("scene_id", "row", F.greatest("c0", F.col("_x") * block).alias("c0"), F.least("c1", F.col("_x") * block + (block - 1)).alias("c1"))


def _label_block(reach: int):
    def label(block: pd.DataFrame) -> pd.DataFrame:
        """The first run, by row and column, of each component of the block."""
        b = block.sort_values(["row", "c0"], ignore_index=True)
        row, c0, c1 = b["row"].to_numpy(), b["c0"].to_numpy(), b["c1"].to_numpy()
        root = list(range(len(b)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        begins = np.searchsorted(row, row - 1, "left")
        ends = np.searchsorted(row, row - 1, "right")
        at = last = -1
        for i in range(len(b)):
            at = begins[i] if row[i] != last else max(at, begins[i])
            last = row[i]
            while at < ends[i] and c1[at] < c0[i] - reach:
                at += 1
            j = at
            while j < ends[i] and c0[j] <= c1[i] + reach:
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
                j += 1
        first = np.array([find(i) for i in range(len(b))], dtype=np.int64)
        return b.assign(first_row=row[first] if len(b) else row, first_col=c0[first] if len(b) else c0)[["scene_id", "row", "c0", "c1", "first_row", "first_col"]]

    return label


def labelled_runs(mask: DataFrame, connectivity: int = 2, block: int = BLOCK) -> DataFrame:
    return joined_runs(runs_of(mask), connectivity, block)


def joined_runs(runs: DataFrame, connectivity: int = 2, block: int = BLOCK) -> DataFrame:
    """Runs, cut at block borders, with the component they belong to, named by its first cell in row-major order:
    ``scene_id, row, c0, c1, first_row, first_col``. No group is larger than a block."""
    reach = 1 if connectivity == 2 else 0
    cut = cut_runs(runs, block).withColumns({"_y": F.floor(F.col("row") / block), "_x": F.floor(F.col("c0") / block)})
    schema = "scene_id string, row long, c0 long, c1 long, first_row long, first_col long"
    local = write_shared(cut.groupBy("scene_id", "_y", "_x").applyInPandas(_label_block(reach), schema))
    node = F.struct("scene_id", "first_row", "first_col")
    ends = local.select("scene_id", "row", "c0", "c1", node.alias("node"))
    lower = ends.filter(F.col("row") % block == 0).select("scene_id", F.col("row").alias("r"), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("node").alias("b"))
    upper = ends.filter((F.col("row") + 1) % block == 0).withColumn("r", F.col("row") + 1)
    down = upper.join(lower, ["scene_id", "r"]).filter((F.col("d0") <= F.col("c1") + reach) & (F.col("d1") >= F.col("c0") - reach)).select(F.col("node").alias("a"), "b")
    left = ends.filter(F.col("c0") % block == 0).select("scene_id", F.col("row").alias("r"), F.col("c0").alias("c"), F.col("node").alias("b"))
    step = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    right = ends.filter((F.col("c1") + 1) % block == 0).withColumn("_s", F.explode(step)).select("scene_id", (F.col("row") + F.col("_s")).alias("r"), (F.col("c1") + 1).alias("c"), F.col("node").alias("a"))
    across = right.join(left, ["scene_id", "r", "c"]).select("a", "b")
    borders = down.union(across)
    if not borders.take(1):
        return local
    names = connected_components(borders.distinct(), write_shared)
    joined = local.withColumn("node", node).join(names, "node", "left")
    return joined.select("scene_id", "row", "c0", "c1", F.coalesce("component.first_row", "first_row").alias("first_row"), F.coalesce("component.first_col", "first_col").alias("first_col"))


def sized(components: DataFrame) -> DataFrame:
    """``scene_id, first_row, first_col, n_pixels`` of each component."""
    return components.groupBy("scene_id", "first_row", "first_col").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n_pixels"))


def at_least(components: DataFrame, min_pixels: int) -> DataFrame:
    """Runs of the components with ``min_pixels`` cells or more."""
    return components.join(sized(components).filter(F.col("n_pixels") >= min_pixels).drop("n_pixels"), ["scene_id", "first_row", "first_col"])


def numbered(components: DataFrame) -> DataFrame:
    """Adds ``region_id`` from 1, in row-major order of first cells: places in a range sort of the components' names."""
    names = components.select("scene_id", "first_row", "first_col").distinct()
    ids = global_positions(names, ["scene_id"], ["first_row", "first_col"]).withColumnRenamed("position", "region_id")
    return components.join(ids, ["scene_id", "first_row", "first_col"])


def cells(components: DataFrame) -> DataFrame:
    """Runs back to cells, with all other columns."""
    return components.withColumn("col", F.explode(F.sequence("c0", "c1"))).drop("c0", "c1")


def label(mask: DataFrame, connectivity: int = 2, min_pixels: int = 1) -> DataFrame:
    """``scene_id, row, col, region_id`` of the cells of components that are large enough."""
    return cells(numbered(at_least(labelled_runs(mask, connectivity), min_pixels))).select("scene_id", "row", "col", "region_id")


def hole_runs(runs: DataFrame, scenes: DataFrame) -> DataFrame:
    """Runs of the 4-connected parts of the background that don't reach the scene's edge: ``scene_id, row, c0, c1``.

    Only the gaps between two runs of a row can be in a hole, so no more rows are made than there are runs. A gap is open where
    it lies in the first or last row or reaches beyond the outer runs of the row above or below, and so is all that joins it.
    """
    line = Window.partitionBy("scene_id", "row").orderBy("c0")
    gaps = runs.select("scene_id", "row", (F.col("c1") + 1).alias("c0"), (F.lead("c0").over(line) - 1).alias("c1")).filter("c1 is not null")
    ground = write_shared(joined_runs(gaps, connectivity=1), "gaps")
    outer = runs.groupBy("scene_id", "row").agg(F.min("c0").alias("_left"), F.max("c1").alias("_right"))
    around = outer.withColumn("row", F.explode(F.array(F.col("row") - 1, F.col("row") + 1))).groupBy("scene_id", "row")
    closed = around.agg(F.count(F.lit(1)).alias("_n"), F.max("_left").alias("_left"), F.min("_right").alias("_right"))  # rows between two that have runs
    beside = ground.join(scenes.select("scene_id", "height"), "scene_id").join(closed, ["scene_id", "row"], "left")
    within = (F.col("_n") == 2) & (F.col("c0") >= F.col("_left")) & (F.col("c1") <= F.col("_right")) & F.col("row").between(1, F.col("height") - 2)
    name = ["scene_id", "first_row", "first_col"]
    open_ = beside.filter(~F.coalesce(within, F.lit(False))).select(name).distinct()
    return ground.join(open_, name, "left_anti").select("scene_id", "row", "c0", "c1")


def holes_filled(mask: DataFrame, scenes: DataFrame) -> DataFrame:
    """The mask and its holes."""
    return mask.select("scene_id", "row", "col").union(cells_of(hole_runs(runs_of(mask), scenes)))
