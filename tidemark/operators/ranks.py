"""Positions and quantiles by range sorts: no group, and not the table, ever meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import write_shared


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Written, with ``_rank`` (from 0) of each row by ``order``: a range sort numbers the rows of a partition, and the sizes of
    the partitions before it, one row each, do the rest. Ties get different ranks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = write_shared(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_number", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("_number", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = numbered.withColumn("_part", part).join(F.broadcast(before), "_part")  # a row a partition
    return placed.withColumn("_rank", F.col("_before") + F.col("_number").bitwiseAND((1 << 33) - 1)).drop("_part", "_number", "_before")


def global_positions(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``position`` (from 1) of each row in its group (null keys are a group of their own) by ``order``."""
    placed = ranked(rows, [*group, *order])
    keys = [f"_group{i}" for i in range(len(group))]
    first = write_shared(placed.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)]).agg(F.min("_rank").alias("_first")), "groups")
    same = [placed[g].eqNullSafe(first[k]) for g, k in zip(group, keys, strict=True)]
    return placed.join(first, same).withColumn("position", F.col("_rank") - F.col("_first") + 1).drop("_rank", "_first", *keys)
