"""Connected components of an edge relation by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard


def _with_least(edges: DataFrame) -> DataFrame:
    """Each directed edge (u, v) with m, the least of u and all that u points to."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m"))
    return edges.join(least, "u").select("u", "v", F.least("u", "_m").alias("m"))


def connected_components(edges: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``node, component`` for each node of ``edges`` (two columns of one orderable type); a component is named by its least node.

    Loops, repeats and null ends don't matter; no edge gives no row. ``write`` stores a step's result where all executors can
    read it and gives it back, which cuts the lineage; a step's table goes when the next one is written. The number of steps
    grows with the square of the logarithm at most.
    """
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    state, seen = write(pairs), None
    while True:
        sign = state.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        labels = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        if not sign[0]:
            return labels
        if sign == seen:
            return labels.union(state.select("v", "v").distinct())
        seen = sign
        both = state.union(state.select("v", "u"))
        large = write(_with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        small = _with_least(large)
        last, state = state, write(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        discard(last)
        discard(large)
