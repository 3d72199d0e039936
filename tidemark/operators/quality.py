"""Quality of masks against a truth: counts a unit, intervals by a seeded Poisson bootstrap, rank correlation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked

CELL = ["scene_id", "row", "col"]
_PRIME = 2_147_483_647
#: Chances that a Poisson variable of mean 1 is at most 0, 1, 2, ...
_AT_MOST = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]


def confusion(found: DataFrame, truth: DataFrame, unit: list[str]) -> DataFrame:
    """``unit, tp, fp, fn`` from two masks; cells may repeat."""
    both = found.select(*CELL).distinct().withColumn("p", F.lit(1)).join(truth.select(*CELL).distinct().withColumn("t", F.lit(1)), CELL, "full_outer")
    hit = F.col("p").isNotNull() & F.col("t").isNotNull()
    return both.groupBy(*unit).agg(F.count_if(hit).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def _uniform(unit: Column, replicate: Column, seed: int) -> Column:
    """From 0 to below 1, by integer arithmetic alone, so that every engine gives the same."""
    h = F.pmod(F.pmod(unit, F.lit(_PRIME)) * 48_271 + replicate * 69_621 + seed, F.lit(_PRIME))
    for add in (12_345, 678_901):
        h = (h * h + add + replicate) % _PRIME
    return h / float(_PRIME)


def poisson_weight(unit: Column, replicate: Column, seed: int) -> Column:
    """How often a unit (an integer) is in a replicate."""
    u, out = _uniform(unit.cast("long"), replicate.cast("long"), seed), F.lit(len(_AT_MOST))
    for k in range(len(_AT_MOST) - 1, -1, -1):
        out = F.when(u < round(_AT_MOST[k], 7), k).otherwise(out)
    return out


def ratios(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    share = lambda a, b: F.when(b > 0, a / b)
    return {"iou": share(tp, tp + fp + fn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn)}


def quality_intervals(units: DataFrame, unit: str, replicates: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """``measure, value, low, high`` of IoU, precision and recall over all units (unit, tp, fp, fn; one row each).

    One aggregation makes all replicates: each unit has a Poisson weight in each, so sums are combined where the units are and
    ``replicates`` rows are shuffled a task. Replicates without a value are left out; no units: null values.
    """
    sums = [F.sum(F.col("_w") * F.col(c)).alias(c) for c in ("tp", "fp", "fn")]
    drawn = units.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", poisson_weight(F.col(unit), F.col("_r"), seed))
    names = ("iou", "precision", "recall")
    of = ratios(F.col("tp"), F.col("fp"), F.col("fn"))
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), of[n].alias("value")) for n in names])).alias("m")
    edges = F.percentile("value", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    spread = drawn.groupBy("_r").agg(*sums).select(listed).select("m.*").groupBy("measure").agg(edges.alias("e"))
    whole = units.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select(listed).select("m.*")
    return whole.join(spread, "measure", "left").select("measure", F.round("value", 6).alias("value"), F.round(F.col("e")[0], 6).alias("low"), F.round(F.col("e")[1], 6).alias("high"))


def mean_ranks(rows: DataFrame, value: str, rank: str) -> DataFrame:
    """``rows`` (without nulls in ``value``) with the rank of its value, ties sharing the mean of theirs: a range sort gives ranks, and an
    aggregation by value the means."""
    placed = ranked(rows, [value]).withColumnRenamed("_rank", "_place")
    means = placed.groupBy(F.col(value).alias("_value")).agg(F.avg(F.col("_place") + 1.0).alias(rank))
    return placed.join(means, placed[value] == means["_value"]).drop("_value", "_place")


def rank_correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row with ``n`` and ``rank_correlation`` of two columns (rows with a null in either are left out): the correlation of mean ranks,
    null where one of them is constant."""
    both = rows.select(F.col(x).alias("_x"), F.col(y).alias("_y")).filter("_x is not null and _y is not null")
    placed = mean_ranks(mean_ranks(both, "_x", "_rx"), "_y", "_ry")
    sums = placed.agg(F.count(F.lit(1)).alias("n"), F.covar_pop("_rx", "_ry").alias("_c"), (F.stddev_pop("_rx") * F.stddev_pop("_ry")).alias("_s"))
    return sums.select("n", F.when(F.col("_s") > 0, F.round(F.col("_c") / F.col("_s"), 6)).alias("rank_correlation"))
