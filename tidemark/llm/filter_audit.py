"""How quality filters interact: what each removes in each order of application, from relations of failing ids."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import materialise, shared_key_lookup

FILTERS = "ABCDE"
WORD_GAP = r"[\x20\x09-\x0D]+"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
SYMBOLS = r"[#$%&*|]"


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text (null: empty) fails the four filters that look at it alone."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, WORD_GAP), lambda w: w != "")
    capitals = F.length(whole) - F.length(F.regexp_replace(whole, "[A-Z]+", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * MIN_DISTINCT_PERCENT,
        "C": capitals * 100 > F.length(whole) * MAX_CAPITAL_PERCENT,
        "D": whole.rlike(SYMBOLS),
    }


def failing_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> tuple[DataFrame, dict[str, DataFrame]]:
    """``(rows, fails)``: ``rows(_row, _id, part)`` with a number of its own for each row of ``docs``, and for each filter a table
    of the ``_row`` that fail it. One pass reads the texts.

    Null text counts as empty, a null part as the empty string. Rows are told apart by number, so ids may be null or repeat. E
    fails rows whose text a row of a smaller id has; a null id is neither smaller nor greater than any. Empty table: empty tables.
    """
    text = F.col(f"`{text_col}`")
    flags = text_failures(text)
    facts = materialise(
        docs.select(
            F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
            F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256).alias("_sha"), *[flag.alias(name) for name, flag in flags.items()],
        ), "audit-facts",
    )
    fails = {name: materialise(facts.filter(F.col(name)).select("_row"), f"audit-fails-{name}") for name in flags}
    repeated = materialise(facts.groupBy("_sha").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "audit-repeated")
    later = shared_key_lookup(facts.select("_row", "_id", "_sha"), repeated, ["_sha"], "_n").filter("_id > _first")
    fails["E"] = materialise(later.select("_row"), "audit-fails-E")
    return facts.select("_row", "_id", "part"), fails


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """``rows(_row, part, good, toxic)``, written. Where labels repeat an id, any label of 1 counts; null ids have none."""
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_label"))
    known = known.agg(F.max(F.when(F.col(quality_col) == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col(toxic_col) == 1, 1).otherwise(0)).alias("toxic"))
    some = rows.filter("_id is not null").join(known, F.col("_id") == F.col("_label"), "left").select("_row", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return materialise(some.unionByName(rows.filter("_id is null").select("_row", "part", F.lit(0).alias("good"), F.lit(0).alias("toxic"))), "audit-rows")


def prefix_effects(rows: DataFrame, fails: dict[str, DataFrame]) -> DataFrame:
    """What each filter does after each set of filters before it: ``part, before, filter, kept, removed, good_lost, toxic_lost``
    for every part, filter and set ``before`` of other filters (a bit a filter, the first filter lowest).

    Survivors don't depend on the order within a prefix, so 2^n sets stand for n! orders. ``rows(_row, part, good, toxic)`` that
    fail nothing (a left-anti join) survive every prefix and are only counted. For the others, each level of the lattice is a
    relation of (set, row): every survivor meets every filter not yet applied; the failing-id relation's **left-semi** join
    gives the removals, its **left-anti** join the survivors of the next level. Rows meet by hash of (filter, row), so neither
    a large part nor a filter that fails most rows is a key of its own.
    """
    names = list(fails)
    failing = None
    for bit, name in enumerate(names):
        of = fails[name].select("_row", F.lit(1 << bit).alias("_bit"))
        failing = of if failing is None else failing.unionByName(of)
    touched = failing.select("_row").distinct()
    clean = rows.join(touched, "_row", "left_anti").groupBy("part").agg(F.count(F.lit(1)).alias("_clean"))
    level = materialise(rows.join(touched, "_row", "left_semi").withColumn("before", F.lit(0)), "audit-level")
    removed, survivors = None, None
    every_bit = F.array(*[F.lit(1 << b) for b in range(len(names))])
    for depth in range(len(names)):
        tried = level.withColumn("_bit", F.explode(F.filter(every_bit, lambda b: F.col("before").bitwiseAND(b) == 0)))
        gone = tried.join(failing, ["_row", "_bit"], "left_semi").groupBy("part", "before", "_bit")
        gone = materialise(gone.agg(F.count(F.lit(1)).alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost")), "audit-removed")
        alive = materialise(level.groupBy("part", "before").agg(F.count(F.lit(1)).alias("_alive")), "audit-alive")
        removed, survivors = (gone, alive) if removed is None else (removed.unionByName(gone), survivors.unionByName(alive))
        if depth + 1 < len(names):  # each set is reached once, by its filters in order
            onward = tried.filter("before < _bit").join(failing, ["_row", "_bit"], "left_anti")
            level = materialise(onward.withColumn("before", F.col("before") + F.col("_bit")).drop("_bit"), "audit-level")
    steps = [(s, 1 << b) for s in range(1 << len(names)) for b in range(len(names)) if not s >> b & 1]
    every = F.array(*[F.struct(F.lit(s).alias("before"), F.lit(b).alias("_bit")) for s, b in steps])
    grid = rows.groupBy("part").agg(F.count(F.lit(1)).alias("_all")).join(clean, "part", "left").withColumn("_step", F.explode(every)).select("part", F.coalesce("_clean", F.lit(0)).alias("_clean"), "_step.*")
    full = grid.join(survivors, ["part", "before"], "left").join(removed, ["part", "before", "_bit"], "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("_alive", "removed", "good_lost", "toxic_lost")}
    full = full.withColumns(zero)
    name_of = F.create_map(*[F.lit(x) for bit, name in enumerate(names) for x in (1 << bit, name)])[F.col("_bit")]
    return full.select("part", "before", name_of.alias("filter"), (F.col("_clean") + F.col("_alive") - F.col("removed")).alias("kept"), "removed", "good_lost", "toxic_lost")


def audit(rows: DataFrame, fails: dict[str, DataFrame]) -> DataFrame:
    """One row per part, order of the filters and step: ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``, zeros included. A part's rows number n! * n, whatever its size; an empty table has none.

    A filter's ``redundant`` rows fail it but went earlier; its ``unique_fails`` are what it removes after all the others;
    ``shapley`` sums its removals over all orders.
    """
    names = list(fails)
    n, bit = len(names), {name: 1 << i for i, name in enumerate(names)}
    effects = materialise(prefix_effects(rows, fails), "audit-effects")
    last = (1 << n) - 1
    bits = F.create_map(*[F.lit(x) for name in names for x in (name, bit[name])])
    orders_through = F.element_at(F.array(*[F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n)]), F.bit_count("before") + 1)
    totals = effects.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed")).otherwise(0)).alias("_fails"),
        F.sum(F.when(F.col("before") + bits[F.col("filter")] == last, F.col("removed")).otherwise(0)).alias("unique_fails"),
        F.sum(F.col("removed") * orders_through).alias("shapley"),
    )
    plan = [("".join(order), at + 1, name, sum(bit[x] for x in order[:at])) for order in permutations(names) for at, name in enumerate(order)]
    steps = rows.sparkSession.createDataFrame(plan, "filter_order string, step int, filter string, before int")
    return (
        effects.join(totals, ["part", "filter"]).join(F.broadcast(steps), ["filter", "before"])  # n! * n rows
        .select("part", "filter_order", "step", "kept", "removed", (F.col("_fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", F.col("shapley").cast("long").alias("shapley"))
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over whole ``documents``, by source, with the losses of good and toxic labels."""
    rows, fails = failing_rows(docs)
    return audit(labelled(rows, labels), fails)
