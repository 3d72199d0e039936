"""Quotation linking: conversations from messages that quote each other.

A passage is a line; its quote level is the number of `>` before it. Passages are normalised and hashed, quoted ones are
joined to the first message of their thread that says them itself, and replies follow from these links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import global_positions
from .support import materialise

_MARKS = r"^[ \t]*((?:>[ \t]?)+)"


def _lines(text: str) -> Column:
    return F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n"), "\n")


def _unquoted(text: str) -> Column:
    """The text without quoted lines, and without blank space around it."""
    return F.regexp_replace(F.array_join(F.filter(_lines(text), lambda x: ~x.rlike(_MARKS)), "\n"), r"^\s+|\s+$", "")


def passages(messages: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key, level, hash`` of each line that is not blank. Equal but for case and white space means equal."""
    line = F.col("_line")
    level = F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, _MARKS, ""), r"\s+", " ")))
    rows = messages.select(*key, F.explode(_lines(text)).alias("_line")).select(*key, level.alias("level"), plain.alias("_plain"))
    return rows.filter("_plain <> ''").select(*key, "level", F.md5("_plain").alias("hash"))


def reply_roots(replies: DataFrame) -> DataFrame:
    """``_t, _o, _root``: the first ancestor of each reply (_t, _o, parent). Parents are earlier, so pointers only lead up; each
    step doubles how far those reach that are not at their root yet, and leaves the others as they are, so a chain of n replies
    takes log2(n) steps."""
    active, done = materialise(replies.select("_t", "_o", F.col("parent").alias("_up")), "quote-roots"), []
    while True:
        above = active
        for one in done:
            above = above.union(one)
        above = above.select("_t", F.col("_o").alias("_up"), F.col("_up").alias("_next"))
        moved = materialise(active.join(above, ["_t", "_up"], "left").select("_t", "_o", F.coalesce("_next", "_up").alias("_up"), F.col("_next").isNotNull().alias("_moved")), "quote-roots")
        done.append(moved.filter("not _moved").drop("_moved"))
        active = moved.filter("_moved").drop("_moved")
        if not active.limit(1).count():
            roots = done[0]
            for one in done[1:]:
                roots = roots.union(one)
            return roots.withColumnRenamed("_up", "_root")


def link_quotations(messages: DataFrame, thread: str, order: str, text: str = "text") -> DataFrame:
    """The columns of ``messages`` named here and ``body, parent, root, position, n_quoted, n_linked``.

    ``thread`` and ``order`` identify a message. ``body``: the message without quotes. ``parent``: order of the message that
    most of its passages of level 1 stem from (ties: the later one), null where none is found. ``root``: order of the first
    message above it; ``position``: its place among these by order, from 1. ``n_quoted``: its quoted
    passages of any level; ``n_linked``: those whose original was found.

    An original stands in an earlier message of the thread; of several the first counts, so a common passage has one. Null
    texts have no passages. Rows that repeat thread and order share their passages and get one row each. Null threads
    or orders link to nothing and have no root. Other columns are ignored; an empty table gives no rows.
    """
    rows = messages.select(F.col(thread).alias("_t"), F.col(order).alias("_o"), F.col(text).alias("_text"))
    lines = materialise(passages(rows.filter("_t is not null and _o is not null"), ["_t", "_o"], "_text"), "quote-passages")
    said = lines.filter("level = 0").groupBy("_t", "hash").agg(F.min("_o").alias("_first"))
    quoted = lines.filter("level > 0").groupBy("_t", "_o", "level", "hash").agg(F.count(F.lit(1)).alias("_n"))
    found = quoted.join(said, ["_t", "hash"], "left").withColumn("_first", F.when(F.col("_first") < F.col("_o"), F.col("_first")))
    found = found.groupBy("_t", "_o", "level", "_first").agg(F.sum("_n").alias("_n"))
    linked = F.when(F.col("_first").isNotNull(), F.col("_n")).otherwise(0)
    best = F.max(F.when((F.col("level") == 1) & F.col("_first").isNotNull(), F.struct("_n", "_first")))
    known = found.groupBy("_t", "_o").agg(F.sum("_n").alias("n_quoted"), F.sum(linked).alias("n_linked"), best.alias("_best"))
    known = materialise(known.select("_t", "_o", "n_quoted", "n_linked", F.col("_best._first").alias("parent")), "quote-replies")
    known = known.join(reply_roots(known.filter("parent is not null")), ["_t", "_o"], "left")
    whole = rows.select("_t", "_o", _unquoted("_text").alias("body")).join(known, ["_t", "_o"], "left")
    root = F.when(F.col("_t").isNotNull(), F.coalesce("_root", "_o"))
    placed = global_positions(materialise(whole.withColumn("root", root).drop("_root"), "quote-messages"), ["_t", "root"], ["_o", "body"])
    return placed.select(
        F.col("_t").alias(thread), F.col("_o").alias(order), "body", "parent", "root", "position", F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")
    )


def as_mail(conversations: DataFrame) -> DataFrame:
    """Every row as a mail: it quotes the turn before, and that turn's own quotation of the one before it, above its own text.
    A turn that several rows share is quoted by its least text. Rows without conversation or turn quote nothing."""
    rows = conversations.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    turn = materialise(rows.filter(placed).groupBy("conv_id", "turn").agg(F.min("text").alias("text")), "quote-turns")

    def earlier(by: int, mark: str) -> DataFrame:
        quoted = F.concat(F.regexp_replace(F.concat(F.lit("\n"), "text"), "\n", f"\n{mark}"), F.lit("\n"))
        return turn.select("conv_id", (F.col("turn") + by).alias("turn"), quoted.alias(f"_q{by}"))

    both = rows.filter(placed).join(earlier(1, "> "), ["conv_id", "turn"], "left").join(earlier(2, "> > "), ["conv_id", "turn"], "left")
    mails = both.select("conv_id", "turn", F.concat(F.coalesce("_q2", F.lit("")), F.coalesce("_q1", F.lit("")), "text").alias("text"))
    return mails.union(rows.filter(~placed))
