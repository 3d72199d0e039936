"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import broadcast_if_small, materialise, numbered_rows

#: Characters of the normalised text that the second level hashes.
PREFIX_CHARS = 256


def normalised(text: str = "text") -> Column:
    """Null as empty; each run of blank, tab, line feed, vertical tab, form feed or carriage return as one blank."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def full_hash(text: str = "text") -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs again. The counts are combined before the shuffle and written, so that the join back is a
    plain join of two scans, whose hot keys Spark's adaptive execution splits."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys)
    return rows.join(materialise(counts, "dedup-keys"), keys, "left_semi")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row for each row that has equals: ``id, keep_id, group_size, text_sha256``; others are unique by proof.

    Level 1 keeps lengths that occur twice, level 2 pairs of length and prefix hash that occur twice; only rows that
    survive both have their full text read again and hashed. Null text equals the empty text. Ties and repeated rows:
    ``keep_id`` is the smallest id of the group; rows that repeat an id count as rows. A null id takes part but is never
    smallest (``keep_id`` is null where no row of the group has an id). Other columns are ignored. An empty table gives no rows.
    """
    text = normalised(text_col)
    narrow = materialise(
        docs.select(F.col(id_col).alias("_id"), F.length(text).alias("_len"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_prefix")), "dedup-narrow"
    )
    survivors = materialise(_repeated(_repeated(narrow, ["_len"]), ["_len", "_prefix"]).select("_id").distinct(), "dedup-survivors")
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    hashed = materialise(
        read.join(broadcast_if_small(survivors), read["_id"].eqNullSafe(survivors["_id"]), "left_semi").select("_id", full_hash("_text").alias("text_sha256")), "dedup-hashes"
    )
    groups = materialise(hashed.groupBy("text_sha256").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"), "dedup-groups")
    return hashed.join(groups, "text_sha256").select(F.col("_id").alias(id_col), "keep_id", "group_size", "text_sha256")


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: ``id, keep_id, group_size, kept, text_sha256``. A unique text keeps itself in a group of one.

    Rows that repeat both id and text count in ``group_size`` and share one fate, as the id can't tell them apart. A row
    with a null id is kept only where no row of its group has an id.
    """
    groups = exact_duplicates(docs, id_col, text_col).distinct().withColumnsRenamed({id_col: "_gid", "text_sha256": "_sha"})
    every = docs.select(F.col(id_col), full_hash(text_col).alias("text_sha256"))
    keep = F.coalesce("keep_id", id_col)
    return every.join(groups, every[id_col].eqNullSafe(groups["_gid"]) & (every["text_sha256"] == groups["_sha"]), "left").select(
        id_col, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col(id_col).eqNullSafe(keep).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equals, that of the smallest id (null ids come last); all columns stay as they
    are. Rows are told apart even where ids are null or repeat: one row of equal id and text stays."""
    rows = numbered_rows(docs, id_col, text_col)
    if rows is not None:
        return drop_exact_duplicates(rows, "_row", "_text").select("_doc.*")
    gone = materialise(exact_duplicates(docs, id_col, text_col).filter(F.col(id_col) != F.col("keep_id")).select(F.col(id_col).alias("_gone")).distinct(), "dedup-gone")
    return docs.join(broadcast_if_small(gone), docs[id_col] == gone["_gone"], "left_anti")
