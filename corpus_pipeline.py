"""A corpus pipeline of five stages: toxicity, language, exact copies, near copies, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.ecoc_langid import keep_identified
from tidemark.llm.exact_dedup import drop_exact_duplicates
from tidemark.llm.order_minhash import drop_near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.support import discard, scratch, scratch_path, table, tokenizer_file
from tidemark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted toxic; all columns stay."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of undetermined language; all columns stay."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all but the first of equal texts; all columns stay."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all but the first of each class of near copies; all columns stay."""
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences that the documents are packed into."""
    return pack(docs, tokenizer_file("byte_bpe_50k.json"))


#: In order: name and function of (spark, docs, sf_dir).
STAGES = [("toxicity", toxicity), ("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: SQL can't express the classifiers, the sketches or the tokenizer; tests hold each stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; each result is written and read again as the next stage's input. What a stage writes on its way,
    and its input, go when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        last, docs = docs, spark.read.schema(docs.schema).parquet(path)
        docs._scratch = path
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
