"""Stages of the corpus pipeline: what they keep, and odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import order_minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def line(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.choice('xyz')}{rng.randrange(300)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A corpus whose right answer is known: clean texts, copies, near copies, toxic texts, texts without letters."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        words = line(rng, 80).split()
        if i % 6 == 0:
            for _ in range(5):
                words.insert(rng.randrange(80), rng.choice(["vilefoo", "vilebar", "vilebaz"]))
        rows.append((i, " ".join(words), "en" if i % 2 else "de", "s", 1))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000 + i, rows[i][1], "en", "s", 1) for i in (1, 2, 3)]
    near = rows[7][1].split()
    near[30] = "other"
    rows += [(2000, " ".join(near), "en", "s", 1), (2001, "12 34 !", "en", "s", 1), (2002, None, None, None, None), (2003, "", "en", "s", 1)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}", rows


def test_stages_keep_what_they_should(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = STAGES["toxicity"](spark, docs, folder)
    ids = {r[0] for r in kept.select("doc_id").collect()}
    toxic = {i for i in range(300) if i % 6 == 0}
    assert len(ids & toxic) <= 3 and len({r[0] for r in rows} - toxic - ids) <= 3
    kept = STAGES["language_id"](spark, docs, folder)
    assert {r[0] for r in rows} - {r[0] for r in kept.select("doc_id").collect()} == {2001, 2002, 2003}
    kept = STAGES["exact_dedup"](spark, docs, folder)
    assert {r[0] for r in rows} - {r[0] for r in kept.select("doc_id").collect()} == {1001, 1002, 1003, 2003}
    kept = STAGES["near_dedup"](spark, docs, folder)
    kmers = {i: order_minhash.labelled_kmers(order_minhash.word_hashes(t)) for i, t, *_ in rows}
    first = {i: min([j for j in kmers if order_minhash.aligned(kmers[i], kmers[j])], default=i) for i in kmers}
    assert {r[0] for r in kept.select("doc_id").collect()} == {i for i in kmers if first[i] == i} - {2003}  # the null text comes first
    for name in ("toxicity", "language_id", "exact_dedup", "near_dedup"):
        assert STAGES[name](spark, docs, folder).columns == docs.columns


def test_run_applies_all_stages(spark, corpus):
    folder, rows = corpus
    pieces = corpus_pipeline.run(spark, folder).collect()
    ids = {p["doc_id"] for p in pieces}
    assert not ids & {1001, 1002, 1003, 2000, 2001, 2002, 2003} and len(ids & {i for i in range(300) if i % 6}) >= 247
    assert all(p["offset"] + p["length"] <= 1024 for p in pieces)


def test_odd_tables(spark, corpus):
    folder, _ = corpus
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "x", None, None, None), (1, "x", None, None, None), (2, "word " * 30_000, "en", "s", 0), (3, "", "en", "s", 0)], DOCS).withColumn("score", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd, folder).count()
        assert stage(spark, odd.limit(0), folder).count() == 0, name
