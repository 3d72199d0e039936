"""The approximation file: bounds hold, few exact vectors are read, and repeated vectors don't pile up."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import vafile_topk


def test_bounds_hold():
    rng = np.random.default_rng(4)
    vectors, queries = rng.integers(-4000, 4000, (500, 24)).astype(float), rng.integers(-4000, 4000, (9, 24)).astype(float)
    cells, low, step = vafile_topk.quantised(vectors)
    upper, width = vafile_topk.bounds(queries, cells, low, step)
    exact = queries @ vectors.T
    assert cells.dtype == np.uint8 and (exact <= upper).all() and (exact >= upper - width[:, None]).all() and width.max() < np.abs(exact).max() / 10


def test_dominated_vectors_are_left_out():
    ids = np.array([5, 3, 9, 9, 9, 1, 7, 2, 4])
    vectors = np.ones((9, 2))
    assert sorted(ids[vafile_topk.undominated(ids, vectors, 3)]) == [1, 2, 3, 4]
    assert len(vafile_topk.undominated(np.full(9, 6), vectors, 3)) == 9 and len(vafile_topk.undominated(ids, np.arange(18.0).reshape(9, 2), 3)) == 9


def test_few_exact_vectors_are_read(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    _, asking, able = vafile_topk.survivors(rows, F.col("vec_id") % 100 == 0, 10, "vec_id", "embedding", 1024, 512)
    assert asking.count() == 20 and able.count() < 0.1 * 20 * rows.count()


def test_one_very_common_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0] * 6 if i % 3 else rng.normal(size=6).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    _, _, able = vafile_topk.survivors(df, F.col("vec_id") % 100 == 0, 10, "vec_id", "embedding", 1024, 512)
    assert able.groupBy("query_id").count().agg(F.max("count")).first()[0] < 400
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vafile_topk.top_k(df, F.col("vec_id") % 100 == 0).collect()}
    ints = np.floor(1024 * np.array([v for _, v in rows]))
    for q in range(0, 3000, 100):
        order = sorted((-int(s), i) for i, s in enumerate(ints @ ints[q]) if i != q)[:10]
        assert [got[q, k + 1] for k in range(10)] == [i for _, i in order]


def test_queries_are_told_by_bytes(spark, monkeypatch):
    """200 blocks from 4 partitions: no lot exceeds its bytes by more than one block, and results don't change."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist() if i % 5 else rng.normal(size=3).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = vafile_topk.integer_vectors(df).groupBy("id").agg(F.min("v").alias("v"))
    blocks = vafile_topk._query_blocks(asked, 4)
    n, limit = blocks.count(), 2000
    lots = vafile_topk.query_lots(blocks, limit)
    sizes = blocks.join(lots, ["part", "number"]).groupBy("lot").agg(F.sum(F.octet_length("queries") + F.octet_length("asking")).alias("bytes")).collect()
    largest = 8 * 8 * 9  # of blocks of 4 to 8 queries
    assert n >= 200 and lots.count() == n and max(r["bytes"] for r in sizes) <= limit + largest and len(sizes) > 20
    told = []
    plain = vafile_topk.bounded
    monkeypatch.setattr(vafile_topk, "LOT_BYTES", 4000)
    monkeypatch.setattr(vafile_topk, "query_lots", lambda b, lot_bytes=4000, make=vafile_topk.query_lots: make(b, lot_bytes))
    monkeypatch.setattr(vafile_topk, "bounded", lambda file, some, k: (told.append(sum(len(a) + len(q) for _, a, q in some)), plain(file, some, k))[1])
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vafile_topk.top_k(df, F.col("vec_id") % 4 == 0, query_block=4).collect()}
    assert len(told) > 3 and max(told) <= 4000 + largest
    for q in range(0, 1200, 4):
        v = np.floor(1024 * np.array(rows[q][1]))
        order = sorted((-int(np.floor(1024 * np.array(x)) @ v), i) for i, x in rows if i != q and len(x) == len(v))[:10]
        assert [got[q, k + 1] for k in range(10)] == [i for _, i in order]
