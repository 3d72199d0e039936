"""Exact top-k inner products with vector-approximation files.

The approximation file holds each vector as cells of one byte a dimension, in chunks with their own grid. A scan of it bounds
every inner product; vectors whose upper bound is below the kth lower bound of a query are out. The others' exact vectors are
read in the order of their bounds: first the k best, then those that can still come in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import bounded_batches, broadcast_if_small, materialise

SCALE = 1024
CELLS = 256
#: Vectors of a chunk of the file, queries of a block, and bytes of blocks that are broadcast at once (besides the last block).
CHUNK, QUERY_BLOCK, LOT_BYTES = 4096, 512, 16 << 20


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id, v``: floor(scale * x) of each component; vectors that are null or hold null, NaN or infinity don't take part."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return rows.filter(x.isNotNull() & ~bad & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``cells`` (one byte a component), and ``low`` and ``step`` of their grid in each dimension."""
    low = vectors.min(0)
    step = np.maximum((vectors.max(0) - low) / CELLS, 1e-9)
    return np.minimum((vectors - low) // step, CELLS - 1).astype(np.uint8), low, step


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds (queries x vectors) of the inner products, and how far below them the lower bounds are."""
    spread = np.abs(queries) @ (step * (0.5 + 1e-9))
    centre = queries @ (low + (cells + 0.5) * step).T
    slack = 1e-9 * (np.abs(centre).max(initial=0.0) + spread.max(initial=0.0)) + 1e-6
    return centre + (spread + slack)[:, None], 2 * (spread + slack)


def undominated(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the vectors that can be among any query's k best: not those after k equal vectors of smaller ids, the query's
    own left out. So a vector that many rows hold is in a chunk a few times only."""
    _, group, sizes = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_inverse=True, return_counts=True)
    keep = np.ones(len(ids), bool)
    for g in np.flatnonzero(sizes > k + 1):
        own = np.flatnonzero(group == g)
        own = own[np.argsort(ids[own], kind="stable")]
        at = ids[own]
        begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        run = np.arange(len(at)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(at)]])))
        most = np.concatenate([[0], np.maximum.accumulate(run + 1)[:-1]])  # rows before that one id has at most
        keep[own[np.arange(len(at)) - most >= k]] = False
    return np.flatnonzero(keep)


_CHUNKS = pa.schema([("d", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary()), ("low", pa.binary()), ("step", pa.binary())])
_BLOCKS = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("d", pa.int32()), ("asking", pa.binary()), ("queries", pa.binary())])
_BOUNDS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("upper", pa.float64()), ("lower", pa.float64())])


def _matrix(column: pa.ChunkedArray | pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and values by dimension of a column of integer lists."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    return [(rows, flat[begins[rows][:, None] + np.arange(d)]) for d in np.unique(lengths) if len(rows := np.flatnonzero(lengths == d)) and d]


def _lots(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of one dimension, about ``size`` at a time."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            for rows, values in _matrix(part.column(1)):
                lot = held.setdefault(values.shape[1], [])
                lot.append((ids[at : at + size][rows], values))
                if sum(len(i) for i, _ in lot) >= size:
                    yield np.concatenate([i for i, _ in lot]), np.concatenate([v for _, v in lot])
                    held[values.shape[1]] = []
    for lot in held.values():
        if lot:
            yield np.concatenate([i for i, _ in lot]), np.concatenate([v for _, v in lot])


def approximation_file(vectors: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """Write the cells of ``vectors`` (id, v) to the shared folder: a row for each chunk of one dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in _lots(batches, chunk):
            kept = undominated(ids, values, k)
            cells, low, step = quantised(values[kept])
            row = (values.shape[1], ids[kept].astype(np.int64).tobytes(), cells.tobytes(), low.tobytes(), step.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, _CHUNKS, strict=True)], schema=_CHUNKS)

    return materialise(vectors.mapInArrow(run, "d int, ids binary, cells binary, low binary, step binary"), "topk-cells")


def _query_blocks(asking: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for n, (ids, values) in enumerate(_lots(batches, size)):
            row = (TaskContext.get().partitionId(), n, values.shape[1], ids.astype(np.int64).tobytes(), values.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

    blocks = asking.coalesce(max(1, -(-asking.count() // size)))
    return materialise(blocks.mapInArrow(run, "part int, number int, d int, asking binary, queries binary"), "topk-blocks")


def query_lots(blocks: DataFrame, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """``part, number, lot`` of each block: lots from 0, in order of the blocks, of ``lot_bytes`` and one block at most. Sums run over
    sizes only, one row a block within a part and one row a part."""
    sizes = blocks.select("part", "number", (F.octet_length("queries") + F.octet_length("asking")).cast("long").alias("bytes"))
    parts = sizes.groupBy("part").agg(F.sum("bytes").alias("_sum"))
    before = parts.select("part", F.coalesce(F.sum("_sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("bytes").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.withColumn("_within", within).join(before, "part")
    return materialise(placed.select("part", "number", F.floor((F.col("_before") + F.col("_within")) / lot_bytes).alias("lot")), "topk-lots")


class _Able:
    """Of one query: the vectors that can still be among the k best, with their bounds."""

    __slots__ = ("ids", "lower", "upper")

    def __init__(self):
        self.ids, self.upper, self.lower = np.empty(0, np.int64), np.empty(0), np.empty(0)

    def add(self, ids: np.ndarray, upper: np.ndarray, width: float, k: int) -> None:
        u, i = np.concatenate([self.upper, upper]), np.concatenate([self.ids, ids])
        low = np.concatenate([self.lower, upper - width])
        if len(low) > k:
            able = u >= np.partition(low, len(low) - k)[len(low) - k]
            u, i, low = u[able], i[able], low[able]
        self.ids, self.upper, self.lower = i, u, low


def bounded(file: DataFrame, blocks: list[tuple[int, bytes, bytes]], k: int) -> DataFrame:
    """``query_id, vec_id, upper, lower`` of the vectors that each task of the scan can't rule out for the queries of ``blocks`` (dimension,
    ids, vectors), which every task holds; a chunk of the file passes once."""
    told = file.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(d, np.frombuffer(ids, np.int64), np.frombuffer(queries).reshape(-1, d)) for d, ids, queries in told.value]
        known = [[_Able() for _ in ids] for _, ids, _ in asked]
        for batch in batches:
            for row in batch.to_pylist():
                ids, cells = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["cells"], np.uint8).reshape(-1, row["d"])
                for (d, asking, queries), able in zip(asked, known, strict=True):
                    if d != row["d"]:
                        continue
                    upper, width = bounds(queries, cells, np.frombuffer(row["low"]), np.frombuffer(row["step"]))
                    for q, one in enumerate(able):
                        other = ids != asking[q]
                        u = upper[q][other]
                        need = np.partition(u, len(u) - k)[len(u) - k] - width[q] if len(u) > k else -np.inf
                        near = u >= need
                        one.add(ids[other][near], u[near], width[q], k)
        for (_, asking, _), able in zip(asked, known, strict=True):
            counts = [len(x.ids) for x in able]
            if sum(counts):
                columns = [np.repeat(asking, counts), *(np.concatenate([getattr(x, n) for x in able]) for n in ("ids", "upper", "lower"))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_BOUNDS)

    return file.mapInArrow(run, "query_id long, vec_id long, upper double, lower double")


def _exact(vectors: np.ndarray, query: np.ndarray, small: bool) -> np.ndarray:
    """Integer inner products: by doubles where these are exact, else by Python's integers."""
    if small:
        return (vectors @ query).astype(np.int64)
    top = (1 << 63) - 1
    return np.array([max(-top - 1, min(top, sum(int(a) * int(b) for a, b in zip(v, query, strict=True)))) for v in vectors], np.int64)


def _products(queries: pd.Series, vectors: pd.Series) -> pd.Series:
    out = np.zeros(len(queries), np.int64)
    lengths = queries.map(len).to_numpy(dtype=np.int64)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        a, b = (np.stack(x.iloc[rows].to_list()).astype(np.float64) for x in (queries, vectors))
        if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * d < 2.0**52:
            out[rows] = (a * b).sum(1).astype(np.int64)
        else:
            out[rows] = [_exact(y[None, :], x, False)[0] for x, y in zip(a, b, strict=True)]
    return pd.Series(out)


def survivors(rows: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, scale: int, query_block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The vectors, the asking ones, and ``query_id, vec_id, upper, rank`` of all pairs that the bounds leave, best bound first."""
    bounded_batches(rows.sparkSession)
    vectors = integer_vectors(rows, id_col, vector_col, scale)
    asking = materialise(integer_vectors(rows.filter(is_query), id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v")), "topk-queries")
    blocks = _query_blocks(asking, query_block)
    file = approximation_file(vectors, k)
    lots = query_lots(blocks)
    last = lots.agg(F.max("lot")).first()[0]
    found = None
    for lot in range((last or 0) + 1):  # of a bounded number of bytes, so that driver and tasks can hold it
        held = blocks.join(lots.filter(F.col("lot") == lot), ["part", "number"]).select("d", "asking", "queries").collect()
        some = materialise(bounded(file, [(r["d"], bytes(r["asking"]), bytes(r["queries"])) for r in held], k), "topk-bounds")
        found = some if found is None else found.union(some)
    lowest = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    kth = found.withColumn("_n", F.row_number().over(lowest)).filter(F.col("_n") <= k).groupBy("query_id").agg(F.min("lower").alias("_kth"), F.count(F.lit(1)).alias("_k"))
    left = found.join(kth, "query_id").filter((F.col("upper") >= F.col("_kth")) | (F.col("_k") < k)).groupBy("query_id", "vec_id").agg(F.max("upper").alias("upper"))
    best = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id")
    return vectors, asking, materialise(left.withColumn("rank", F.row_number().over(best)), "topk-survivors")


def top_k(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of each query row (all, if fewer), ties to the smaller id.

    Queries meet the file's chunks in blocks of a fixed size, some blocks at a time. Only rows of the query's dimension count.
    Of rows that repeat a query's id the smallest vector asks, and none answers. Components are exact up to 2^53 after scaling;
    scores beyond 64 bits stay at the limit. No rows: no result.
    """
    vectors, asking, able = survivors(rows, is_query, k, id_col, vector_col, scale, query_block)
    asked = asking.select(F.col("id").alias("query_id"), F.col("v").alias("_q"))

    def read(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select("query_id", "vec_id")
        exact = vectors.join(broadcast_if_small(wanted), vectors["id"] == wanted["vec_id"]).join(asked, "query_id").filter(F.size("v") == F.size("_q"))
        return materialise(exact.select("query_id", "vec_id", F.pandas_udf(_products, "long")("_q", "v").alias("score")), "topk-exact")

    near = read(able.filter(F.col("rank") <= k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    sure = near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).groupBy("query_id").agg(F.min("score").alias("_kth"))
    more = materialise(able.filter(F.col("rank") > k).join(sure, "query_id").filter(F.col("upper") >= F.col("_kth")).select("query_id", "vec_id"), "topk-more")
    ranked = near.union(read(more)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
