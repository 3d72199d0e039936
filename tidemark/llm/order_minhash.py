"""Near-duplicates by Order MinHash: sketches that keep the text order of sampled k-mers, verified by banded alignment.

A k-mer is five words; it is labelled with its occurrence in the text. A sketch is made of the l k-mers with the least hash
values, in the order in which they stand in the text; documents that share a sketch are candidates. A candidate pair is a
link if the Jaccard similarity of the labelled k-mers is at least 0.8, and still is when only matches count that keep their
order within a band of the alignment.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .support import bounded_batches, broadcast_if_small, materialise, numbered_rows, release_memory

K = 5
SIMILARITY = 0.8
SKETCHES = 16
SAMPLED = 3
#: Members of a bucket that all its members are compared with at first; the rest of a bucket is compared in blocks.
PIVOTS = 6
#: Members of a bucket, and of those outside its largest component, that one task compares at a time.
BLOCK, OPEN_BLOCK = 512, 512

#: Powers for texts of so many characters are kept between texts (16 bytes each).
_KEPT_POWERS = 1 << 17

_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S32, _S29 = np.uint64(32), np.uint64(29)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _M1
    x = (x ^ (x >> _S29)) * _M2
    return x ^ (x >> _S32)


class _WordHasher:
    """Hashes of all words of a text at once: differences of a running sum of powers, scaled back to the word's start."""

    def __init__(self):
        self.is_word = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
        self.base = np.uint64(0x2545F4914F6CDD1D)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.back = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n powers of the base and of its inverse; those of very long texts are not kept."""
        if len(self.powers) < n:
            size = max(n, min(_KEPT_POWERS, 2 * n))
            with np.errstate(over="ignore"):
                both = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (self.base, self.inverse)]
            if size > _KEPT_POWERS:
                return both[0][:n], both[1][:n]
            self.powers, self.back = both
        return self.powers[:n], self.back[:n]

    def words(self, text: str | None) -> np.ndarray:
        """32-bit hashes of the words: runs of letters and digits, in lower case."""
        if not text:
            return np.empty(0, np.uint32)
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = self.is_word[points]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        begin, end = edges[::2], edges[1::2]
        if not len(begin):
            return np.empty(0, np.uint32)
        powers, back = self._powers(len(points))
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(points.astype(np.uint64) * powers, dtype=np.uint64)])
            return (_mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64) * _M3) >> _S32).astype(np.uint32)


_HASHER: list[_WordHasher] = []


def word_hashes(text: str | None) -> np.ndarray:
    if not _HASHER:
        _HASHER.append(_WordHasher())
    return _HASHER[0].words(text)


def labelled_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers in text order, each with its occurrence number; of fewer than k words one k-mer of all of them."""
    if not len(words):
        return np.empty(0, np.uint64)
    w = words.astype(np.uint64)
    with np.errstate(over="ignore"):
        n = min(k, len(w))
        h = np.zeros(len(w) - n + 1, np.uint64)
        for i in range(n):
            h = h * _M3 + _mixed(w[i : len(w) - n + 1 + i] + np.uint64(i + 1))
        h = _mixed(h + np.uint64(n))
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        if not new.all():
            at = np.flatnonzero(new)
            occurrence = np.arange(len(s)) - np.repeat(at, np.diff(np.concatenate([at, [len(s)]])))
            h = h.copy()
            h[order] = np.where(occurrence > 0, _mixed(s + occurrence.astype(np.uint64) * _M1), s)
    return h


def order_sketches(kmers: np.ndarray, sketches: int = SKETCHES, sampled: int = SAMPLED) -> np.ndarray:
    """One 64-bit value a sketch: of the ``sampled`` k-mers of least rank, in text order."""
    n, take = len(kmers), min(sampled, len(kmers))
    if not n:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        seeds = _mixed(np.arange(1, sketches + 1, dtype=np.uint64))
        ranks = (kmers[None, :] ^ seeds[:, None]) * _M2
        least = None
        if n > 16 * take:  # few k-mers rank low enough to matter; rarely too few do
            row, place = np.nonzero(ranks < np.uint64(int((1 << 64) / n * 5 * take)))
            begins = np.searchsorted(row, np.arange(sketches + 1))
            if (np.diff(begins) >= take).all():
                place = place[np.lexsort((ranks[row, place], row))]
                least = place[begins[:-1, None] + np.arange(take)]
        if least is None:
            least = np.argpartition(ranks, take - 1, axis=1)[:, :take] if n > take else np.broadcast_to(np.arange(n), (sketches, n))
        chosen = kmers[np.sort(least, axis=1)]
        out = seeds
        for i in range(take):
            out = _mixed(out * _M3 + chosen[:, i])
    return out.view(np.int64)


def _increasing(values: np.ndarray) -> int:
    """Length of the longest increasing run of places in ``values``."""
    if len(values) < 2 or (values[1:] > values[:-1]).all():
        return len(values)
    tails: list[int] = []
    for v in values.tolist():
        at = bisect.bisect_left(tails, v)
        if at == len(tails):
            tails.append(v)
        else:
            tails[at] = v
    return len(tails)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two lists of labelled k-mers are a link. Matches farther off the diagonal than the k-mers that a link may leave
    unmatched can't belong to its alignment; the band leaves them out."""
    need = similarity / (1 + similarity) * (len(a) + len(b))
    if min(len(a), len(b)) < need or not len(a):
        return False
    order = np.argsort(b)
    place = np.searchsorted(b, a, sorter=order)
    place = order[np.minimum(place, len(b) - 1)]
    hit = np.flatnonzero(b[place] == a)
    if len(hit) < need:
        return False
    band = len(a) + len(b) - 2 * int(np.ceil(need))
    to = place[hit]
    return _increasing(to[np.abs(to - hit) <= band]) >= need


_SIGNED = pa.schema([("id", pa.int64()), ("copy", pa.binary()), ("sketches", pa.list_(pa.int64()))])


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at in range(0, batch.num_rows, 256):
            copies, sketches = [], []
            for text in texts.slice(at, 256).to_pylist():
                words = word_hashes(text)
                content = words.tobytes() if len(words) else (text or "").encode("utf-8", "surrogatepass")
                copies.append(hashlib.blake2b(content, digest_size=16, key=b"" if len(words) else b"no words").digest())
                sketches.append(order_sketches(labelled_kmers(words)))
            yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array(copies, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], schema=_SIGNED)
    release_memory()


def _words_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            words = [word_hashes(t).view(np.int32) for t in batch.column(1).slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(words, pa.list_(pa.int32()))], ["id", "words"])
    release_memory()


def _is_link(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([aligned(labelled_kmers(a.view(np.uint32)), labelled_kmers(b.view(np.uint32))) for a, b in zip(left, right, strict=True)], dtype=bool)


def _block_links(block: pd.DataFrame) -> pd.DataFrame:
    """Links across components between the open and all members of a block of a bucket; one for each open member and component."""
    kmers = [labelled_kmers(w.view(np.uint32)) for w in block["words"]]
    every = np.flatnonzero(block["side"].to_numpy() == 0)
    if not len(every):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    ids, components = block["id"].to_numpy(), block["component"].to_numpy()
    flat = np.concatenate([kmers[i] for i in every])
    sizes = np.array([len(kmers[i]) for i in every])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    found = []
    for r in np.flatnonzero(block["side"].to_numpy() == 1):
        own = np.sort(kmers[r])
        at = np.searchsorted(own, flat)
        shared = np.add.reduceat((own[np.minimum(at, len(own) - 1)] == flat).astype(np.int64), begins)
        near = shared >= SIMILARITY / (1 + SIMILARITY) * (len(own) + sizes) - 1e-9
        joined: set = set()
        for x in every[near & (components[every] != components[r])]:
            if components[x] not in joined and aligned(kmers[r], kmers[x]):
                joined.add(components[x])
                found.append((ids[r], ids[x]))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _stored(df: DataFrame) -> DataFrame:
    return materialise(df, "near")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, class_id, copy_of`` of every row: the least id of its class of linked texts, and of the rows with equal words.

    Classes are the connected components of all links between candidates. Candidates share one of the sketches: a pair whose
    similarity is 0.8 is missed with a chance of about 1 in 100,000. In a bucket of documents with one sketch all members are
    compared with a few pivots; where that leaves several components in it, members outside its largest component are
    compared with all others in blocks, so no pair is left out and none is listed unless it is a link.

    Null text counts as empty. Texts without a letter or digit are only equal to the same text; texts of fewer than five
    words only to texts with the same words. Rows that repeat an id count once for each text; null ids get null classes.
    Other columns are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = _stored(read.mapInArrow(_signatures, "id long, copy binary, sketches array<long>"))
    copies = _stored(signed.groupBy("copy").agg(F.min("id").alias("copy_of")).filter("copy_of is not null"))
    first = signed.join(copies, (signed["copy"] == copies["copy"]) & (signed["id"] == copies["copy_of"]), "left_semi")
    members = first.select("id", F.explode("sketches").alias("key")).distinct()

    # buckets: sketches that several texts share, with their pivots
    members = _stored(members)
    buckets = _stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = _stored(members.join(buckets, "key"))
    pivots = members
    least = None
    for _ in range(PIVOTS):  # the next id of each bucket, by partial aggregation rather than by a window over the bucket
        if least is None:
            step = members.groupBy("key").agg(F.min("id").alias("pivot"))
        else:
            step = members.join(least, "key").filter("id > pivot").groupBy("key").agg(F.min("id").alias("pivot"))
        least = _stored(step)
        pivots = least if pivots is members else pivots.union(least)
    pairs = members.join(pivots, "key").filter("id > pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    pairs = _stored(pairs)
    needed = _stored(members.select("id").distinct())
    words = _stored(read.join(broadcast_if_small(needed), "id", "left_semi").mapInArrow(_words_of, "id long, words array<int>"))
    left, right = words.select(F.col("id").alias("a"), F.col("words").alias("wa")), words.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    links = _stored(pairs.join(left, "a").join(right, "b").filter(F.pandas_udf(_is_link, "boolean")("wa", "wb")).select("a", "b"))
    labels = _stored(connected_components(links, _stored))

    # what the pivots left open: buckets with members of several components
    placed = members.filter(F.col("size") > PIVOTS + 1).join(labels, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    bases = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("_b"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("_k")).filter("_k > 1")
    bases = _stored(bases.select("key", F.col("_b.component").alias("base"), F.ceil(F.col("size") / BLOCK).alias("ps"), F.ceil((F.col("size") - F.col("_b.n")) / OPEN_BLOCK).alias("qs")))
    open_ = _stored(placed.join(bases, "key").join(words, "id"))
    part = F.xxhash64("id")
    every = open_.withColumns({"p": F.pmod(part, F.col("ps")), "q": F.explode(F.sequence(F.lit(0).cast("long"), F.col("qs") - 1)), "side": F.lit(0)})
    rest = open_.filter("component <> base").withColumns({"q": F.pmod(part, F.col("qs")), "p": F.explode(F.sequence(F.lit(0).cast("long"), F.col("ps") - 1)), "side": F.lit(1)})
    columns = ["key", "p", "q", "side", "id", "component", "words"]
    more = every.select(columns).union(rest.select(columns)).groupBy("key", "p", "q").applyInPandas(_block_links, "a long, b long")
    more = _stored(more.distinct())
    if more.limit(1).count():
        labels = _stored(connected_components(links.union(more), _stored))
    c = copies.withColumnsRenamed({"copy": "_copy"})
    known = signed.drop("sketches").join(c, F.col("copy") == F.col("_copy"), "left").select("id", "copy_of")
    return known.join(labels, known["copy_of"] == labels["node"], "left").select(
        F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("component", "copy_of")).alias("class_id"), "copy_of"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, that of the least id (null ids come last); columns stay as they are. Rows are told
    apart even where ids are null or repeat: one row of equal id and text stays."""
    rows = numbered_rows(docs, id_col, text_col)
    if rows is not None:
        return drop_near_duplicates(rows, "_row", "_text").select("_doc.*")
    gone = _stored(near_duplicates(docs, id_col, text_col).filter(F.col("class_id") < F.col(id_col)).select(F.col(id_col).alias("_gone")).distinct())
    return docs.join(broadcast_if_small(gone), docs[id_col] == gone["_gone"], "left_anti")
