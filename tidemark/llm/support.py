"""Helpers that the operators share: shared scratch tables, checked broadcasts and id encoding."""

from __future__ import annotations

import ctypes
import json
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import discard, scratch, scratch_path, shared_dir, write_shared

__all__ = ["discard", "scratch", "scratch_path", "shared_dir"]

#: Rows of one or two machine words that may be broadcast (at most about 64 MB as a hash relation).
BROADCAST_ROWS = 1_000_000
#: Bytes of rows that go to a Python worker at once (a longer row goes alone).
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: short lineage, real sizes for the optimizer."""
    return write_shared(df, name)


def bounded_batches(spark: SparkSession) -> None:
    """From now on this session sends rows to Python by bytes, not by 10,000 rows of any length: both the executor and its
    worker hold a batch several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a count (of a materialised, narrow table) proves the bound; else Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key with more than this share of the rows is hot: there are at most this many of them.
HOT_SHARE = 256


def shared_key_lookup(rows: DataFrame, groups: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (written, one row a key, with the number of rows that have it), no matter how many
    rows share a key. Keys of more than 1 / ``HOT_SHARE`` of all these rows number at most ``HOT_SHARE``, so they are broadcast and
    their rows stay where they are; the others are shuffled by key."""
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot, cold = F.col(count) * HOT_SHARE > total, F.col(count) * HOT_SHARE <= total
    usual = rows.join(F.broadcast(groups.filter(hot).select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(groups.filter(hot)), keys).unionByName(usual.join(groups.filter(cold), keys))


def numbered_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """None where every id is set and occurs once. Else ``_doc, _row, _text`` of each row: the row, its number in order of
    id (null ids last) and text, and its text, so that rows can be told apart by number."""
    ids = docs.select(F.col(f"`{id_col}`").alias("_id"))
    if not ids.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).filter("_id is null or _n > 1").limit(1).count():
        return None
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = [F.col("_id").asc_nulls_last(), F.xxhash64("_text"), F.xxhash64(F.to_json("_doc"))]
    rows = docs.select(doc.alias("_doc"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    return materialise(placed.select("_doc", "_row", "_text"), "rows")


def crc32_mod(column: str, modulus: int) -> Column:
    """crc32 of the value written as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(column).cast("string")) % modulus


# --- token ids -------------------------------------------------------------------------------------------------------

#: Words that an encoder knows at once (about 60 MB); beyond, it keeps those that it has met more than twice.
_CACHE_WORDS = 300_000
_SLICE_CHARS = 2_000_000
_WORDS_AT_ONCE = 2_000
#: First words that an encoder keeps the ids of, and characters of one at most.
_HEADS, _HEAD_CHARS = 20_000, 64
_NONE = np.empty(0, np.uint32)


class _Uncuttable(Exception):
    pass


class _Numbers(dict):
    """A number for each word, in order of first use. A word that is empty or ends in white space raises, as the blank after
    it may belong to the same pre-token."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        if not word or word[-1].isspace():
            raise _Uncuttable
        self.new.append(word)
        self[word] = n = len(self)
        return n


class WordEncoder:
    """Whole-text ids by the tokenizers library, which sees each distinct word of a bounded cache once.

    For tokenizers none of whose tokens spans the end of a word: a blank, written as ``mark``, begins a new token after every
    character but white space. Then the ids of a text are those of its words put together, and many words can be encoded in
    one call, as the byte lengths of the tokens tell where each word ends. Texts with other white space (or a mark of their
    own) before a blank are encoded whole.

    ``spoken`` gives the texts of lists of ids. Where it is set, each word's ids are decoded once too, for ``round_trip``.
    """

    def __init__(self, tokenizer, token_bytes: np.ndarray, mark: str, whole=None, marks_first: bool = False, spoken: Callable[[list[list[int]]], list[str]] | None = None):
        self.tokenizer, self.token_bytes, self.mark, self.marks_first = tokenizer, token_bytes, mark, marks_first
        self.top = len(token_bytes) - 1  # greatest id
        self.whole, self.spoken = whole or tokenizer, spoken
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.heads: dict[str, np.ndarray] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # of the ids of word k: ends[k] .. ends[k + 1]
        self.uses = np.zeros(0, np.int64)
        self.texts: list[str] = []  # of word k, where ``spoken`` is set

    def _keep_frequent(self) -> None:
        kept = np.flatnonzero(self.uses[: len(self.numbers)] > 2)
        if len(kept) > _CACHE_WORDS // 2:
            return self.forget()
        words, begin, texts = list(self.numbers), self.ends[kept], self.texts
        counts = self.ends[kept + 1] - begin
        stops = np.cumsum(counts)
        ids = self.ids[np.arange(stops[-1]) + np.repeat(begin - stops + counts, counts)] if len(kept) else self.ids[:0]
        self.forget()
        self.numbers.update((words[k], i) for i, k in enumerate(kept.tolist()))
        self.ids = np.concatenate([ids, np.empty(1 << 16, np.uint32)])
        self.ends = np.concatenate([[0], stops, np.zeros(1 << 14, np.int64)]).astype(np.int64)
        if self.spoken:
            self.texts = [texts[k] for k in kept.tolist()]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _head(self, word: str) -> np.ndarray:
        """Ids of a text's first word; texts begin with few different ones."""
        if (ids := self.heads.get(word)) is None:
            ids = self._whole(word)
            if len(word) <= _HEAD_CHARS:
                if len(self.heads) >= _HEADS:
                    self.heads.clear()
                self.heads[word] = ids
        return ids

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        at = len(self.numbers) - len(new)
        lots = [[self.mark + w for w in new[i : i + _WORDS_AT_ONCE]] for i in range(0, len(new), _WORDS_AT_ONCE)]
        for words, code in zip(lots, self.tokenizer.encode_batch_fast(["".join(w) for w in lots], add_special_tokens=False), strict=True):
            ids = np.array(code.ids, np.uint32)
            byte_ends = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words)))
            ends = self.ends[at] + np.searchsorted(np.cumsum(self.token_bytes[ids]), byte_ends) + 1
            while len(self.ids) < ends[-1]:
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            while len(self.ends) < at + len(words) + 1:
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.ids[self.ends[at] : ends[-1]] = ids
            self.ends[at + 1 : at + 1 + len(words)] = ends
            if self.spoken:
                flat, stops = ids.tolist(), (ends - self.ends[at]).tolist()
                self.texts += self.spoken([flat[i:j] for i, j in zip([0, *stops], stops)])
            at += len(words)

    def _slice(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Ids of each text, and the numbers of its words after the first one's head, or None where it is encoded whole."""
        if len(self.numbers) > _CACHE_WORDS:
            self._keep_frequent()
        firsts, numbers, get = [], [], self.numbers.__getitem__
        for text in texts:
            if self.marks_first:
                first, words = "", text.split(" ") if text else []
            else:
                first, *words = text.split(" ")
            try:
                if first and first[-1].isspace() or self.marks_first and self.mark in text:
                    raise _Uncuttable
                numbers.append(np.fromiter(map(get, words), np.int64, len(words)))
                firsts.append(first)
            except _Uncuttable:
                numbers.append(None)
                firsts.append(text)
        self._learn()
        met = np.bincount(np.concatenate([n for n in numbers if n is not None] or [np.zeros(0, np.int64)]), minlength=max(len(self.numbers), len(self.uses)))
        met[: len(self.uses)] += self.uses
        self.uses = met
        for first, of in zip(firsts, numbers, strict=True):
            if of is None:
                yield self._whole(first), None
                continue
            head = self._head(first) if first else _NONE
            if not len(of):
                yield head.copy(), of
                continue
            begin = self.ends[of]
            counts = self.ends[of + 1] - begin
            stops = np.cumsum(counts)
            yield np.concatenate([head, self.ids[np.arange(stops[-1]) + np.repeat(begin - stops + counts, counts)]]), of

    def _slices(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= _SLICE_CHARS:
                yield from self._slice(held)
                held, size = [], 0
        if held:
            yield from self._slice(held)

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Unsigned 32-bit ids of each text, in order; null counts as empty."""
        return (ids for ids, _ in self._slices(texts))

    def round_trip(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, str | None]]:
        """Ids of each text and the text decoded from them, word by word; None where the text was encoded whole. Only for encoders
        with ``spoken`` and ``marks_first``, whose words' decoded texts have lost the mark that they begin with."""
        for ids, of in self._slices(texts):
            yield ids, None if of is None else " ".join(map(self.texts.__getitem__, of.tolist()))


class WholeTextEncoder:
    """Ids of whole texts, for tokenizers that nothing is known about."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.top = max(tokenizer.get_vocab(with_added_tokens=True).values(), default=0)

    def forget(self) -> None:
        pass

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        for text in texts:
            yield np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, np.uint32)


def splits_at_blanks(description: dict) -> bool:
    """Whether a tokenizer file's description is a byte-level BPE whose own pattern cuts texts before each blank that follows
    another character than white space: no normaliser, no truncation, no words that are matched across the text."""
    model, cutter = description.get("model") or {}, description.get("pre_tokenizer") or {}
    plain = not description.get("normalizer") and not description.get("truncation") and not description.get("padding")
    own = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space", True)
    bpe = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token"))
    return bool(plain and own and bpe and all(t.get("special") for t in description.get("added_tokens") or []))


def byte_level_encoder(path: str) -> WordEncoder | WholeTextEncoder:
    """The encoder for a tokenizer file: by words where ``splits_at_blanks``, else whole texts. Each character of a byte-level
    token stands for one byte."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    if not splits_at_blanks(json.loads(tokenizer.to_str())):
        return WholeTextEncoder(tokenizer)
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    token_bytes = np.ones(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        token_bytes[i] = len(token)
    return WordEncoder(tokenizer, token_bytes, " ")


_ENCODERS: dict[str, WordEncoder | WholeTextEncoder] = {}


def encoder(path: str) -> WordEncoder | WholeTextEncoder:
    """One encoder per Python worker and file; it forgets its words when a task ends (``release_memory``)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
    if path not in _ENCODERS:
        _ENCODERS[path] = byte_level_encoder(path)
    return _ENCODERS[path]


def release_memory() -> None:
    """Give memory back to the system at the end of a task: Spark keeps Python workers for later stages, and encoders, Arrow's
    pool and the C library hold on to what a task once took."""
    for known in _ENCODERS.values():
        known.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_lists(batch: pa.RecordBatch, rows: int = 256) -> Iterator[tuple[list, list]]:
    """The first two columns of a batch as Python lists, some rows at a time, so that texts aren't held twice at length."""
    for at in range(0, batch.num_rows, rows):
        yield batch.column(0).slice(at, rows).to_pylist(), batch.column(1).slice(at, rows).to_pylist()


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
