"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is read here, its normaliser, blank marker, scores and byte fallback are rebuilt as components of
the tokenizers library, and every result can be held against the sentencepiece library.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import WordEncoder, bounded_batches

MARK = "▁"
# Numbers of the model's protobuf (messages ModelProto, TrainerSpec, NormalizerSpec).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Threads of the tokenizers library in a task.
THREADS = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        else:
            raise ValueError(f"wire type {kind} in a model file")
        yield key >> 3, value


@dataclass
class ModelFile:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    @classmethod
    def read(cls, path: str) -> ModelFile:
        model = cls()
        with open(path, "rb") as file:
            data = file.read()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                model.pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
                model.model_type, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                rules = dict(_fields(value))
                model.charsmap, model.dummy_prefix, model.remove_extra, model.escape = rules.get(2, b""), bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1))
        return model

    @property
    def unknown(self) -> int:
        return next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)

    def plain(self) -> bool:
        """Whether words can be encoded apart: blanks become marks and no piece has a mark after another character."""
        return not self.charsmap and self.dummy_prefix and not self.remove_extra and self.escape and all(kind != USER_DEFINED and MARK not in p.lstrip(MARK) for p, _, kind in self.pieces)


def build_tokenizer(model: ModelFile, normalise: bool = True):
    """A Tokenizer of the tokenizers library with the file's ids. Pieces of a BPE model get the merges that their scores
    order; those of a unigram model keep their scores."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    if model.model_type == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback))
    elif model.model_type == BPE:
        pairs = [(-score, vocabulary[p[:k]], vocabulary[p[k:]], p[:k], p[k:]) for p, score, kind in model.pieces if kind == NORMAL for k in range(1, len(p)) if p[:k] in vocabulary and p[k:] in vocabulary]
        tokenizer = Tokenizer(models.BPE(vocabulary, [x[3:] for x in sorted(pairs)], unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback))
    else:
        raise ValueError(f"model type {model.model_type} is neither unigram nor BPE")
    steps = []
    if normalise:
        if model.charsmap:
            steps.append(normalizers.Precompiled(model.charsmap))
        if model.remove_extra:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if model.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if model.escape else " "))
        if model.escape:
            steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    if own := [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]:
        tokenizer.add_tokens(own)
    return tokenizer


class Backend:
    """Encodes and decodes by one model file; one a worker."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        model = ModelFile.read(path)
        self.path, self.tokenizer = path, build_tokenizer(model)
        self.words = None
        if model.plain():
            lengths = np.array([1 if kind == BYTE else len(p.encode()) for p, _, kind in model.pieces], np.int64)
            # a mark that is a piece begins the first token of each word, so no run of byte tokens goes on from word to word
            spoken = self.decode if any(p == MARK and kind == NORMAL for p, _, kind in model.pieces) else None
            self.words = WordEncoder(build_tokenizer(model, normalise=False), lengths, MARK, self.tokenizer, marks_first=True, spoken=spoken)
        self._own = None

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; null counts as empty."""
        if self.words is not None:
            return self.words.encode(texts)
        return (np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False))

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def round_trip(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids of each text, and the text that they decode to. Where words can be told apart, each one is decoded once."""
        known = self.words.round_trip(texts) if self.words is not None and self.words.spoken else ((ids, None) for ids in self.encode(texts))
        for ids, text in known:
            yield ids, self.decode([ids.tolist()])[0] if text is None else text

    def own(self):
        """The sentencepiece library's processor of the same file."""
        if self._own is None:
            import sentencepiece

            self._own = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self._own


_BACKENDS: dict[str, Backend] = {}


def backend(path: str) -> Backend:
    """One backend per Python worker and file, with the library's threads on, whatever ran in the worker before."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    if path not in _BACKENDS:
        _BACKENDS[path] = Backend(path)
    return _BACKENDS[path]


_LOT_CHARS = 2_000_000


def _lots(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        keys, values, size = [], [], 0
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(k)
            values.append(v)
            size += len(v or "")
            if size >= _LOT_CHARS:
                yield keys, values
                keys, values, size = [], [], 0
        if keys:
            yield keys, values


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids`` (array<int>) of every row; null and empty texts have no ids; repeated rows stay; other columns are ignored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _lots(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([x.astype(np.int32) for x in backend(model_path).encode(texts)], pa.list_(pa.int32()))], ["_id", "ids"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_id long, ids array<int>").withColumnRenamed("_id", id_col)


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, text`` of every row; null ids decode to the empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in _lots(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(backend(model_path).decode([x or [] for x in ids]), pa.string())], ["_id", "text"])

    bounded_batches(rows.sparkSession)
    data = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(ids_col).alias("_ids"))
    return data.mapInArrow(run, "_id long, text string").withColumnRenamed("_id", id_col)


def verified(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_pieces, ids_crc32, parity, decode_parity, text_crc32`` of every row: number and checksum (as little-endian
    unsigned 32-bit integers) of the ids, whether the sentencepiece library gives the same ids for the whole text, whether it
    decodes these ids to the same text, and the checksum of the decoded text's UTF-8."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _lots(batches):
            b = backend(model_path)
            counts, sums, same, same_text, text_sums = [], [], [], [], []
            for (x, text), y in zip(b.round_trip(texts), b.own().encode([t or "" for t in texts], num_threads=1), strict=True):
                counts.append(len(x))
                sums.append(zlib.crc32(x))
                ids = x.tolist()
                same.append(ids == y)
                same_text.append(text == b.own().decode(ids))
                text_sums.append(zlib.crc32(text.encode()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_()), pa.array(same_text, pa.bool_()), pa.array(text_sums, pa.int64())],
                ["_id", "n_pieces", "ids_crc32", "parity", "decode_parity", "text_crc32"],
            )

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_id long, n_pieces long, ids_crc32 long, parity boolean, decode_parity boolean, text_crc32 long").withColumnRenamed("_id", id_col)
