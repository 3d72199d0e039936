"""Sorted-string-table shards of token ids: prefix-compressed blocks, sparse index, Bloom filter, footer.

A file holds data blocks, then an index, a Bloom filter and a footer of fixed size:

* block: zlib of entries ``shared (varint), unshared (varint), key suffix, value length (varint), value``; ``shared`` counts
  the leading key bytes that the entry has in common with the one before it, 0 at the start of a block;
* value: token ids, little-endian, 2 bytes each if every id of the tokenizer is below 65,536, else 4;
* index: JSON list of ``[first key, last key, offset, bytes, entries]`` (keys in hex), one item a block, zlib;
* filter: bits, set for each key at places drawn from one 128-bit hash;
* footer: ``<QQQQQQIIB7s``: index offset and length, filter offset and length, documents, tokens, filter hashes, crc32 of the
  index, id width, magic.

Keys are byte strings whose order is that of the ids: null first, then integers.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import bounded_batches, encoder, materialise, release_memory, scratch_path, small_lists

MAGIC = b"TMSST1\n"
_FOOTER = struct.Struct("<QQQQQQIIB7s")
BLOCK_BYTES = 256 * 1024
SHARD_TOKENS = 16_000_000
#: Documents of a shard at most (its keys are held while it is written), and documents that are read back at a time.
SHARD_DOCUMENTS, ROWS_AT_ONCE = 500_000, 4096
BITS_PER_KEY = 10
HASHES = 7


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _places(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(hashes)]


class ShardWriter:
    """Takes documents in key order and packs each block when it is full; ``close`` gives the file's bytes. ``width``: bytes of
    an id. A shard's size is bounded by its caller."""

    def __init__(self, width: int, block_bytes: int = BLOCK_BYTES):
        self.width, self.block_bytes = width, block_bytes
        self.out, self.block = bytearray(), bytearray()
        self.index: list[list] = []
        self.keys: list[bytes] = []
        self.entries = self.tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        last, shared = self.keys[-1] if self.entries else b"", 0
        if self.entries:
            shared = next((i for i, (x, y) in enumerate(zip(last, key, strict=False)) if x != y), min(len(last), len(key)))
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(value)) + value
        self.keys.append(key)
        self.entries, self.tokens = self.entries + 1, self.tokens + len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        packed = zlib.compress(self.block, 1)
        self.index.append([self.keys[-self.entries].hex(), self.keys[-1].hex(), len(self.out), len(packed), self.entries])
        self.out += packed
        self.block, self.entries = bytearray(), 0

    def close(self) -> bytearray:
        if self.entries:
            self._flush()
        out, bits = self.out, max(64, BITS_PER_KEY * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits // 8, np.uint8)
        for key in self.keys:
            for p in _places(key, bits, HASHES):
                bloom[p >> 3] |= 1 << (p & 7)
        index_at, packed = len(out), zlib.compress(json.dumps(self.index).encode())
        out += packed
        bloom_at = len(out)
        out += bloom.tobytes()
        out += _FOOTER.pack(index_at, len(packed), bloom_at, len(bloom), len(self.keys), self.tokens, HASHES, zlib.crc32(packed), self.width, MAGIC)
        return out


class Shard:
    """Reads one file: index and filter at once, blocks when they are needed."""

    def __init__(self, path: str):
        files, name = fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(name)
        self.file.seek(self.file.size() - _FOOTER.size)
        index_at, index_len, bloom_at, bloom_len, self.documents, self.tokens, self.hashes, crc, self.width, magic = _FOOTER.unpack(self.file.read(_FOOTER.size))
        packed = self._part(index_at, index_len)
        if magic != MAGIC or zlib.crc32(packed) != crc:
            raise ValueError(f"{path} is no shard or is damaged")
        self.index = [(bytes.fromhex(a), bytes.fromhex(b), *rest) for a, b, *rest in json.loads(zlib.decompress(packed))]
        self.bloom = self._part(bloom_at, bloom_len)

    def _part(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def _block(self, item: tuple) -> Iterator[tuple[bytes, np.ndarray]]:
        data, at, key = zlib.decompress(self._part(item[2], item[3])), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            unshared, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + unshared]
            length, at = _read_varint(data, at + unshared)
            yield key, np.frombuffer(data, f"<u{self.width}", length // self.width, at)
            at += length

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for item in self.index:
            yield from self._block(item)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each document of that key (several if the key repeats): filter, binary search in the index, one scan of
        each block that may hold it."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _places(key, 8 * len(self.bloom), self.hashes)):
            return []
        at, found = bisect.bisect_left(self.index, key, key=lambda x: x[1]), []
        while at < len(self.index) and self.index[at][0] <= key:
            found += [ids for k, ids in self._block(self.index[at]) if k == key]
            at += 1
        return found


def _put(path: str, data: bytes | bytearray) -> None:
    """Write under another name, then rename: a repeated or lost attempt never leaves half a shard. What an earlier attempt of
    the same task left under the name gives way, also in filesystems that don't rename onto a file."""
    files, name = fs.FileSystem.from_uri(path)
    temporary = f"{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as out:
        out.write(data)
    try:
        files.move(temporary, name)
    except OSError:
        if files.get_file_info(name).type != fs.FileType.File:
            raise
        files.delete_file(name)
        files.move(temporary, name)


_MANIFEST = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("documents", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])


def write_shards(
    docs: DataFrame, out_dir: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None, shard_documents: int = SHARD_DOCUMENTS
) -> DataFrame:
    """Tokenise ``docs`` into shards below ``out_dir`` (a URI that executors can write) and return the manifest.

    Rows are dealt out by ranges of the id (and of a hash of the text, so that a repeated id splits too), sorted, encoded and
    written in their tasks; a shard holds about ``shard_tokens``, at least one document and at most ``shard_documents``. Null text: the end id alone; null
    ids come first; rows that repeat an id are neighbours; other columns are ignored; an empty table has no shards.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code = encoder(tokenizer_path)
        width = 2 if max(code.top, end_id) < 1 << 16 else 4
        part, number, writer = TaskContext.get().partitionId(), 0, ShardWriter(width)
        end = np.array([end_id], np.uint32)

        def close() -> pa.RecordBatch:
            path, data = f"{out_dir}/shard-{part:06d}-{number:04d}.sst", writer.close()
            _put(path, data)
            row = (part, number, path, writer.keys[0], writer.keys[-1], len(writer.keys), writer.tokens, len(data))
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, _MANIFEST, strict=True)], schema=_MANIFEST)

        for some_ids, texts in (lists for batch in batches for lists in small_lists(batch)):
            for doc_id, ids in zip(some_ids, code.encode(texts), strict=True):
                writer.add(key_of(doc_id), np.concatenate([ids, end]))
                if writer.tokens >= shard_tokens or len(writer.keys) >= shard_documents:
                    yield close()
                    number, writer = number + 1, ShardWriter(width)
        if writer.keys:
            yield close()
        del writer
        release_memory()

    spark = docs.sparkSession
    bounded_batches(spark)
    fs_dir, name = fs.FileSystem.from_uri(out_dir)
    fs_dir.create_dir(name, recursive=True)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    kinds = "part int, number int, path string, first_key binary, last_key binary, documents long, tokens long, bytes long"
    return materialise(dealt.mapInArrow(run, kinds), "sst-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds ``first_token``: ids in all shards before. One row a task and then one a shard of a task pass the windows."""
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("_sum"))
    before = parts.select("part", F.coalesce(F.sum("_sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("_within", within).join(before, "part").withColumn("first_token", F.col("_before") + F.col("_within")).drop("_before", "_within")


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_digests(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the shards."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Shard(path).scan()
                while some := list(itertools.islice(found, ROWS_AT_ONCE)):
                    rows = []
                    for key, ids in some:
                        rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4"))))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    shards = with_starts(manifest).select("path", "first_token")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as shards in the shared folder and read every document back."""
    out_dir = scratch_path(docs.sparkSession, "sst")
    if "://" not in out_dir:
        out_dir = f"file://{out_dir.removeprefix('file:')}"
    manifest = write_shards(docs, out_dir, tokenizer_path, id_col, text_col)
    return read_digests(manifest).withColumnRenamed("doc_id", id_col)
