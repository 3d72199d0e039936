"""Packing of token sequences: best-fit decreasing over a segment tree of open windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import bounded_batches, encoder, release_memory, small_lists

WINDOW = 1024
#: Ids that a task holds before it packs them (4 bytes each); padding arises only at the end of such a lot.
LOT_IDS = 2_000_000
_SEQUENCES_PER_TASK = 1 << 36


class OpenWindows:
    """Open windows by remaining capacity. A segment tree over the capacities 0..window holds how many windows are open in
    each range; a search for the tightest window walks it once down."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, window_id: int) -> None:
        self.at[room].append(window_id)
        self._change(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out a window of the least room that is at least ``need``: (its room, its id)."""
        node, count = self.leaves + need, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up, to the first sibling on the right that has one
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        window_id = self.at[room].pop()
        self._change(room, -1)
        return room, window_id


def _split_after(pieces: list[tuple[int, int, int]], length: int) -> tuple[list, list]:
    """Cut a run of pieces after ``length`` ids."""
    head, tail = [], []
    for doc, start, n in pieces:
        take = min(n, length)
        if take:
            head.append((doc, start, take))
        if n > take:
            tail.append((doc, start + take, n - take))
        length -= take
    return head, tail


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW, fill: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of at most ``window`` ids that hold each document once.

    Overlong documents are first cut into full windows. What remains goes, longest first (ties: first document first), to
    the tightest open window with enough room. With ``fill`` the emptiest windows are then cut to fill the gaps of the
    others, and the last one into windows whose lengths are powers of two, which need no padding.
    """
    windows: list[list[tuple[int, int, int]]] = []
    for doc in np.flatnonzero(lengths >= window).tolist():
        windows += [[(doc, at, window)] for at in range(0, int(lengths[doc]) // window * window, window)]
    rest = lengths % window
    order = np.argsort(-rest, kind="stable")
    opened, partial = OpenWindows(window), []
    for doc in order[: np.count_nonzero(rest)].tolist():
        n = int(rest[doc])
        piece = (doc, int(lengths[doc]) - n, n)
        if (found := opened.tightest(n)) is None:
            room, at = window, len(partial)
            partial.append([])
        else:
            room, at = found
        partial[at].append(piece)
        if room > n:
            opened.put(room - n, at)
    if not fill:
        return windows + partial
    used = [sum(n for _, _, n in p) for p in partial]
    windows += [p for p, u in zip(partial, used, strict=True) if u == window]
    gaps = sorted((u, i) for i, u in enumerate(used) if u < window)
    low, high = 0, len(gaps) - 1
    source: list[tuple[int, int, int]] = []
    while low <= high:
        if not source:
            source = partial[gaps[low][1]]
            low += 1
            continue
        u, i = gaps[high]
        head, source = _split_after(source, window - u)
        filled = sum(n for _, _, n in head)
        if u + filled == window:
            windows.append(partial[i] + head)
            high -= 1
        else:  # the source ran out within this gap
            partial[i] = partial[i] + head
            gaps[high] = (u + filled, i)
    left = sum(n for _, _, n in source)
    while left:
        head, source = _split_after(source, 1 << (left.bit_length() - 1))
        windows.append(head)
        left -= 1 << (left.bit_length() - 1)
    return windows


_PIECES = pa.schema([("id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])


def _pack_lot(keys: list, ids: list[np.ndarray], first: int, window: int, fill: bool) -> tuple[pa.RecordBatch, int]:
    lengths = np.fromiter((len(x) for x in ids), np.int64, len(ids))
    windows = best_fit_decreasing(lengths, window, fill)
    rows: list[tuple] = []
    for k, pieces in enumerate(windows):
        offset = 0
        for doc, start, n in pieces:
            rows.append((keys[doc], start, n, zlib.crc32(ids[doc][start : start + n]), int(lengths[doc]), first + k, offset))
            offset += n
    columns = list(zip(*rows, strict=True)) or [()] * len(_PIECES)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _PIECES, strict=True)], schema=_PIECES), len(windows)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 0, fill: bool = True, lot_ids: int = LOT_IDS) -> DataFrame:
    """One row for each piece of a document: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each task tokenises and packs its own rows in lots of bounded memory, so nothing is shuffled. Null and empty texts have
    the end id alone; a null id stays null; repeated rows are packed once each; an empty table gives no rows; other columns
    are ignored. A document longer than a lot is a lot of its own. ``sequence_id`` is unique in the result, not dense.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() * _SEQUENCES_PER_TASK
        end = np.array([end_id], np.uint32)
        keys, ids, held = [], [], 0
        for some_keys, texts in (lists for batch in batches for lists in small_lists(batch)):
            for key, code in zip(some_keys, encoder(tokenizer_path).encode(texts), strict=True):
                keys.append(key)
                ids.append(np.concatenate([code, end]))
                held += len(ids[-1])
                if held >= lot_ids:
                    out, n = _pack_lot(keys, ids, first, window, fill)
                    yield out
                    first, keys, ids, held = first + n, [], [], 0
        if keys:
            yield _pack_lot(keys, ids, first, window, fill)[0]
        del keys, ids
        release_memory()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return rows.withColumnRenamed("id", id_col)
