"""Removes bytes of passages that occur again anywhere: a suffix sort that compares by prefix hashes.

Only a suffix that starts with ``length`` bytes met elsewhere matters, and those bytes hold an **anchor**, their ``GRAM``-byte string
of least hash, at the same distance. So suffixes with one anchor at one distance are compared with each other and with no
others:

1. One pass over the texts finds the anchors. Neighbouring suffixes with the same anchor are a **run**: one row.
2. Runs whose anchor occurs once are unique by proof. Runs that are equal as a whole (two hashes, 128 bits) repeat as a whole; one
   of them stands for all.
3. The bytes of the other runs are read again. Within an anchor, their suffixes are sorted by a **mergesort** that finds the common
   extension of two suffixes by binary search on polynomial prefix hashes and compares the next byte. Neighbours in order with a
   common extension of ``length`` repeat, once their bytes are found equal; a collision sends the suffixes of that anchor through
   a plain sort by bytes.
4. Anchors with very many different runs are dealt to tasks in parts; what is unique in its part meets the other parts' by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import bounded_batches, materialise, numbered_rows, release_memory, shared_key_lookup

LENGTH = 200
#: Bytes of an anchor: longer ones meet fewer strangers, shorter ones are rarer (one in about (length - GRAM) / 2 bytes).
GRAM = 48
#: Suffix starts that one array step looks at; texts are looked at in such pieces, so memory doesn't grow with them.
PIECE = 1 << 19
#: Runs of one anchor that a task sorts together, and bytes of runs that it sorts at a time.
RUNS_AT_ONCE, BYTES_AT_ONCE = 4096, 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A number for each byte value, so that bytes and their sums aren't small.
_OF_BYTE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)
_OF_BYTE_2 = np.array([int.from_bytes(hashlib.blake2b(bytes([b, b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)


class Powers:
    """Powers of the base and of its inverse, as far as they were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.concatenate([self.up, self.up * (self.up[-1] * _BASE)])
                self.down = np.concatenate([self.down, self.down * (self.down[-1] * _INVERSE)])


_POWERS = Powers()


class PrefixHashes:
    """Polynomial hashes modulo 2^64 of all prefixes of ``data``; those of any substring follow from two of them."""

    def __init__(self, data: np.ndarray, of_byte: np.ndarray = _OF_BYTE):
        _POWERS.reach(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(of_byte[data] * _POWERS.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[start + length] - self.sums[start]) * _POWERS.down[start]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the high bits of a polynomial hash over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring keys: running minima from both ends of blocks."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.int64).max, np.int64)
    padded[: len(keys)] = keys
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def piece_runs(data: np.ndarray, ends: np.ndarray, starts: int, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The runs of the first ``starts`` suffixes of ``data``: ``(start, count, anchor, gram hash, run hash)``, by start. ``ends`` are
    the ends of the documents in ``data``, ascending; suffixes with less than ``length`` bytes left are in no run."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    starts = min(starts, len(data) - length + 1)
    if starts <= 0:
        return none
    data = data[: starts + length - 1]
    width = length - gram + 1
    hashes = PrefixHashes(data)
    grams = _mixed(hashes.of(np.arange(len(data) - gram + 1), gram))
    # The hash's upper 43 bits, then the place: the leftmost of equals wins, wherever the suffix lies.
    place = np.arange(len(grams), dtype=np.int64)
    least = _window_least(((grams >> np.uint64(21)).astype(np.int64) << 20) | place, width)
    anchor = least & ((1 << 20) - 1)
    at = np.arange(starts)
    end = ends[np.searchsorted(ends, at, side="right")]
    whole = at + length <= end
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1]) | (end[1:] != end[:-1])
    begin = np.flatnonzero(first)
    if not len(begin):
        return none
    stop = np.flatnonzero(whole & ~np.concatenate([whole[1:] & ~first[1:], [False]])) + 1
    count = stop - begin
    run_hash = _mixed(PrefixHashes(data, _OF_BYTE_2).of(begin, count + (length - 1)))
    return begin, count, anchor[begin], grams[anchor[begin]], run_hash


def _runs(length: int, gram: int):
    names = ["gram", "run", "row", "start", "count", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1)
            if pa.types.is_large_binary(texts.type):
                offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            else:
                offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            if not len(texts) or texts.buffers()[2] is None:
                continue
            whole = np.frombuffer(texts.buffers()[2], np.uint8)
            for at in range(int(offsets[0]), int(offsets[-1]), PIECE):
                piece = whole[at : min(at + PIECE + length - 1, int(offsets[-1]))]
                inner = offsets[1:][offsets[1:] > at] - at
                begin, count, anchor, grams, run_hash = piece_runs(piece, np.unique(np.minimum(inner, len(piece))) if len(inner) else inner, PIECE, length, gram)
                doc = np.searchsorted(offsets, begin + at, side="right") - 1
                columns = [grams.view(np.int64), run_hash.view(np.int64), ids[doc], begin + at - offsets[doc], count.astype(np.int32), (anchor - begin).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
        release_memory()

    return run


# --- the suffix sort -------------------------------------------------------------------------------------------------


def _less_or_equal(data: np.ndarray, hashes: PrefixHashes, p: np.ndarray, q: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether suffix p comes before q in the order of their first ``length`` bytes, and whether these are equal."""
    equal = hashes.of(p, length) == hashes.of(q, length)
    before = np.zeros(len(p), bool)
    differ = np.flatnonzero(~equal)
    if len(differ):
        a, b = p[differ], q[differ]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), length - 1)  # the common extension is within these
        for _ in range(int(length).bit_length()):
            middle = (low + high + 1) >> 1
            same = hashes.of(a, middle) == hashes.of(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        before[differ] = data[a + low] < data[b + low]
    return before, equal


def sorted_suffixes(data: np.ndarray, suffixes: np.ndarray, segments: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes of each segment (``segments`` ascend) by their first ``length`` bytes: ``(order, equal)``, where order[i]
    is the suffix's index and equal[i] says that it equals the one before it in its segment. Runs of 1, 2, 4, ... suffixes are
    merged at once in all segments: a suffix's rank in its neighbour run is found by binary search. The result is verified by
    bytes."""
    hashes = PrefixHashes(data)
    n = len(suffixes)
    opens = np.concatenate([[True], segments[1:] != segments[:-1]]) if n else np.zeros(0, bool)
    number = np.cumsum(opens) - 1
    base_of = np.flatnonzero(opens)
    size_of = np.diff(np.concatenate([base_of, [n]])) if n else base_of
    base, size = base_of[number], size_of[number]
    order, width = np.arange(n), 1
    while width < (size_of.max() if n else 0):
        at = np.flatnonzero(size > width)  # places whose segment is not yet one run
        inside = at - base[at]
        run = inside // width
        other = (run ^ 1) * width
        low = np.zeros(len(at), np.int64)
        high = np.clip(size[at] - other, 0, width)
        mine, later = suffixes[order[at]], (run & 1).astype(bool)
        for _ in range(width.bit_length()):
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            theirs = suffixes[order[base[at[open_]] + other[open_] + middle]]
            before, equal = _less_or_equal(data, hashes, theirs, mine[open_], length)
            passed = before | (equal & later[open_])  # of equals, the left run's come first
            low[open_] = np.where(passed, middle + 1, low[open_])
            high[open_] = np.where(passed, high[open_], middle)
        merged = order.copy()
        merged[base[at] + (run & ~1) * width + inside - run * width + low] = order[at]
        order, width = merged, width * 2
    return _verified(data, suffixes, order, number, base_of, size_of, hashes, length)


def _verified(data, suffixes, order, number, base_of, size_of, hashes, length) -> tuple[np.ndarray, np.ndarray]:
    n = len(order)
    equal, wrong = np.zeros(n, bool), np.zeros(len(base_of), bool)
    pairs = np.flatnonzero(number[1:] == number[:-1]) + 1
    windows = np.lib.stride_tricks.sliding_window_view(data, length) if len(pairs) else None
    for at in range(0, len(pairs), 1 << 14):
        i = pairs[at : at + (1 << 14)]
        p, q = suffixes[order[i - 1]], suffixes[order[i]]
        differ = windows[p] != windows[q]
        first = differ.argmax(axis=1)
        same = ~differ[np.arange(len(i)), first]
        equal[i] = same
        wrong[number[i[(same != (hashes.of(p, length) == hashes.of(q, length))) | (~same & (data[p + first] > data[q + first]))]]] = True
    for segment in np.flatnonzero(wrong):  # hashes collided
        places = np.arange(base_of[segment], base_of[segment] + size_of[segment])
        texts = {int(k): bytes(data[suffixes[k] : suffixes[k] + length]) for k in order[places]}
        order[places] = sorted(texts, key=texts.__getitem__)
        equal[places[1:]] = [texts[int(a)] == texts[int(b)] for a, b in zip(order[places[:-1]], order[places[1:]], strict=True)]
    return order, equal


def compared_runs(gram: np.ndarray, part: np.ndarray, parts: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray, distance: np.ndarray, mine: np.ndarray, data: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Which suffixes of these runs, whole (anchor, part) groups in order with their bytes in ``data``, repeat: columns ``gram,
    window, row, begin, end``. Where all of an anchor's runs are here: repeated starts from begin to end, without window. Else also
    one row, with the window's hash, for each suffix not met here, and one without row for each class of others."""
    size = count + (length - 1)
    offset = np.cumsum(size) - size
    of = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    group = np.cumsum(np.concatenate([[False], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])])) if len(gram) else gram
    segment = group[of] * 1024 + (distance[of] - step)
    by_segment = np.argsort(segment, kind="stable")
    of, step = of[by_segment], step[by_segment]
    suffix = offset[of] + step
    order, equal = sorted_suffixes(data, suffix, segment[by_segment], length)
    met = equal | np.concatenate([equal[1:], [False]])
    of, step, suffix = of[order], step[order], suffix[order]
    known = np.flatnonzero(met & mine[of])
    known = known[np.lexsort([step[known], of[known]])]
    o, s = of[known], step[known]
    opens = np.concatenate([[True], (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)]) if len(o) else np.zeros(0, bool)
    closes = np.concatenate([opens[1:], [True]]) if len(o) else opens
    o, begin, end = o[opens], s[opens], s[closes] + 1
    found = [gram[o], np.zeros(len(o), np.int64), np.ones(len(o), bool), row[o], start[o] + begin, start[o] + end]
    elsewhere = parts[of] > 1
    told = np.flatnonzero(elsewhere & (~met | ~equal))  # one of each class
    hashes = _mixed(PrefixHashes(data, _OF_BYTE_2).of(suffix[told], length)).view(np.int64)
    asks = ~met[told] & mine[of[told]]
    o = of[told]
    more = [gram[o], hashes, asks, row[o], start[o] + step[told], start[o] + step[told] + 1]
    whole = np.concatenate([np.ones(len(found[0]), bool), np.zeros(len(o), bool)])
    return [*[np.concatenate([a, b]) for a, b in zip(found, more, strict=True)], whole]


def _compare(length: int):
    names = ["gram", "window", "asks", "row", "begin", "end", "known"]

    def out(held: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(held).combine_chunks()
        column = {c: table[c].to_numpy() for c in ("gram", "part", "parts", "row", "start", "count", "distance", "mine")}
        data = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
        found = compared_runs(*[column[c].astype(np.int64) for c in ("gram", "part", "parts", "row", "start", "count", "distance")], column["mine"].astype(bool), data, length)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            gram, part = rows["gram"].to_numpy(), rows["part"].to_numpy()
            opens = np.flatnonzero(np.concatenate([[(gram[0], part[0]) != last], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])]))
            last = (gram[-1], part[-1])
            ends = np.cumsum(rows["count"].to_numpy().astype(np.int64) + length - 1)
            at = 0
            for cut in opens.tolist():
                before = int(ends[cut - 1]) if cut else 0
                if size + before - (int(ends[at - 1]) if at else 0) >= BYTES_AT_ONCE:
                    held.append(rows.slice(at, cut - at))
                    yield out(held)
                    held, size, at = [], 0, cut
            held.append(rows.slice(at))
            size += int(ends[-1]) - (int(ends[at - 1]) if at else 0)
        if held:
            yield out(held)
        release_memory()

    return run


def _read_runs(length: int):
    """Documents with lists of their runs: the runs, each with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            start, count = (flat.field(flat.type.get_field_index(c)).to_numpy() for c in ("start", "count"))
            texts, rows = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(flat), 4096):
                d, part = doc[at : at + 4096], flat.slice(at, 4096)
                held, known = {}, []
                for i, s, c in zip(d.tolist(), start[at : at + 4096].tolist(), count[at : at + 4096].tolist(), strict=True):
                    if i not in held:
                        held = {i: memoryview(texts[i].as_buffer())}
                    known.append(bytes(held[i][s : s + c + length - 1]))
                fields = {f.name: part.field(k) for k, f in enumerate(part.type)}
                yield pa.RecordBatch.from_arrays([*[fields[c] for c in ("gram", "part", "parts")], pa.array(rows[d]), *[fields[c] for c in ("start", "count", "distance", "mine")], pa.array(known, pa.binary())],
                                                 ["gram", "part", "parts", "row", "start", "count", "distance", "mine", "bytes"])
        release_memory()

    return run


def repeated_starts(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``row, begin, end`` for ``texts(row long, data binary)``: the first ``length`` bytes at each place from begin (included) to end
    start somewhere else too. Ranges may touch; nothing is left out, however often a passage occurs."""
    bounded_batches(texts.sparkSession)
    same = ["gram", "run", "count", "distance"]
    runs = materialise(texts.mapInArrow(_runs(length, gram), "gram long, run long, row long, start long, count int, distance int"), "suffix-runs")
    often = materialise(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "suffix-grams")
    shared = materialise(shared_key_lookup(runs, often, ["gram"], "n").drop("n"), "suffix-shared")
    kinds = materialise(shared.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start")).alias("one")), "suffix-kinds")
    whole = shared_key_lookup(shared, materialise(kinds.filter("n > 1").select(*same, "n"), "suffix-whole"), same, "n")
    mixed = materialise(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "suffix-mixed")
    parts = F.ceil(F.col("m") / RUNS_AT_ONCE)
    sides = shared_key_lookup(kinds, mixed, ["gram"], "m").select(
        F.col("one.row").alias("row"), F.struct("gram", F.pmod("run", parts).alias("part"), parts.alias("parts"), F.col("one.start").alias("start"), F.col("count").cast("long").alias("count"), F.col("distance").cast("long").alias("distance"), (F.col("n") == 1).alias("mine")).alias("side"),
    )
    told = texts.join(sides.groupBy("row").agg(F.collect_list("side").alias("sides")), "row").select("row", "data", "sides")
    read = told.mapInArrow(_read_runs(length), "gram long, part long, parts long, row long, start long, count long, distance long, mine boolean, bytes binary")
    compared = read.repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(_compare(length), "gram long, window long, asks boolean, row long, begin long, end long, known boolean")
    compared = materialise(compared, "suffix-compared")
    across = compared.filter("not known").groupBy("gram", "window").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("asks"), F.struct("row", "begin", "end"))).alias("asking"))
    met = across.filter("n > 1").select(F.explode("asking").alias("a")).select("a.*")
    return whole.select("row", F.col("start").alias("begin"), (F.col("start") + F.col("count")).alias("end")).unionByName(compared.filter("known").select("row", "begin", "end")).unionByName(met)


def _cut(length: int):
    names = ["row", "n_bytes", "n_removed", "spans", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, lists = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            out: list[list] = [[] for _ in names]
            for i, row in enumerate(rows):
                data, spans = texts[i].as_py() or b"", []
                if lists[i].is_valid:
                    ranges = lists[i].values
                    begin, end = (ranges.field(ranges.type.get_field_index(c)).to_numpy() for c in ("begin", "end"))
                    by = np.argsort(begin, kind="stable")
                    begin, end = begin[by], np.maximum.accumulate(end[by] + length - 1)
                    opens = np.concatenate([[True], begin[1:] > end[:-1]])
                    spans = list(zip(begin[opens].tolist(), end[np.concatenate([opens[1:], [True]])].tolist(), strict=True))
                edges = [0, *[x for span in spans for x in span], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for column, value in zip(out, (row, len(data), len(data) - len(kept), [{"begin": a, "end": b} for a, b in spans], kept), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
        release_memory()

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``id, n_bytes, n_removed, spans, kept`` for every row: the bytes of its text, how many of them ``length``-byte strings cover that
    start elsewhere too (in this or any other row), where (ranges of bytes), and the bytes that are left.

    Null text is empty. Texts below ``length`` bytes repeat nothing. Rows that repeat, with null or equal ids too, count as rows: all
    their bytes go. Texts of any length are looked at in pieces. Other columns are ignored; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    numbered = numbered_rows(docs, id_col, text_col)
    if numbered is None and kind in ("bigint", "int", "smallint", "tinyint"):
        texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("row"), F.col(f"`{text_col}`").alias("text"))
        ids = None
    else:
        if numbered is None:
            numbered = materialise(docs.select(F.struct(F.col(f"`{id_col}`")).alias("_doc"), F.monotonically_increasing_id().alias("_row"), F.col(f"`{text_col}`").alias("_text")), "suffix-rows")
        texts = numbered.select(F.col("_row").alias("row"), F.col("_text").alias("text"))
        ids = numbered.select(F.col("_row").alias("row"), F.col("_doc").getField(id_col).alias(id_col))
    texts = texts.select("row", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    starts = repeated_starts(texts, length).groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    cut = texts.join(starts, "row", "left").select("row", "data", "ranges").mapInArrow(_cut(length), "row long, n_bytes long, n_removed long, spans array<struct<begin: long, end: long>>, kept binary")
    if ids is None:
        return cut.withColumn("row", F.col("row").cast(kind)).withColumnRenamed("row", id_col)
    return ids.join(cut, "row").drop("row")


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` of ``without_repeats``."""
    found = without_repeats(docs, id_col, text_col, length)
    return found.select(id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
