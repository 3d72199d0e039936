"""Repairs the structure of damaged conversations: weighted CYK parsing of spans with a grammar of edits.

The repaired role initials are to read ``(s?(ua)+)?``. The grammar is in Chomsky normal form: a nonterminal (p, q) derives the
edited spans that lead the turn order from state p to state q, every rule is (p, q) -> (p, r) (r, q), a leaf is one row kept,
given another role or deleted, and inserted turns derive from no row at all (the closure ``INSERTED``). A cell holds the least
(cost, audit) of each nonterminal over a span. As (p, q) is split at every r, each way to cut a span gives the same cell, so
spans are joined pairwise, by length 1, 2, 4, ..., and the partial cells of long conversations are joined again across tasks.

Equal costs of a span never have one audit as a proper prefix of another: both consume the same rows, so the longer one has more
insertions and costs more. So the least audit of a whole is made of least audits of its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from .support import bounded_batches, materialise

NOT_BLANK = r"[^\x20\x09-\x0D]"
#: Rows of the sorted table that one task parses at a time, and partial cells of a conversation that are joined at a time.
BLOCK_ROWS, FAN_IN = 4096, 64
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

# States of the turn order: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
_GIVEN = {0: 2, 1: 2, 2: 3, 3: 2}  # where an inserted or renamed turn leads
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_ROLE = {2: "user", 3: "assistant"}
_ACCEPTED = [(0, 0), (0, 3)]

Cell = dict[tuple[int, int], tuple[int, str]]


def _joined(left: Cell, right: Cell) -> Cell:
    """(p, q) -> (p, r) (r, q), the least (cost, audit) of each."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (r2, q), (cost2, audit2) in right.items():
            if r == r2:
                found = (cost + cost2, audit + audit2)
                known = out.get((p, q))
                if known is None or found < known:
                    out[p, q] = found
    return out


def _closure() -> Cell:
    none = {(p, p): (0, "") for p in _GIVEN}
    one = none | {(p, q): (INSERT, "I") for p, q in _GIVEN.items()}
    return _joined(one, one)


INSERTED = _closure()
PAIRS = sorted(INSERTED.keys() | {(0, 1)})  # all nonterminals
_LEAVES: dict[tuple[str, bool, bool], Cell] = {}


def leaf(initial: str, must_go: bool, truncated: bool) -> Cell:
    """One row: deleted, or kept or renamed where that leads on; turns may be inserted on both sides."""
    if initial not in _KEPT:
        initial = ""
    if (known := _LEAVES.get((initial, must_go, truncated))) is None:
        cell: Cell = {(p, p): (DELETE, "D") for p in _GIVEN}
        if not must_go:
            more = TRUNCATED if truncated else 0
            kept = {(p, q): (more, "K") for p, q in _KEPT.get(initial, {}).items()}
            named = {(p, q): (REROLE + more, "R") for p, q in _GIVEN.items()}
            for options in (named, kept):
                for pair, found in options.items():
                    cell[pair] = min(cell.get(pair, found), found)
        _LEAVES[initial, must_go, truncated] = known = _joined(_joined(INSERTED, cell), INSERTED)
    return known


def parsed(cells: list[Cell]) -> Cell:
    """The cell of a whole sequence of spans: neighbours are joined, span length by span length."""
    while len(cells) > 1:
        cells = [_joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[pair] for pair in _ACCEPTED if pair in cell)


# --- relations -------------------------------------------------------------------------------------------------------

_SPAN = "part long, first string, last string, illegal long, costs array<long>, audits array<string>"


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class _Span:
    """What is known of a run of rows: its outer initials, illegal neighbours and its cell."""

    def __init__(self):
        self.first = self.last = None
        self.illegal, self.cells = 0, []

    def add(self, first: str, last: str, illegal: int, cell: Cell) -> None:
        self.illegal += illegal + (self.last is not None and not _legal(self.last, first))
        self.first = first if self.first is None else self.first
        self.last = last
        self.cells.append(cell)

    def row(self) -> tuple:
        cell = parsed(self.cells)
        found = [cell.get(pair) for pair in PAIRS]
        return self.first, self.last, self.illegal, [f and f[0] for f in found], [f and f[1] for f in found]


def _span_batch(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    kinds = [conv, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv", "part", "first", "last", "illegal", "costs", "audits"])


def _parse_spans(leaves: bool):
    """Rows (or partial cells) come sorted; those that follow each other with equal conversation and part make one span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, key, done = None, None, []
        for batch in batches:
            kind = batch.column(0).type
            for conv, part, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if span is None or (conv, part) != key:
                    if span is not None:
                        done.append((*key, *span.row()))
                    span, key = _Span(), (conv, part)
                if leaves:
                    initial, must_go, truncated = rest[1:]
                    span.add(initial, initial, 0, leaf(initial, must_go, truncated))
                else:
                    first, last, illegal, costs, audits = rest[1:]
                    span.add(first, last, illegal, {pair: (c, a) for pair, c, a in zip(PAIRS, costs, audits, strict=True) if c is not None})
                if len(done) >= 1000:
                    yield _span_batch(done, kind)
                    done = []
        if span is not None:
            yield _span_batch([*done, (*key, *span.row())], kind)

    return run


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text`` after the faults that ``crc32(conv:turn) % 20`` names: 0 drops a row, 1 empties its text, 2 removes
    its ``.!?``, 3 repeats it, 4 sets its role to user. A null is one blank (in the key, and as role or text)."""
    blank = F.lit(" ")
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    fault = F.crc32(F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))) % 20
    known = rows.select(conv.alias("conv"), turn.alias("turn"), F.coalesce(role, blank).alias("role"), F.coalesce(text, blank).alias("text"), fault.alias("_fault")).filter("_fault <> 0")
    times = F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    changed = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return known.select("conv", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), times.alias("_time")).drop("_time")


def faulty_rows(rows: DataFrame) -> DataFrame:
    """``rows(conv, turn, role, text)`` in order, written: ``_rank`` (by conversation, then turn with nulls first, role and text,
    so ties have an order), and the first fault of each row as ``fault``: blank, duplicate, truncated or null."""
    order = ranked(rows, ["conv", "turn", "role", "text"])
    order = materialise(order.withColumn("_text", F.sha2(F.encode("text", "UTF-8"), 256)), "repair-rows")
    firsts = order.groupBy("conv", "role", "_text").agg(F.min("_rank").alias("_rank")).select("_rank", F.lit(True).alias("_first"))
    blank = ~F.col("text").rlike(NOT_BLANK)
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "blank").when(F.col("_first").isNull(), "duplicate").when(~ended, "truncated")
    return materialise(order.join(firsts, "_rank", "left").select("_rank", "conv", "turn", "role", "text", fault.alias("fault")), "repair-faults")


def cheapest_edits(rows: DataFrame) -> DataFrame:
    """``conv, cost, audit, illegal`` of each conversation of ``faulty_rows``. Blocks of the sorted table, never more than
    ``BLOCK_ROWS`` rows, are parsed by tasks; a conversation over several blocks has a cell for each, joined ``FAN_IN`` at a time."""
    kind = rows.schema["conv"].dataType.simpleString()
    block = F.floor(F.col("_rank") / BLOCK_ROWS).cast("long")
    leaves = rows.select(
        "conv", block.alias("part"), "_rank", F.substring("role", 1, 1).alias("initial"), F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("must_go"),
        F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("truncated"),
    )
    schema = f"conv {kind}, {_SPAN}"
    cells = materialise(leaves.repartition("part").sortWithinPartitions("part", "_rank").mapInArrow(_parse_spans(True), schema), "repair-cells")
    while True:
        several = cells.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
        if not several:
            break
        up = cells.withColumn("_order", F.col("part")).withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).select("conv", "part", "_order", "first", "last", "illegal", "costs", "audits")
        cells = materialise(up.repartition("conv", "part").sortWithinPartitions("conv", "part", "_order").mapInArrow(_parse_spans(False), schema), "repair-cells")
    at = [PAIRS.index(pair) for pair in _ACCEPTED]

    def option(i: int) -> Column:
        return F.when(F.col("costs")[i].isNotNull(), F.struct(F.col("costs")[i].alias("cost"), F.col("audits")[i].alias("audit")))

    return cells.select("conv", F.least(*[option(i) for i in at]).alias("_best"), "illegal").select("conv", "_best.cost", "_best.audit", "illegal")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation first its audit, then its rows in order; gives its turns after (and rows without) each edit."""
    audit, at, state, key, position = "", 0, 0, None, 0

    def given(edit: str, role: str, text: str) -> tuple:
        nonlocal position, state
        state = _KEPT[role[:1]][state] if edit == "K" else _GIVEN[state]
        position += 1
        return key, position - 1, edit, role if edit == "K" else _ROLE[state], text

    for batch in batches:
        out, kind = [], batch.column(0).type
        for conv, rank, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if rank < 0:
                audit, at, state, key, position = text, 0, 0, conv, 0
            else:
                edit = audit[at]
                at += 1
                if edit == "D":
                    out.append((key, None, "D", role, text))
                else:
                    out.append(given(edit, role, text))
            while at < len(audit) and audit[at] == "I":
                out.append(given("I", "", ""))
                at += 1
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kind, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["conv", "position", "edit", "role", "text"])


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``conv, position, edit, role, text``: the turns of the repaired conversations in order, and the deleted rows (edit D, no
    position). Conversations are spread by hash and stream through a sort, so memory doesn't grow with a conversation's texts."""
    bounded_batches(rows.sparkSession)
    told = edits.select("conv", F.lit(-1).cast("long").alias("_rank"), F.lit("").alias("role"), F.col("audit").alias("text"))
    kind = rows.schema["conv"].dataType.simpleString()
    sorted_rows = told.unionByName(rows.select("conv", "_rank", "role", "text")).repartition("conv").sortWithinPartitions("conv", "_rank")
    return sorted_rows.mapInArrow(_edited, f"conv {kind}, position long, edit string, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, key, found = None, None, []

    def batch_of(rows: list, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], ["conv", "repaired_sha256"])

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for conv, position, role, text in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4)], strict=True):
            if known is None or conv != key:
                if known is not None:
                    found.append((key, known.hexdigest()))
                known, key = hashlib.sha256(), conv
            if position is not None:
                known.update((("\n" if position else "") + role + ":" + text).encode())
        if len(found) >= 1000:
            yield batch_of(found, kind)
            found = []
    if known is not None:
        yield batch_of([*found, (key, known.hexdigest())], kind)


def repair_report(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damages ``rows``, repairs them and returns one row for each conversation of ``rows``: its id (null is one conversation),
    ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Nulls in role or text are one blank. Turns that tie are ordered by role and text; rows that repeat are duplicates. Roles of other
    initials than s, u and a can only be renamed or deleted. A conversation that damage leaves no row has zeros, an empty audit
    and the hash of nothing. An empty table gives no rows; other columns are ignored.

    SHA-256 takes its bytes in order, so one task feeds it the turns of one conversation, in bounded memory; all else is parted.
    """
    left = damaged(rows, conv_col, turn_col, role_col, text_col)
    faults = faulty_rows(left)
    edits = materialise(cheapest_edits(faults), "repair-edits")
    kind = faults.schema["conv"].dataType.simpleString()
    digests = repaired_turns(faults, edits).mapInArrow(_digests, f"conv {kind}, repaired_sha256 string")
    counts = faults.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum((F.col("fault") == F.lit(f)).cast("int")).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    found = rows.select(F.col(f"`{conv_col}`").alias("_conv")).distinct()
    for number, more in enumerate((counts, edits, digests)):
        key = f"_conv{number}"
        more = more.withColumnRenamed("conv", key)
        found = found.join(more, F.col("_conv").eqNullSafe(F.col(key)), "left").drop(key)
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("_conv").alias(conv_col), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
