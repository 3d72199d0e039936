"""Filter interaction audit, conversation repair and suffix dedup, each against a plain version."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair as repair
from tidemark.llm import filter_audit as audit
from tidemark.llm import suffix_dedup as suffix

BLANKS = " \t\n\x0b\x0c\r"


# --- filter audit ----------------------------------------------------------------------------------------------------


def words(text):
    for b in BLANKS[1:]:
        text = text.replace(b, " ")
    return [w for w in text.split(" ") if w]


def plain_audit(docs, labels):
    fails = []
    for i, text, part in docs:
        text = text or ""
        w = words(text)
        bad = set()
        bad |= {"A"} if len(w) < 200 else set()
        bad |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        bad |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else set()
        bad |= {"D"} if any(c in "#$%&*|" for c in text) else set()
        bad |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs) else set()
        fails.append((part or "", bad, any(x == i and q == 1 for x, q, _ in labels if i is not None), any(x == i and t == 1 for x, _, t in labels if i is not None)))
    out = {}
    for order in permutations("ABCDE"):
        alive = list(range(len(docs)))
        for step, f in enumerate(order, 1):
            gone = [k for k in alive if f in fails[k][1]]
            alive = [k for k in alive if f not in fails[k][1]]
            for part in {x[0] for x in fails}:
                of = [k for k in range(len(docs)) if fails[k][0] == part]
                mine = [k for k in gone if fails[k][0] == part]
                out[part, "".join(order), step] = [
                    sum(fails[k][0] == part for k in alive), len(mine), sum(f in fails[k][1] for k in of) - len(mine), sum(fails[k][1] == {f} for k in of), sum(fails[k][2] for k in mine), sum(fails[k][3] for k in mine),
                ]
    shapley = Counter()
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] += v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("part", F.lit("x")).withColumn("good", F.lit(7)).withColumn("_row", F.lit(0))
    found = audit.audit_documents(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    assert len(got) == len(found)
    return got


def test_audit_equals_plain_version_on_odd_rows(spark):
    rng = random.Random(3)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", " \t\x0b", long, long, long + " #", long.upper(), "same " * 300, "Some Words | here", "tab\tand\x0bother\x85space", long.replace(" ", "\x0c"), long]
    docs = [(i if i % 7 else None, texts[i % len(texts)], rng.choice([None, "", "web", "hot"])) for i in range(40)] + [(5, long, "hot"), (5, long, "hot"), (5, "other", "hot")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(30)] + [(None, 1, 1), (3, 1, None), (3, 0, 1), (4, None, None)]
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_of_an_empty_table_and_of_clean_rows(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    clean = [(i, " ".join(f"w{i}x{k}" for k in range(300)), "a") for i in range(4)]
    got = audited(spark, clean, [])
    assert len(got) == 600 and set(got.values()) == {(4, 0, 0, 0, 0, 0, 0)}


# --- conversation repair ---------------------------------------------------------------------------------------------


def shortest(rows):
    """Least (cost, audit) by Dijkstra over (rows used, role before), without a grammar."""
    heap, done, best = [(0, "", 0, "")], set(), None
    while heap:
        cost, edits, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a") and (best is None or (cost, edits) < best):
            best = cost, edits
        due = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 2, edits + "I", i, due))
        if i < len(rows):
            role, must_go, cut = rows[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, last))
            if not must_go:
                heapq.heappush(heap, (cost + 2 + cut, edits + "R", i + 1, due))
                if role == due or role == "s" and not last:
                    heapq.heappush(heap, (cost + cut, edits + "K", i + 1, role))
    return best


def plain_repair(table):
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        groups[conv]  # noqa: B018
        blank = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if fault:
            row = (turn, "user" if fault == 4 else role, "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text)
            groups[conv] += [row, row] if fault == 3 else [row]
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.strip(BLANKS)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, edits = shortest([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults, strict=True)])
        fixed, left, last = [], iter(rows), ""
        for e in edits:
            row = next(left) if e != "I" else None
            if e == "D":
                continue
            due = "assistant" if last == "u" else "user"
            role = row[1] if e == "K" else due
            fixed.append(f"{role}:{row[2] if row else ''}")
            last = role[0]
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, edits, hashlib.sha256("\n".join(fixed).encode()).hexdigest())
    return out


def repaired(spark, table):
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).withColumn("part", F.lit("x")).withColumn("_rank", F.lit(0))
    found = repair.repair_report(df).collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}
    assert len(got) == len(found)
    return got


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", " ", ""]), st.booleans(), st.booleans()), max_size=9))
def test_parsed_cells_are_the_cheapest_edits(rows):
    if rows:
        assert repair.cheapest(repair.parsed([repair.leaf(*r) for r in rows])) == shortest(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suat"), st.booleans(), st.booleans()), min_size=2, max_size=8), st.data())
def test_every_way_to_cut_a_span_gives_its_cell(rows, data):
    cells = [repair.leaf(*r) for r in rows]
    cut = data.draw(st.integers(1, len(cells) - 1))
    assert repair._joined(repair.parsed(cells[:cut]), repair.parsed(cells[cut:])) == repair.parsed(cells)


def odd_conversations(n, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", None, "  ", "Why? \n", "tail.\x85", "Dots... inside", "é!"]
    return [(rng.choice([None, *range(n // 8)]), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", None, "", "User"]), rng.choice(texts)) for _ in range(n)]


def test_repair_equals_plain_version_on_odd_rows(spark):
    table = odd_conversations(400, 5) + [(9999, 0, "user", "One."), (9999, 1, "assistant", "Two."), (-5, None, None, None)]
    assert repaired(spark, table) == plain_repair(table)
    assert repaired(spark, []) == {}


def test_conversation_that_loses_all_rows(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    assert repaired(spark, [(7, turn, "user", "Gone.")]) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_long_conversations_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_ROWS", 16)
    monkeypatch.setattr(repair, "FAN_IN", 3)
    rng = random.Random(8)
    table = [(1, t, rng.choice(["user", "assistant", "system"]), f"{t}" + rng.choice([".", ""])) for t in range(900)] + odd_conversations(100, 9)
    assert repaired(spark, table) == plain_repair(table)


# --- suffix dedup ----------------------------------------------------------------------------------------------------


def plain_suffixes(docs, length):
    seen = defaultdict(list)
    for n, (_, text) in enumerate(docs):
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            seen[data[i : i + length]].append((n, i))
    hit = [set() for _ in docs]
    for places in seen.values():
        if len(places) > 1:
            for n, i in places:
                hit[n].update(range(i, i + length))
    out = []
    for n, (doc, text) in enumerate(docs):
        data = (text or "").encode()
        spans = sum(i in hit[n] and i - 1 not in hit[n] for i in range(len(data)))
        out.append((doc, len(data), len(hit[n]), spans, hashlib.sha256(bytes(b for i, b in enumerate(data) if i not in hit[n])).hexdigest()))
    return sorted(out, key=repr)


def cut(spark, docs, **parameters):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("data", F.lit("x")).withColumn("begin", F.lit("y"))
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup_report(df, **parameters).collect()], key=repr)


def some_texts(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passages = [prose(k) for k in (20, 33, 40, 60, 150)]
    texts = [None, "", "x" * 199, "x" * 200, "x" * 201, "ab" * 400, "y" * 1000, prose(900)]
    for _ in range(n):
        parts = [prose(rng.randint(0, 60)) for _ in range(3)]
        texts.append(parts[0] + rng.choice(passages) + parts[1] + rng.choice(passages) + parts[2])
    texts += [texts[10], texts[10], texts[11][:-3] + "zzz", texts[7][100:700], texts[12] + texts[12]]
    return texts


def test_suffix_dedup_equals_plain_version(spark, monkeypatch):
    docs = [(i, t) for i, t in enumerate(some_texts(60, 1))]
    assert cut(spark, docs) == plain_suffixes(docs, 200)
    monkeypatch.setattr(suffix, "PIECE", 1 << 10)  # texts longer than a piece
    assert cut(spark, docs, length=64) == plain_suffixes(docs, 64)
    assert cut(spark, []) == []


def test_suffix_dedup_tells_rows_apart(spark):
    texts = some_texts(12, 2)
    docs = [(None if i % 3 == 0 else i % 5, t) for i, t in enumerate(texts)]
    assert cut(spark, docs) == plain_suffixes(docs, 200)


def test_suffix_dedup_of_an_anchor_with_very_many_runs(spark, monkeypatch):
    """One passage in many surroundings is compared in parts, and across parts by hash."""
    monkeypatch.setattr(suffix, "RUNS_AT_ONCE", 5)
    monkeypatch.setattr(suffix, "BYTES_AT_ONCE", 2000)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    sides = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(12)]
    docs = [(i, rng.choice(sides) + passage + rng.choice(sides)) for i in range(80)]
    assert cut(spark, docs) == plain_suffixes(docs, 200)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=12, max_size=40), min_size=1, max_size=5), st.booleans())
def test_suffix_sort_orders_by_bytes(texts, collide):
    """Also where hashes collide: a hash that is always 0 takes all suffixes for equal, and bytes put that right."""
    data = np.array([b for t in texts for b in t], np.uint8)
    suffixes, segments = [], []
    for n in range(3):
        for i in range(n, len(data) - 9, n + 1):
            suffixes.append(i)
            segments.append(n)
    s, g = np.array(suffixes, np.int64), np.array(segments, np.int64)
    of_byte = suffix._OF_BYTE.copy()
    try:
        if collide:
            suffix._OF_BYTE[:] = 0
        order, equal = suffix.sorted_suffixes(data, s, g, 10)
    finally:
        suffix._OF_BYTE[:] = of_byte
    assert sorted(order.tolist()) == list(range(len(s)))
    texts = [bytes(data[i : i + 10]) for i in s[order]]
    assert (g[order] == g).all()
    for k in range(1, len(texts)):
        if g[k] == g[k - 1]:
            assert texts[k - 1] <= texts[k] and equal[k] == (texts[k - 1] == texts[k])


def test_runs_do_not_depend_on_what_surrounds_them():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 105, 3000, dtype=np.uint8)
    found = []
    for before in (0, 10, 333):
        data = np.concatenate([rng.integers(97, 105, before, dtype=np.uint8), passage, rng.integers(97, 105, 50, dtype=np.uint8)])
        begin, count, anchor, gram, run = suffix.piece_runs(data, np.array([len(data)]), len(data))
        inner = (begin > before) & (begin + count + 199 < before + 3000)
        found.append(list(zip((begin[inner] - before).tolist(), count[inner].tolist(), (anchor[inner] - before).tolist(), gram[inner].tolist(), run[inner].tolist(), strict=True)))
    common = set(found[0]) & set(found[1]) & set(found[2])
    assert len(common) >= len(found[0]) - 2 > 2


@pytest.mark.parametrize("n", [1, 5, 9, 40])
def test_window_least(n):
    keys = np.random.default_rng(n).integers(0, 99, 40)
    assert suffix._window_least(keys, n).tolist() == [keys[i : i + n].min() for i in range(40 - n + 1)]
