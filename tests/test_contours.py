"""Outlines against a tracer that walks them, hidden parts against a plain walk, holes and openings of sparse scenes."""

import numpy as np
import pytest

from tidemark.operators import components, contours, morphology

CELLS = "scene_id string, row long, col long"


def frame(spark, cells, scene="s"):
    return spark.createDataFrame([(scene, int(r), int(c)) for r, c in cells], CELLS)


def dims(spark, h, w, scene="s"):
    return spark.createDataFrame([(scene, h, w)], "scene_id string, height long, width long")


def traced(cells: set, join_high: bool) -> dict:
    """Rings by walking along cell edges with true cells to the right; turns at corners that touch as ``join_high`` says."""
    moves = {}  # between two cells: point (doubled) and direction to the points that may follow
    for r, c in cells:
        for (r2, c2), way in (((r - 1, c), (0, 1)), ((r + 1, c), (0, -1)), ((r, c - 1), (-1, 0)), ((r, c + 1), (1, 0))):
            if (r2, c2) not in cells:
                moves[r + r2, c + c2] = way
    rings, left = {}, set(moves)
    while left:
        start = min(left)
        ring, at = [], start
        while not ring or at != start:
            ring.append(at)
            left.discard(at)
            dy, dx = moves[at]
            right, ahead, other = (at[0] + dy + dx, at[1] + dx - dy), (at[0] + 2 * dy, at[1] + 2 * dx), (at[0] + dy - dx, at[1] + dx + dy)
            turns = [(right, (dx, -dy)), (other, (-dx, dy))]
            if join_high:
                turns.reverse()
            options = [p for p, way in (turns[0], (ahead, (dy, dx)), turns[1]) if moves.get(p) == way]
            at = options[0]
        rings[start] = ring
    return rings


MASKS = {
    "cell": {(0, 0)}, "corner": {(0, 0), (1, 1)}, "hole": {(r, c) for r in range(5) for c in range(6)} - {(2, 2), (2, 3)},
    "cross": {(0, 1), (1, 0), (1, 2), (2, 1)}, "line": {(3, c) for c in range(40)}, "empty": set(),
    "noise": {tuple(map(int, x)) for x in np.argwhere(np.random.default_rng(5).random((25, 31)) < 0.45)},
}


@pytest.mark.parametrize("join_high", [False, True])
def test_rings_equal_a_tracer(spark, join_high):
    rows = [(name, r, c) for name, cells in MASKS.items() for r, c in [*cells, *list(cells)[:2]]]  # some cells repeat
    got = {}
    for p in contours.contours(spark.createDataFrame(rows, CELLS), join_high).collect():
        got.setdefault((p["scene_id"], 2 * p["ring_row"], 2 * p["ring_col"]), {})[p["position"]] = (2 * p["row"], 2 * p["col"])
        assert p["length"] > 3
    want = {(name, *start): dict(enumerate(ring)) for name, cells in MASKS.items() for start, ring in traced(cells, join_high).items()}
    assert got == want


def test_long_rings(spark):
    """A spiral: one ring of some thousand points."""
    cells, (r, c), (dr, dc), n = set(), (40, 40), (0, 1), 2
    while n < 60:
        for _ in range(n):
            cells.add((r, c))
            r, c = r + dr, c + dc
        dr, dc, n = dc, -dr, n + 2
    (ring,) = traced(cells, False).values()
    got = contours.contours(frame(spark, cells)).orderBy("position").collect()
    assert [(2 * p["row"], 2 * p["col"]) for p in got] == ring and len(ring) > 1500


def plain_parts(ring, hidden, h, w):
    """Parts of a closed ring between hidden points, each at least two points long."""
    near = lambda p: (min(max(round(p[0] / 2), 0), h - 1), min(max(round(p[1] / 2), 0), w - 1))
    seen = [near(p) not in hidden for p in ring]
    if all(seen):
        return [ring]
    first = seen.index(False)
    parts, current = [], []
    for p, ok in zip(ring[first:] + ring[:first], seen[first:] + seen[:first], strict=True):
        if ok:
            current.append(p)
        elif current:
            parts.append(current)
            current = []
    return [p for p in [*parts, current] if len(p) > 1]


def test_visible_parts_equal_a_plain_walk(spark):
    cells = MASKS["noise"] | {(r, c) for r in range(3, 12) for c in range(4, 20)}
    rng = np.random.default_rng(6)
    hidden = {tuple(map(int, x)) for x in np.argwhere(rng.random((25, 31)) < 0.2)}
    outline = contours.contours(frame(spark, cells))
    got = {}
    for p in contours.visible_parts(outline, frame(spark, hidden), dims(spark, 25, 31)).collect():
        got.setdefault((p["ring_row"], p["ring_col"], p["part"]), []).append((p["position"], (int(2 * p["row"]), int(2 * p["col"]))))
    want = [part for ring in traced(cells, False).values() for part in plain_parts(ring, hidden, 25, 31)]
    assert sorted([p for _, p in sorted(part)] for part in got.values()) == sorted(want)
    clear = contours.visible_parts(outline, frame(spark, set()), dims(spark, 25, 31))
    assert clear.count() == outline.count()


def brute_holes(cells, h, w):
    open_, stack = set(), [(r, c) for r in range(h) for c in range(w) if (r in (0, h - 1) or c in (0, w - 1)) and (r, c) not in cells]
    while stack:
        r, c = stack.pop()
        if (r, c) not in open_:
            open_.add((r, c))
            stack += [(r + a, c + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= r + a < h and 0 <= c + b < w and (r + a, c + b) not in cells]
    return {(r, c) for r in range(h) for c in range(w)} - open_


def test_holes_by_gaps(spark):
    rng = np.random.default_rng(7)
    for density, h, w in ((0.5, 30, 40), (0.65, 23, 23), (0.9, 12, 50), (0.3, 1, 20), (1.1, 5, 5)):
        cells = {tuple(map(int, x)) for x in np.argwhere(rng.random((h, w)) < density)}
        got = components.holes_filled(frame(spark, cells), dims(spark, h, w)).collect()
        assert {(r["row"], r["col"]) for r in got} == brute_holes(cells, h, w) and len(got) == len({(r["row"], r["col"]) for r in got})


def ring(top, left, h, w):
    return {(top, c) for c in range(left, left + w)} | {(top + h - 1, c) for c in range(left, left + w)} | {(r, left) for r in range(top, top + h)} | {(r, left + w - 1) for r in range(top, top + h)}


def test_sparse_scene_of_ten_thousand_million_cells(spark):
    """Work follows the runs: a few shapes in a scene of 100,000 x 100,000 cells."""
    side = 100_000
    cells = ring(50_000, 70_000, 30, 3000) | ring(10, 10, 4, 5) | (ring(0, 99_000, 6, 6) - {(0, 99_003)})
    assert {(r["row"], r["c0"], r["c1"]) for r in components.hole_runs(morphology.runs_of(frame(spark, cells)), dims(spark, side, side)).groupBy("row").agg({"c0": "min", "c1": "max"}).withColumnsRenamed({"min(c0)": "c0", "max(c1)": "c1"}).collect()} == {
        *((r, 70_001, 72_998) for r in range(50_001, 50_029)), (11, 11, 13), (12, 11, 13),
    }
    opened = morphology.opened_runs(morphology.runs_of(frame(spark, {(r, c) for r in range(500, 520) for c in range(60_000, 60_030)} | {(7, 99_999)})), dims(spark, side, side), morphology.disk(2)).collect()
    assert {r["row"] for r in opened} == set(range(500, 520)) and min(r["c0"] for r in opened) == 60_000


def test_plans_move_runs_and_not_cells(spark):
    mask = frame(spark, {(1, 1)})
    plan = morphology.opened_runs(morphology.runs_of(mask), dims(spark, 9, 9), morphology.disk(2))._jdf.queryExecution().toString()
    assert "sequence" not in plan.split("== Physical Plan ==")[1]
