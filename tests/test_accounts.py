"""Accounts of dark cells tell what is wrong with them."""

from tidemark.plans import detection

CELLS = "scene_id string, row long, col long"


def test_broken_parts(spark):
    def frame(cells, flags=None):
        rows = [("s", r, c, *(() if flags is None else (flags[r, c],))) for r, c in cells]
        return spark.createDataFrame(rows, CELLS + ("" if flags is None else ", rejected_by_screener boolean"))

    layer = [(0, 0), (0, 1), (0, 2), (5, 5)]
    flags = {(0, 0): True, (0, 1): False, (0, 2): False, (5, 5): True, (9, 9): False}
    good = detection.broken_parts(frame(layer), frame([(0, 0), (5, 5), (7, 7)]), frame([(3, 3)]), frame(layer, flags)).first()
    assert tuple(good) == (0, 0, 0, 0, 0)
    parts = [(0, 0), (0, 0), (0, 1), (5, 5), (9, 9)]  # one twice, one missing, one from elsewhere
    bad = detection.broken_parts(frame(layer), frame([(0, 0), (0, 1)]), frame([(0, 1), (9, 9)]), frame(parts, flags)).first()
    assert bad.asDict() == {"overlap": 2, "missing": 1, "extra": 1, "repeated": 1, "misattributed": 2}
