"""Parts and holes of rasters against flood fill."""

from __future__ import annotations

import numpy as np
import pytest

from geoquilt.operators import parts


def flood(cells, starts, corners, inside):
    seen, todo = set(starts), list(starts)
    while todo:
        r, c = todo.pop()
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                p = (r + dr, c + dc)
                if (corners or dr * dc == 0) and p not in seen and inside(p):
                    seen.add(p)
                    todo.append(p)
    return seen


@pytest.mark.parametrize("share", [0.35, 0.6])
def test_parts_and_holes_equal_flood_fill(spark, share):
    rng = np.random.default_rng(int(100 * share))
    cells = {(int(r) - 5, int(c) + 3) for r, c in np.argwhere(rng.random((25, 30)) < share)} - {(4, c) for c in range(40)}
    frame = spark.createDataFrame([*cells, *list(cells)[:9]], "row long, col long").repartition(3)
    left, found = set(cells), []
    while left:
        part = flood(cells, [min(left)], True, cells.__contains__)
        found.append(part)
        left -= part
    want = max(found, key=lambda p: (len(p), [-x for x in min(p)]))
    got = [tuple(r) for r in parts.largest_part(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    rows, cols = [r for r, _ in cells], [c for _, c in cells]
    box = lambda p: min(rows) - 1 <= p[0] <= max(rows) + 1 and min(cols) - 1 <= p[1] <= max(cols) + 1
    outside = flood(cells, [(min(rows) - 1, min(cols) - 1)], False, lambda p: box(p) and p not in cells)
    filled = {(r, c) for r in range(min(rows), max(rows) + 1) for c in range(min(cols), max(cols) + 1)} - outside
    got = [tuple(r) for r in parts.fill_holes(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == filled
    assert parts.fill_holes(frame.where("false")).count() == parts.largest_part(frame.where("false")).count() == 0
