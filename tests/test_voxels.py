"""Thinned volumes against a plain sequential version and planted shapes."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquilt.operators import graphs, skeletons, voxels

ZYX = voxels.ZYX


def frame(spark, cells):
    return spark.createDataFrame([tuple(map(int, c)) for c in cells], "iz long, iy long, ix long")


def parts(cells, near):
    """Number of components of a set of cells."""
    left, n = set(cells), 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            p = todo.pop()
            for q in [q for q in left if near(p, q)]:
                left.discard(q)
                todo.append(q)
    return n


corner = lambda p, q: max(abs(a - b) for a, b in zip(p, q, strict=True)) == 1
face = lambda p, q: sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1


def plainly_simple(cells, p):
    around = [tuple(a + b for a, b in zip(p, o, strict=True)) for o in voxels.OFFSETS]
    fore = [q for q in around if q in cells]
    back = [q for q in around if q not in cells and sum(abs(a - b) for a, b in zip(p, q, strict=True)) <= 2]
    left, seen = set(back), set()
    sides = [q for q in back if face(p, q)]
    if not sides:
        return False
    todo = [sides[0]]
    while todo:
        q = todo.pop()
        seen.add(q)
        todo += [r for r in left if r not in seen and face(q, r)]
    return parts(fore, corner) == 1 and all(q in seen for q in sides)


def plainly_thinned(cells):
    cells = set(cells)
    while True:
        border = [p for p in cells if any(tuple(a + b for a, b in zip(p, o, strict=True)) not in cells for o in voxels.OFFSETS if sum(map(abs, o)) == 1)]
        before = len(cells)
        for f in itertools.product((0, 1), repeat=3):
            for p in [p for p in border if tuple(v & 1 for v in p) == f]:
                n = sum(tuple(a + b for a, b in zip(p, o, strict=True)) in cells for o in voxels.OFFSETS)
                if n > 1 and plainly_simple(cells, p):
                    cells.discard(p)
        if len(cells) == before:
            return cells


def holes(cells):
    """Vertices - edges + faces - solids of the cubes: components - tunnels + cavities."""
    count = 0
    for dims in itertools.product((0, 1), repeat=3):
        made = set()
        for p in cells:
            for t in itertools.product(*[(0,) if d else (0, 1) for d in dims]):
                made.add(tuple(a + b for a, b in zip(p, t, strict=True)))
        count += (-1) ** sum(dims) * len(made)
    return count


def torus(big, small, at=(0, 0, 0)):
    r = big + small + 1
    return {
        (z + at[0], y + at[1], x + at[2]) for z in range(-small - 1, small + 2) for y in range(-r, r + 1) for x in range(-r, r + 1)
        if (np.hypot(x, y) - big) ** 2 + z * z <= small * small
    }


def test_simple_codes_equal_the_definition(spark):
    rng = np.random.default_rng(1)
    cells = {tuple(c) for c in np.argwhere(rng.random((7, 7, 7)) < 0.4) - 3}
    got = voxels.neighbour_codes(frame(spark, list(cells) * 2)).withColumn("s", voxels.is_simple(F.col("code"))).collect()
    assert len(got) == len(cells)
    assert {(r.iz, r.iy, r.ix): r.s for r in got} == {p: plainly_simple(cells, p) for p in cells}
    assert voxels.simple(np.array([0, (1 << 26) - 1])).tolist() == [False, False]


@pytest.mark.parametrize("side", [5, 64])
def test_thinning_equals_the_sequence_whatever_the_blocks(spark, side):
    rng = np.random.default_rng(side)
    noise = {tuple(c) for c in np.argwhere(rng.random((9, 9, 9)) < 0.6) - 4}
    cells = noise | {(z, y, x) for z in range(20, 25) for y in range(-3, 3) for x in range(30)}
    got = {tuple(r) for r in voxels.thin(frame(spark, cells).withColumn("extra", F.lit(1)), side).select(*ZYX).collect()}
    assert got == plainly_thinned(cells)


def test_tori_become_rings(spark):
    cells = torus(9, 3) | torus(7, 2, (20, 0, 40))
    thin = voxels.thin(frame(spark, cells), 16)
    got = {tuple(r) for r in thin.collect()}
    assert holes(cells) == holes(got) == 0 and len(got) < len(cells) / 8
    assert parts(got, corner) == 2
    edges = voxels.voxel_edges(thin)
    assert edges.count() - len(got) + 2 == 2  # one independent cycle each
    line = skeletons.traced(edges).select("start", "end", *voxels.unpacked(F.col("vid"))).collect()
    assert {(r.iz, r.iy, r.ix) for r in line} == got


def test_cavities_ends_and_empty_volumes(spark):
    shell = {p for p in itertools.product(range(7), repeat=3) if p != (3, 3, 3)}
    got = {tuple(r) for r in voxels.thin(frame(spark, shell)).collect()}
    assert holes(got) == holes(shell) == 2  # a component and a cavity
    line = [(5, 5, x) for x in range(-4, 6)]
    assert {tuple(r) for r in voxels.thin(frame(spark, line)).collect()} == set(line)
    assert {(r.ix, r.degree) for r in voxels.skeleton_nodes(frame(spark, line)).collect()} == {(-4, 1), (5, 1)}
    assert voxels.thin(frame(spark, [])).count() == 0 and voxels.voxel_edges(frame(spark, [])).count() == 0
    bend = voxels.voxel_edges(frame(spark, [(0, 0, 0), (0, 0, 1), (0, 1, 1), (1, 2, 2)]))
    assert bend.count() == 3 and graphs.degrees(bend).where("degree = 1").count() == 2
    at = voxels.to_world(frame(spark, [(1, 2, 3)]), 0.5, (1.0, 0.0, -1.0)).first()
    assert (at.x, at.y, at.z) == (2.75, 1.25, -0.25)
    back = frame(spark, [(-5, 7, -1)]).select(voxels.packed(*[F.col(c) for c in ZYX]).alias("v")).select(*voxels.unpacked(F.col("v"))).first()
    assert tuple(back) == (-5, 7, -1)
