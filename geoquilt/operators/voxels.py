"""Curve thinning of sparse voxel sets (iz, iy, ix), and the skeleton's graph.

A voxel may go where its removal changes no topology: its foreground neighbours
(of 26) hang together, and so do its background neighbours by faces, seen within
its 18 neighbours.  The neighbourhood is a number of 26 bits and the two floods
are bit operations on whole batches of numbers.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquilt.storage import discard, stored

ZYX = ("iz", "iy", "ix")
#: The neighbours in the order of their bits.
OFFSETS = tuple(o for o in itertools.product((-1, 0, 1), repeat=3) if any(o))


def _bits(test) -> int:
    return sum(1 << n for n, o in enumerate(OFFSETS) if test(o))


FACES = _bits(lambda o: sum(map(abs, o)) == 1)
EIGHTEEN = _bits(lambda o: sum(map(abs, o)) <= 2)
#: For each neighbour, those that touch it by a corner, and those that touch it by a face.
TOUCHING = tuple(_bits(lambda o, p=p: o != p and max(abs(a - b) for a, b in zip(o, p, strict=True)) == 1) for p in OFFSETS)
BESIDE = tuple(_bits(lambda o, p=p: sum(abs(a - b) for a, b in zip(o, p, strict=True)) == 1) for p in OFFSETS)
#: A voxel's index in one number: 20 bits and a shift for either sign, so that order is (iz, iy, ix).
REACH = 1 << 20


def _flooded(seed: np.ndarray, allowed: np.ndarray, touching: tuple[int, ...]) -> np.ndarray:
    while True:
        grown = seed.copy()
        for n, reached in enumerate(touching):
            grown |= (seed >> n & 1) * reached
        grown &= allowed
        if np.array_equal(grown, seed):
            return seed
        seed = grown


def simple(codes: np.ndarray) -> np.ndarray:
    """Whether a voxel with these neighbours may go without a change of components, tunnels or cavities."""
    codes, where = np.unique(codes.astype(np.int64), return_inverse=True)
    behind = ~codes & EIGHTEEN
    faces = behind & FACES
    one = _flooded(codes & -codes, codes, TOUCHING) == codes
    around = _flooded(faces & -faces, behind, BESIDE) & faces == faces
    return ((codes > 0) & (faces > 0) & one & around)[where]


def neighbour_codes(voxels: DataFrame) -> DataFrame:
    """(iz, iy, ix, code): the 26 neighbours of every voxel as bits in the order of ``OFFSETS``; repeated rows count once."""
    voxels = voxels.select(*ZYX).distinct()
    steps = F.array(*[F.struct(F.lit(1 << n).alias("bit"), *[F.lit(-v).alias(f"d{c}") for v, c in zip(o, ZYX, strict=True)]) for n, o in enumerate(OFFSETS)])
    sent = voxels.select(*ZYX, F.inline(steps)).select(*[(F.col(c) + F.col(f"d{c}")).alias(c) for c in ZYX], "bit")
    own = voxels.select(*ZYX, F.lit(0).alias("bit"), F.lit(True).alias("own"))
    every = sent.withColumn("own", F.lit(False)).unionByName(own).groupBy(*ZYX)
    return every.agg(F.sum("bit").cast("long").alias("code"), F.max("own").alias("own")).where("own").drop("own")


def is_simple(code: Column) -> Column:
    """``simple`` on a column of neighbourhood codes."""

    @F.pandas_udf("boolean")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(simple(part.to_numpy()))

    return judge(code)


def _thinned(grid: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """One round on a dense block whose first cell has the index ``corner``; its outermost nine layers are not final."""
    full = np.pad(grid, 1)
    at = np.argwhere(full)
    border = np.zeros(len(at), dtype=bool)
    for o in OFFSETS:
        if sum(map(abs, o)) == 1:
            border |= ~full[tuple((at + o).T)]
    at = at[border]
    field = ((at - 1 + corner) & 1) @ np.array([4, 2, 1])
    for f in range(8):
        here = at[field == f]
        if not len(here):
            continue
        codes = np.zeros(len(here), dtype=np.int64)
        for n, o in enumerate(OFFSETS):
            codes |= full[tuple((here + o).T)].astype(np.int64) << n
        ends = codes & (codes - 1) == 0  # at most one neighbour
        full[tuple(here[simple(codes) & ~ends].T)] = False
    return full[1:-1, 1:-1, 1:-1]


def thin_round(voxels: DataFrame, side: int = 64) -> DataFrame:
    """The voxels that one round of thinning keeps.

    The voxels of the border at the start of the round are judged field by field,
    a field being those of equal parities; no two voxels of a field touch, so they
    go together without a change of topology.  Line ends stay.  Blocks of ``side``
    cells come with a margin of nine, as far as eight fields and the first look
    reach, so a block's result does not depend on how the volume is dealt; a task
    holds one block, (side + 18)^3 cells at most, one byte each.
    """
    margin = 9
    dealt = voxels.select(*ZYX)
    for c in ZYX:
        low, high = (F.floor((F.col(c) + m) / side).cast("long") for m in (-margin, margin))
        dealt = dealt.withColumn(f"b{c}", F.explode(F.sequence(low, high)))

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        corner = np.array(key, dtype=np.int64) * side - margin
        grid = np.zeros((side + 2 * margin,) * 3, dtype=bool)
        grid[tuple((rows[list(ZYX)].to_numpy(dtype=np.int64) - corner).T)] = True
        inner = slice(margin, margin + side)
        if not grid[inner, inner, inner].any():
            return pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ZYX})
        kept = np.argwhere(_thinned(grid, corner)[inner, inner, inner]) + corner + margin
        return pd.DataFrame(kept.astype(np.int64), columns=list(ZYX))

    return dealt.groupBy("biz", "biy", "bix").applyInPandas(block, ", ".join(f"{c} long" for c in ZYX))


def thin(voxels: DataFrame, side: int = 64, max_rounds: int = 10_000) -> DataFrame:
    """Curve skeleton (iz, iy, ix): rounds of ``thin_round`` until none takes a voxel; each is stored.

    The number of rounds is about half the greatest thickness.  Components,
    tunnels and cavities stay as they are; an empty set stays empty, repeated rows
    count once, and a voxel with a null index is an error of the caller.
    """
    now = stored(voxels.select(*[F.col(c).cast("long").alias(c) for c in ZYX]).distinct(), "voxels")
    n = now.count()
    for _ in range(max_rounds):
        before, now = now, stored(thin_round(now, side), "voxels")
        discard(before)
        if n == (n := now.count()):
            return now
    raise RuntimeError("thinning did not settle")


def skeleton_nodes(voxels: DataFrame) -> DataFrame:
    """(iz, iy, ix, degree): line ends, junctions and lone voxels, which are those that do not have two of 26 neighbours."""
    return neighbour_codes(voxels).select(*ZYX, F.bit_count("code").cast("long").alias("degree")).where("degree <> 2")


def packed(*index: Column) -> Column:
    """One number for (iz, iy, ix), each within 2^20 of zero, in their order."""
    z, y, x = (c + REACH for c in index)
    return (z * 2 * REACH + y) * 2 * REACH + x


def unpacked(vid: Column) -> list[Column]:
    """iz, iy, ix of a ``packed`` number."""
    cut = lambda shift: F.shiftrightunsigned(vid, shift).bitwiseAND(2 * REACH - 1) - REACH
    return [cut(s).cast("long").alias(c) for s, c in zip((42, 21, 0), ZYX, strict=True)]


def voxel_edges(voxels: DataFrame) -> DataFrame:
    """Canonical edges (u, v) between packed voxels that touch; short cuts across a corner go.

    Two voxels are not linked by an edge or a corner where a third touches both
    by a shorter way, so that a bend is one line and no triangle.
    """
    at = packed(*[F.col(c) for c in ZYX])
    codes = neighbour_codes(voxels)
    steps = []
    for n, o in enumerate(OFFSETS):
        if o < (0, 0, 0):
            continue
        apart = lambda p, q: sum(abs(a - b) for a, b in zip(p, q, strict=True))
        near = lambda p, q: max(abs(a - b) for a, b in zip(p, q, strict=True)) == 1
        length = apart(o, (0, 0, 0))
        short = _bits(lambda p, o=o, length=length: p != o and near(p, o) and apart(p, (0, 0, 0)) < length and apart(p, o) < length)
        ahead = o[0] * (2 * REACH) ** 2 + o[1] * 2 * REACH + o[2]
        steps.append(F.struct(F.lit(1 << n).cast("long").alias("bit"), F.lit(short).cast("long").alias("short"), F.lit(ahead).cast("long").alias("ahead")))
    linked = codes.select(at.alias("u"), "code", F.inline(F.array(*steps)))
    kept = (F.col("code").bitwiseAND(F.col("bit")) != 0) & (F.col("code").bitwiseAND(F.col("short")) == 0)
    return linked.where(kept).select("u", (F.col("u") + F.col("ahead")).alias("v"))


def to_world(voxels: DataFrame, size: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """The rows with x, y, z of the middle of their voxel; ``origin`` is (x, y, z) of the first voxel's corner."""
    return voxels.withColumns({c: (F.col(f"i{c}") + 0.5) * size + o for c, o in zip("xyz", origin, strict=True)})
