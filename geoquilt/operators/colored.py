"""Colored registration: point-to-plane and photometric errors, level by level.

Every target point carries the gradient of its intensity in its tangent plane.
A source point is held against the plane of its nearest target point and against
the intensity that the gradient foretells there; the sums of both are solved
together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquilt.functions.linalg import cross, dot, inverse
from geoquilt.operators.registration import NORMAL, Alignment, _rotation, normal_equations, transformed
from geoquilt.operators.spatial import XYZ, radius_join
from geoquilt.storage import stored

GRADIENT = ("gx", "gy", "gz")


def intensity(r: str = "r", g: str = "g", b: str = "b") -> Column:
    """Mean of three color columns in [0, 1]."""
    return ((F.col(r) + F.col(g) + F.col(b)) / 3).alias("shade")


def color_gradients(points: DataFrame, radius: float, least: int = 4) -> DataFrame:
    """``points(pid, x, y, z, nx, ny, nz, shade)`` with gx, gy, gz: the gradient of shade in the tangent plane.

    Least squares over the neighbours within ``radius``, moved into the plane; a
    row that holds the gradient off the normal counts as much as all of them.
    With fewer neighbours than ``least`` the gradient is zero.
    """
    own = [F.col(f"o{c}") for c in (*XYZ, *NORMAL)]
    mine = points.select(F.col("pid").alias("p"), *[F.col(c).alias(f"o{c}") for c in (*XYZ, *NORMAL, "shade")])
    near = radius_join(points.select(F.col("pid").alias("i"), *XYZ), points.select(F.col("pid").alias("j"), *XYZ, "shade"), radius).where("i <> j")
    joined = near.join(mine, F.col("i") == F.col("p"))
    step = [F.col(c) - o for c, o in zip(XYZ, own[:3], strict=True)]
    off = dot(step, own[3:])
    flat = [s - off * n for s, n in zip(step, own[3:], strict=True)]
    rise = F.col("shade") - F.col("oshade")
    names = [(a, b) for a in range(3) for b in range(a, 3)]
    sums = [F.sum(flat[a] * flat[b]).alias(f"s{a}{b}") for a, b in names] + [F.sum(flat[a] * rise).alias(f"t{a}") for a in range(3)]
    found = joined.groupBy("i").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least)
    out = points.join(found, F.col("pid") == F.col("i"), "left")
    normal = [F.col(c) for c in NORMAL]
    trace = F.col("s00") + F.col("s11") + F.col("s22")
    entry = lambda a, b: F.col(f"s{min(a, b)}{max(a, b)}") + trace * normal[a] * normal[b] + (trace * 1e-9 + 1e-12 if a == b else 0.0)
    inv = inverse([[entry(a, b) for b in range(3)] for a in range(3)])
    slope = [dot(row, [F.col(f"t{k}") for k in range(3)]) for row in inv]
    beside = dot(slope, normal)
    flatly = [F.coalesce(s - beside * n, F.lit(0.0)).alias(g) for s, n, g in zip(slope, normal, GRADIENT, strict=True)]
    return out.select("pid", *XYZ, *NORMAL, "shade", *flatly)


def _nearest(source: DataFrame, target: DataFrame, reach: float) -> DataFrame:
    """Each source point (p*, p_shade) with its nearest target point (q*, normal, gradient, shade) within ``reach``; ties go by id."""
    rest = (*NORMAL, "shade", *GRADIENT)
    near = radius_join(source.select(F.col("pid").alias("i"), *XYZ), target.select(F.col("pid").alias("j"), *XYZ), reach)
    best = near.groupBy("i").agg(F.min(F.struct("d", "j")).alias("b")).select("i", "b.d", "b.j")
    own = source.select(F.col("pid").alias("pi"), *[F.col(c).alias(f"p{c}") for c in XYZ], F.col("shade").alias("p_shade"))
    to = target.select(F.col("pid").alias("qj"), *[F.col(c).alias(f"q{c}") for c in XYZ], *rest)
    return best.join(own, F.col("i") == F.col("pi")).join(to, F.col("j") == F.col("qj")).select("d", *[f"p{c}" for c in XYZ], "p_shade", *[f"q{c}" for c in XYZ], *rest)


def colored_icp(source: DataFrame, target: DataFrame, reach: float, rounds: int = 30, start: np.ndarray | None = None, geometric: float = 0.968, tolerance: float = 1e-6) -> Alignment:
    """Align ``source(pid, x, y, z, shade)`` to ``target`` with normals and gradients; ``geometric`` weighs the planes against the colors."""
    t = np.eye(4) if start is None else start
    source = source.select("pid", *XYZ, "shade")
    n = max(1, source.count())
    p, q = ([F.col(f"{k}{c}") for c in XYZ] for k in "pq")
    normal, slope = [F.col(c) for c in NORMAL], [F.col(c) for c in GRADIENT]
    off = dot([a - b for a, b in zip(p, q, strict=True)], normal)
    onto = [a - off * m - b for a, m, b in zip(p, normal, q, strict=True)]
    foretold = F.col("shade") + dot(slope, onto) - F.col("p_shade")
    steep = dot(slope, normal)
    turn = [g - steep * m for g, m in zip(slope, normal, strict=True)]
    plane = ([*cross(p, normal), *normal], off, F.lit(geometric))
    color = ([*cross(p, turn), *turn], foretold, F.lit(1 - geometric))
    for _ in range(rounds):
        v = normal_equations(_nearest(transformed(source, t), target, reach), plane, color)
        t = _rotation(v) @ t
        if np.abs(v).max() < tolerance:
            break
    done = _nearest(transformed(source, t), target, reach).agg(F.count("*").alias("n"), F.avg(F.col("d") * F.col("d")).alias("s")).first()
    return Alignment(t, done["n"] / n, float(done["s"] or 0.0) ** 0.5)


def colored_levels(
    source: DataFrame, target: DataFrame, start: Alignment, reaches: Sequence[float], rounds: Sequence[int],
    enable: float = 0.2, proceed: float = 0.3, widen: float = 2.0,
) -> Alignment:
    """Colored registration from coarse to fine, with the gates of fitness.

    A start below ``enable`` is returned as it is.  Below ``proceed`` all reaches
    are ``widen`` times as wide.  A level that ends below ``proceed`` is the last,
    and its transform is kept.
    """
    if start.fitness < enable:
        return start
    factor = widen if start.fitness < proceed else 1.0
    sloped = stored(color_gradients(target, 2 * reaches[0] * factor), "color-gradients")
    best = start
    for reach, n in zip(reaches, rounds, strict=True):
        best = colored_icp(source, sloped, reach * factor, n, best.transform)
        if best.fitness < proceed:
            break
    return best
