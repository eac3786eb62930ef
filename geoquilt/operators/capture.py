"""Merging a capture: frames moved to the base frame, aligned in pairs, chained and fused.

Every frame is aligned to the one before it, all pairs at once: a round of ICP joins
the points of all pairs, sums the normal equations by pair and solves one small system
a row, so the rounds do not grow with the number of frames.  The corrections are then
chained by a prefix scan over rigid transforms, whose product does not commute: blocks of
frames are multiplied up in order, then the blocks, and each block takes the product of
those before it.

A transform is an array of the twelve numbers of a 3 x 4 matrix, row by row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquilt.functions.linalg import apply_rotation, cross, dot, euler_rotation, norm
from geoquilt.operators.cameras import back_project, bilateral, to_metres
from geoquilt.operators.clouds import crop, statistical_outliers, voxel_downsample
from geoquilt.operators.numbering import indexed
from geoquilt.operators.spatial import XYZ
from geoquilt.storage import discard, stored

IDENTITY = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)
NORMAL = ("nx", "ny", "nz")
BLOCK = 64
#: Calibration of the surveyed rig, camera to tool, rotation then metres (fixed values).
HAND_EYE = (
    0.999048, 0.00428, -0.00625, -0.036,
    -0.00706, 0.99658, -0.00804, -0.078,
    0.00423, 0.00895, 0.99629, 0.006,
)
#: The two ways in which a calibration may be meant.
DIRECTIONS = ("tcp_cam", "cam_tcp_inv")


def constant(transform: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in transform])


def compose(a: Column, b: Column) -> Column:
    """The transform that applies ``b`` first, then ``a``."""
    at = lambda t, r, c: F.get(t, F.lit(4 * r + c))
    out = []
    for r in range(3):
        for c in range(4):
            v = at(a, r, 0) * at(b, 0, c) + at(a, r, 1) * at(b, 1, c) + at(a, r, 2) * at(b, 2, c)
            out.append(v + at(a, r, 3) if c == 3 else v)
    return F.array(*out)


def inverse(t: Column) -> Column:
    """Inverse of a rigid transform."""
    at = lambda r, c: F.get(t, F.lit(4 * r + c))
    rows = [[at(0, r), at(1, r), at(2, r), -(at(0, r) * at(0, 3) + at(1, r) * at(1, 3) + at(2, r) * at(2, 3))] for r in range(3)]
    return F.array(*[v for row in rows for v in row])


def moved(t: Column, names: Sequence[str] = XYZ, turn_only: bool = False) -> list[Column]:
    """The columns ``names`` under the transform ``t``; a direction is only turned."""
    p = [F.col(c) for c in names]
    turned = [F.get(t, F.lit(4 * r)) * p[0] + F.get(t, F.lit(4 * r + 1)) * p[1] + F.get(t, F.lit(4 * r + 2)) * p[2] for r in range(3)]
    return [(v if turn_only else v + F.get(t, F.lit(4 * r + 3))).alias(n) for r, (v, n) in enumerate(zip(turned, names, strict=True))]


def hand_eye(transform: Sequence[float] = HAND_EYE, direction: str = "tcp_cam") -> tuple[float, ...]:
    """Tool from camera: the calibration itself, or its inverse if it is meant the other way."""
    if direction not in DIRECTIONS:
        raise ValueError(f"the direction must be one of {DIRECTIONS}")
    if direction == "tcp_cam":
        return tuple(map(float, transform))
    whole = np.linalg.inv(np.vstack([np.reshape(transform, (3, 4)), [0, 0, 0, 1]]))
    return tuple(map(float, whole[:3].ravel()))


def pose_transforms(poses: DataFrame, order: str = "XYZ", scale: float = 0.001, calibration: Sequence[float] = IDENTITY) -> DataFrame:
    """(frame, t): base from camera of every pose (frame, x, y, z, rx, ry, rz): its rotation and scaled position, behind the calibration."""
    rot = euler_rotation(F.col("rx"), F.col("ry"), F.col("rz"), order)
    own = F.array(*[v for r, c in enumerate(XYZ) for v in (*rot[r], F.col(c) * scale)])
    both = poses.select("frame", own.alias("own"), constant(calibration).alias("calibration"))
    return both.select("frame", compose(F.col("own"), F.col("calibration")).alias("t"))


def prefix_products(chain: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, t): of ``chain(i, t)`` with i = 0, 1, 2, ... the product t0 t1 ... ti of each row.

    A block of ``block`` consecutive rows is multiplied up in one row; the
    blocks' products are chained in the same way, so the levels grow with the
    logarithm of the rows, and no task holds more than a block.
    """
    kind = "array<struct<i:bigint,t:array<double>>>"
    step = lambda acc, x: F.concat(acc, F.array(F.struct(x["i"].alias("i"), F.when(F.size(acc) == 0, x["t"]).otherwise(compose(F.element_at(acc, -1)["t"], x["t"])).alias("t"))))
    rows = chain.select(F.floor(F.col("i") / block).alias("b"), F.struct(F.col("i").cast("long").alias("i"), F.col("t").cast("array<double>").alias("t")).alias("x"))
    ordered = rows.groupBy("b").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    runs = stored(ordered.select("b", F.aggregate("xs", F.array().cast(kind), step).alias("run")), "chain-blocks")
    if runs.limit(2).count() < 2:
        return runs.select(F.inline("run"))
    blocks = prefix_products(runs.select(F.col("b").alias("i"), F.element_at("run", -1)["t"].alias("t")), block)
    before = blocks.select((F.col("i") + 1).alias("next"), F.col("t").alias("before"))
    joined = runs.join(before, F.col("b") == F.col("next"), "left").select("before", F.inline("run"))
    return joined.select("i", F.when(F.col("before").isNull(), F.col("t")).otherwise(compose(F.col("before"), F.col("t"))).alias("t"))


def chained(frames: DataFrame, steps: DataFrame) -> DataFrame:
    """(frame, t): of ``frames(frame)`` in order, the product of the ``steps(frame, t)`` up to each; a frame without a step adds none."""
    order = indexed(frames.select("frame").distinct(), "frame", name="i")
    each = order.join(steps.select(F.col("frame").alias("s_frame"), F.col("t")), F.col("frame") == F.col("s_frame"), "left")
    products = prefix_products(each.select("i", F.coalesce("t", constant(IDENTITY)).alias("t")))
    return order.withColumnRenamed("i", "at").join(products, F.col("at") == F.col("i")).select("frame", "t")


def autotune(points: DataFrame, poses: DataFrame, low: Sequence[float], high: Sequence[float], calibration: Sequence[float] = HAND_EYE, scales: Sequence[float] = (1.0, 0.001), orders: Sequence[str] = ("XYZ", "ZYX"), directions: Sequence[str] = DIRECTIONS) -> DataFrame:
    """(k, scale, axis_order, direction, inliers) of all hypotheses: points of ``points(frame, x, y, z)`` that land in the box.

    The best has most, the least k of equals.  One scan counts all of them.
    """
    p = poses.select(F.col("frame").alias("pose"), *[F.col(c).alias(f"t{c}") for c in XYZ], "rx", "ry", "rz")
    tool = {d: [[float(v) for v in hand_eye(calibration, d)[4 * r : 4 * r + 4]] for r in range(3)] for d in directions}
    in_tool = [(a * F.col("x") + b * F.col("y") + c * F.col("z") + t).alias(f"{d}_{n}") for d in directions for n, (a, b, c, t) in zip(XYZ, tool[d], strict=True)]
    joined = points.select("frame", *in_tool).join(p, F.col("frame") == F.col("pose"))
    turned = {(d, o): apply_rotation(euler_rotation(F.col("rx"), F.col("ry"), F.col("rz"), o), [F.col(f"{d}_{c}") for c in XYZ]) for d in directions for o in orders}
    joined = joined.select(*[F.col(f"t{c}") for c in XYZ], *[v.alias(f"{d}_{o}_{c}") for (d, o), vs in turned.items() for c, v in zip(XYZ, vs, strict=True)])
    rows, sums = [], []
    for k, (scale, order, direction) in enumerate(itertools.product(scales, orders, directions)):
        inside = F.lit(True)
        for c, a, b in zip(XYZ, low, high, strict=True):
            inside = inside & (F.col(f"{direction}_{order}_{c}") + F.col(f"t{c}") * scale).between(a, b)
        sums.append(F.sum(inside.cast("long")).alias(f"n{k}"))
        rows.append(F.struct(F.lit(k).alias("k"), F.lit(float(scale)).alias("scale"), F.lit(order).alias("axis_order"), F.lit(direction).alias("direction"), F.coalesce(F.col(f"n{k}"), F.lit(0)).alias("inliers")))
    return joined.agg(*sums).select(F.inline(F.array(*rows)))


def pixel_normals(cloud: DataFrame) -> DataFrame:
    """``cloud(frame, row, col, x, y, z)`` in camera coordinates with unit normals towards the camera, from the pixels to the right and below.

    A pixel that lacks one of them, or whose neighbours lie in a line with it, has no normal and is dropped.
    """
    at = lambda p, dr, dc: cloud.select(F.col("frame").alias(f"{p}f"), (F.col("row") - dr).alias(f"{p}r"), (F.col("col") - dc).alias(f"{p}c"), *[F.col(c).alias(f"{p}{c}") for c in XYZ])
    on = lambda p: (F.col("frame") == F.col(f"{p}f")) & (F.col("row") == F.col(f"{p}r")) & (F.col("col") == F.col(f"{p}c"))
    joined = cloud.join(at("a", 0, 1), on("a")).join(at("b", 1, 0), on("b"))
    n = cross(*[[F.col(f"{p}{c}") - F.col(c) for c in XYZ] for p in "ab"])
    joined = joined.withColumns(dict(zip(NORMAL, n, strict=True))).withColumn("size", norm([F.col(c) for c in NORMAL])).where("size > 1e-15")
    turn = F.when(dot([F.col(c) for c in NORMAL], [F.col(c) for c in XYZ]) > 0, -1.0).otherwise(1.0) / F.col("size")
    return joined.withColumn("turn", turn).select(*cloud.columns, *[(F.col(c) * F.col("turn")).alias(c) for c in NORMAL])


def _advance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """New transform of each pair from its 27 sums: the twist that solves them, before the old one."""
    for sums, old in batches:
        out, steps = [], []
        for s, t in zip(sums, old, strict=True):
            m = np.zeros((6, 6))
            m[np.triu_indices(6)] = s[:21]
            m = m + np.triu(m, 1).T
            v = np.linalg.lstsq(m + 1e-9 * np.eye(6), -np.asarray(s[21:]), rcond=None)[0]
            w, angle = v[:3], float(np.linalg.norm(v[:3]))
            k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
            r = np.eye(3) + k if angle < 1e-12 else np.eye(3) + np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * k @ k
            old_t = np.reshape(t, (3, 4))
            new = r @ old_t
            new[:, 3] += v[3:]
            out.append(new.ravel())
            steps.append(float(np.abs(v).max()))
        yield pd.DataFrame({"t": out, "step": steps})


@dataclass(frozen=True)
class Refinement:
    """Bounds of the pairwise alignment, in metres: coarse to fine reaches, rounds of each, and the gates."""

    reaches: tuple[float, ...] = (0.032, 0.016, 0.008)
    rounds: int = 20
    kernel: float = 0.03
    tolerance: float = 1e-7
    least_source: int = 1000
    least_target: int = 2000
    least_fitness: float = 0.2


def _matches(source: DataFrame, target: DataFrame, state: DataFrame, reach: float) -> DataFrame:
    """Nearest target point within ``reach`` of every moved source point: pair, x, y, z, d, q with the target's numbers."""
    cell = lambda p: [F.floor(F.col(c) / reach) for c in p]
    own = source.join(state.select("pair", "t"), "pair").select("pair", "pid", *moved(F.col("t")))
    own = own.withColumns(dict(zip(("cx", "cy", "cz"), cell(XYZ), strict=True)))
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    spread = target.select(F.col("pair").alias("q_pair"), F.struct(*XYZ, *NORMAL).alias("q"), *[c.alias(f"f{n}") for c, n in zip(cell(XYZ), XYZ, strict=True)])
    for n in XYZ:
        spread = spread.withColumn("k", F.explode(near)).withColumn(f"f{n}", F.col(f"f{n}") + F.col("k")).drop("k")
    same = (F.col("pair") == F.col("q_pair")) & (F.col("cx") == F.col("fx")) & (F.col("cy") == F.col("fy")) & (F.col("cz") == F.col("fz"))
    d = norm([F.col(c) - F.col(f"q.{c}") for c in XYZ])
    met = own.join(spread, same).withColumn("d", d).where(F.col("d") <= reach)
    return met.groupBy("pair", "pid").agg(F.min(F.struct("d", "q")).alias("b"), *[F.first(c).alias(c) for c in XYZ]).select("pair", *XYZ, "b.d", "b.q")


def align_pairs(source: DataFrame, target: DataFrame, how: Refinement = Refinement()) -> DataFrame:
    """(pair, t, fitness, rmse): transforms of ``source(pair, pid, x, y, z)`` onto ``target(pair, x, y, z, nx, ny, nz)``, all pairs at once.

    Point-to-plane ICP with Tukey's weights from the coarse reach to the fine one.
    Pairs with too few points on a side, or matches for less than ``least_fitness`` of the
    source points, stay where they are.  The rounds end when no pair moves any more.
    """
    source, target = stored(source.select("pair", "pid", *XYZ), "pair-sources"), stored(target.select("pair", *XYZ, *NORMAL), "pair-targets")
    sizes = source.groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") >= how.least_source)
    sizes = sizes.join(target.groupBy("pair").agg(F.count("*").alias("m")).where(F.col("m") >= how.least_target).select("pair"), "pair")
    state = stored(sizes.select("pair", "n", constant(IDENTITY).alias("t")), "pair-state")
    p, q, normal = [F.col(c) for c in XYZ], [F.col(f"q.{c}") for c in XYZ], [F.col(f"q.{c}") for c in NORMAL]
    offset = dot([a - b for a, b in zip(p, q, strict=True)], normal)
    jacobian = [*cross(p, normal), *normal]
    advance = F.pandas_udf(_advance, "struct<t:array<double>,step:double>")
    for reach in how.reaches:
        kernel = max(how.kernel, reach)
        ratio = offset / kernel
        weight = F.when(F.abs(offset) < kernel, (1 - ratio * ratio) * (1 - ratio * ratio)).otherwise(0.0)
        sums = [F.sum(weight * jacobian[a] * jacobian[b]) for a in range(6) for b in range(a, 6)] + [F.sum(weight * jacobian[a] * offset) for a in range(6)]
        for _ in range(how.rounds):
            added = _matches(source, target, state, reach).groupBy(F.col("pair").alias("s_pair")).agg(F.array(*sums).alias("sums"))
            next_ = state.join(added, F.col("pair") == F.col("s_pair"), "left")
            zeros = F.array_repeat(F.lit(0.0), 27)
            before, state = state, stored(next_.select("pair", "n", advance(F.coalesce("sums", zeros), F.col("t")).alias("a")).select("pair", "n", "a.t", "a.step"), "pair-state")
            discard(before)
            if (state.agg(F.max("step")).first()[0] or 0.0) < how.tolerance:
                break
    done = _matches(source, target, state, how.reaches[-1]).groupBy(F.col("pair").alias("d_pair")).agg(F.count("*").alias("met"), F.avg(F.col("d") * F.col("d")).alias("s"))
    judged = state.join(done, F.col("pair") == F.col("d_pair"), "left").select("pair", "t", (F.coalesce("met", F.lit(0)) / F.col("n")).alias("fitness"), F.sqrt(F.coalesce("s", F.lit(0.0))).alias("rmse"))
    return judged.withColumn("t", F.when(F.col("fitness") < how.least_fitness, constant(IDENTITY)).otherwise(F.col("t")))


def frame_clouds(pixels: DataFrame, intrinsics: Sequence[float], truncate: float = 2.5, smooth: bool = True) -> DataFrame:
    """(frame, row, col, x, y, z, and r, g, b if there are any) in camera coordinates of ``pixels(frame, row, col, raw)``.

    Depth in each frame's own unit, smoothed by the bilateral filter; ``intrinsics`` are fx, fy, cx, cy.
    """
    depth = to_metres(pixels.select("frame", "row", "col", "raw"))
    cloud = back_project(bilateral(depth) if smooth else depth, *intrinsics, truncate)
    colors = [c for c in "rgb" if c in pixels.columns]
    if not colors:
        return cloud
    own = pixels.select(F.col("frame").alias("p_f"), F.col("row").alias("p_r"), F.col("col").alias("p_c"), *colors)
    return cloud.join(own, (F.col("frame") == F.col("p_f")) & (F.col("row") == F.col("p_r")) & (F.col("col") == F.col("p_c"))).drop("p_f", "p_r", "p_c")


def to_base(cloud: DataFrame, transforms: DataFrame) -> DataFrame:
    """``cloud(frame, x, y, z)``, with normals if there are any, under the transform of its frame; frames without one go."""
    joined = cloud.join(transforms.select(F.col("frame").alias("t_frame"), "t"), F.col("frame") == F.col("t_frame"))
    columns = moved(F.col("t")) + (moved(F.col("t"), NORMAL, turn_only=True) if set(NORMAL) <= set(cloud.columns) else [])
    new = {*XYZ, *NORMAL} if len(columns) > 3 else set(XYZ)
    return joined.select(*[c for c in cloud.columns if c not in new], *columns)


def merge_capture(
    pixels: DataFrame, poses: DataFrame, intrinsics: Sequence[float], low: Sequence[float], high: Sequence[float], calibration: Sequence[float] = HAND_EYE,
    frame_voxel: float = 0.003, merge_voxel: float = 0.003, least_points: int = 200, how: Refinement | None = Refinement(), outliers: tuple[int, float] | None = (20, 2.0), least_cleaned: int = 2000,
) -> DataFrame:
    """The fused cloud (pid, n, x, y, z, and r, g, b) of a capture, one row per cell of ``merge_voxel``.

    ``pixels(frame, row, col, raw[, r, g, b])`` and ``poses`` share frames, whose order is that of
    the capture.  The unit, axis order and calibration's direction that put most points of the first frame into the box
    serve all frames.  Each frame is moved to the base, cropped, thinned to cells of ``frame_voxel`` and, if ``how`` is
    given, aligned to the frame before it; the corrections are chained.  Frames with fewer than
    ``least_points`` points in the box are left out, and so do not break the chain of the others.  Outliers of the fused
    cloud go if it has more than ``least_cleaned`` points.  Without frames the result is empty.
    """
    cloud = stored(pixel_normals(frame_clouds(pixels, intrinsics)), "frame-clouds")
    first = poses.agg(F.min("frame").alias("first"))
    tried = autotune(cloud.join(F.broadcast(first), F.col("frame") == F.col("first")), poses, low, high, calibration).orderBy(F.desc("inliers"), "k").first()
    transforms = pose_transforms(poses, tried["axis_order"], tried["scale"], hand_eye(calibration, tried["direction"]))
    boxed = crop(to_base(cloud, transforms), tuple(low), tuple(high))
    colors = [c for c in "rgb" if c in pixels.columns]
    cell = [F.floor(F.col(c) / frame_voxel).alias(f"i{c}") for c in XYZ]
    thin = boxed.groupBy("frame", *cell).agg(*[F.avg(c).alias(c) for c in (*XYZ, *NORMAL, *colors)], F.count("*").alias("n"))
    full = boxed.groupBy(F.col("frame").alias("f_frame")).agg(F.count("*").alias("points")).where(F.col("points") >= least_points)
    size = F.greatest(norm([F.col(c) for c in NORMAL]), F.lit(1e-12))
    thin = thin.join(full, F.col("frame") == F.col("f_frame"), "left_semi").withColumn("size", size)
    thin = stored(thin.select("frame", *XYZ, *[(F.col(c) / F.col("size")).alias(c) for c in NORMAL], *colors, F.xxhash64("ix", "iy", "iz").alias("pid")), "thin-frames")
    if how is not None:
        frames = indexed(thin.select("frame").distinct(), "frame", name="i")
        numbered = thin.join(frames.withColumnRenamed("frame", "i_frame"), F.col("frame") == F.col("i_frame")).drop("i_frame")
        source, target = numbered.withColumnRenamed("i", "pair").where("pair > 0"), numbered.withColumn("pair", F.col("i") + 1)
        found = align_pairs(source, target, how)
        steps = frames.join(found, F.col("i") == F.col("pair")).select("frame", "t")
        thin = to_base(thin, chained(frames, steps))
    fused = voxel_downsample(thin, merge_voxel, (*XYZ, *colors))
    fused = indexed(fused, "ix", "iy", "iz", name="pid").select("pid", "n", *XYZ, *colors)
    if outliers is None or fused.limit(least_cleaned + 1).count() <= least_cleaned:
        return fused
    return statistical_outliers(fused, *outliers)
