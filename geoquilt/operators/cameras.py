"""Depth frames, poses and volume fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquilt.functions.linalg import apply_rotation, euler_rotation
from geoquilt.operators.raster import shifted, square
from geoquilt.operators.spatial import XYZ


def depth_units(depth: DataFrame) -> DataFrame:
    """(frame, p95, unit): metres if the 95th percentile of a frame is below 10, else millimetres; zeros count."""
    q = depth.groupBy("frame").agg(F.percentile("raw", 0.95).alias("p95"))
    return q.withColumn("unit", F.when(F.col("p95") < 10, "m").otherwise("mm"))


def to_metres(depth: DataFrame) -> DataFrame:
    """(frame, row, col, d): depth in metres by each frame's guessed unit; non-finite and null values are 0."""
    units = depth_units(depth).select(F.col("frame").alias("f"), "unit")
    raw = F.when(F.col("raw").isNull() | F.isnan("raw") | (F.abs("raw") == float("inf")), 0.0).otherwise(F.col("raw"))
    joined = depth.join(units, F.col("frame") == F.col("f"))
    return joined.select("frame", "row", "col", (raw / F.when(F.col("unit") == "m", 1.0).otherwise(1000.0)).alias("d"))


def bilateral(depth: DataFrame, r: int = 2, sigma_depth: float = 0.03, sigma_pixels: float = 3.0) -> DataFrame:
    """(frame, row, col, d) filtered over a (2r+1)-square: weights fall with pixel and depth distance.

    Pixels outside the frame are left out; results below 1e-6 are 0.
    """
    seen = shifted(depth.select("row", "col", "frame", F.col("d").alias("e")), square(r))
    own = depth.select(F.col("frame").alias("f"), F.col("row").alias("r0"), F.col("col").alias("c0"), "d")
    joined = seen.join(own, (F.col("frame") == F.col("f")) & (F.col("row") == F.col("r0")) & (F.col("col") == F.col("c0")))
    gap = F.col("e") - F.col("d")
    far = (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")) / (2 * sigma_pixels * sigma_pixels)
    w = F.exp(-far - gap * gap / (2 * sigma_depth * sigma_depth))
    out = joined.groupBy("frame", "row", "col").agg((F.sum(w * F.col("e")) / F.sum(w)).alias("d"))
    return out.withColumn("d", F.when(F.col("d") < 1e-6, 0.0).otherwise(F.col("d")))


def back_project(depth: DataFrame, fx: float, fy: float, cx: float, cy: float, truncate: float = 2.5) -> DataFrame:
    """(frame, row, col, x, y, z) of pixels with 0 < d <= ``truncate``."""
    z = F.col("d")
    return depth.where((z > 0) & (z <= truncate)).select(
        "frame", "row", "col", ((F.col("col") - cx) * z / fx).alias("x"), ((F.col("row") - cy) * z / fy).alias("y"), z.alias("z")
    )


def to_base(points: DataFrame, poses: DataFrame, order: str = "XYZ", scale: float = 0.001) -> DataFrame:
    """Points of each frame in the base frame: rotated by the pose's angles and moved by its scaled position.

    Poses are one small row per frame; Spark broadcasts them below its own threshold.
    """
    p = poses.select(F.col("frame").alias("pose"), *[F.col(c).alias(f"t{c}") for c in XYZ], "rx", "ry", "rz")
    joined = points.join(p, F.col("frame") == F.col("pose"))
    rot = euler_rotation(F.col("rx"), F.col("ry"), F.col("rz"), order)
    moved = [v + F.col(f"t{c}") * scale for v, c in zip(apply_rotation(rot, [F.col(c) for c in XYZ]), XYZ, strict=True)]
    return joined.select("frame", *[c for c in points.columns if c not in ("frame", *XYZ)], *[m.alias(c) for m, c in zip(moved, XYZ, strict=True)])


def autotune(points: DataFrame, poses: DataFrame, low: Sequence[float], high: Sequence[float], orders: Sequence[str] = ("XYZ", "ZYX"), scales: Sequence[float] = (0.001, 1.0)) -> DataFrame:
    """(k, axis_order, scale, inliers) of every hypothesis: points that land in the box; the best has most, the first of equals.

    All hypotheses are evaluated in one scan, as conditional sums.
    """
    p = poses.select(F.col("frame").alias("pose"), *[F.col(c).alias(f"t{c}") for c in XYZ], "rx", "ry", "rz")
    joined = points.join(p, F.col("frame") == F.col("pose"))
    rows, sums = [], []
    for o in orders:
        turned = apply_rotation(euler_rotation(F.col("rx"), F.col("ry"), F.col("rz"), o), [F.col(c) for c in XYZ])
        for s in scales:
            inside = F.lit(True)
            for v, c, a, b in zip(turned, XYZ, low, high, strict=True):
                inside = inside & (v + F.col(f"t{c}") * s).between(a, b)
            k = len(rows)
            sums.append(F.sum(inside.cast("long")).alias(f"n{k}"))
            rows.append(F.struct(F.lit(k).alias("k"), F.lit(o).alias("axis_order"), F.lit(float(s)).alias("scale"), F.coalesce(F.col(f"n{k}"), F.lit(0)).alias("inliers")))
    return joined.agg(*sums).select(F.inline(F.array(*rows)))


def fuse_volume(depth: DataFrame, fx: float, fy: float, cx: float, cy: float, voxel: float, band: float, truncate: float = 2.5) -> DataFrame:
    """(ix, iy, iz, sdf, weight): truncated signed distances of the cells around each pixel's depth, averaged.

    Contract: along the ray of a pixel the cells whose centre depth is within
    ``band`` of the measured depth get the difference over ``band``, weight 1.
    Partial sums combine before the shuffle.
    """
    n = round(band / voxel)
    z = F.explode(F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda i: (F.floor(F.col("d") / voxel) + i + 0.5) * voxel))
    seen = depth.where((F.col("d") > 0) & (F.col("d") <= truncate)).select("row", "col", "d", z.alias("z")).where((F.abs(F.col("d") - F.col("z")) <= band) & (F.col("z") > 0))
    x, y = (F.col("col") - cx) * F.col("z") / fx, (F.col("row") - cy) * F.col("z") / fy
    cell = [F.floor(v / voxel).alias(c) for v, c in ((x, "ix"), (y, "iy"), (F.col("z"), "iz"))]
    return seen.groupBy(*cell).agg(F.avg((F.col("d") - F.col("z")) / band).alias("sdf"), F.count("*").alias("weight"))


def surface_crossings(volume: DataFrame, voxel: float) -> DataFrame:
    """(x, y, z): zero crossings between neighbouring cells along each axis, by linear interpolation."""
    names = ("ix", "iy", "iz")
    out = None
    for axis in names:
        other = volume.select(*[(F.col(c) - (1 if c == axis else 0)).alias(f"n{c}") for c in names], F.col("sdf").alias("far"))
        pair = volume.join(other, [F.col(c) == F.col(f"n{c}") for c in names]).where(((F.col("sdf") > 0) & (F.col("far") <= 0)) | ((F.col("sdf") <= 0) & (F.col("far") > 0)))
        t = F.col("sdf") / (F.col("sdf") - F.col("far"))
        found = pair.select(*[((F.col(c) + 0.5 + (t if c == axis else F.lit(0.0))) * voxel).alias(p) for c, p in zip(names, XYZ, strict=True)])
        out = found if out is None else out.unionByName(found)
    return out
