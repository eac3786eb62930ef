"""Point-cloud operators: boxes, cleaning, down-sampling, local statistics, text encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquilt.functions.linalg import symmetric_eigenvalues
from geoquilt.operators.numbering import numbered
from geoquilt.operators.spatial import XYZ, cells, knn, knn_self, radius_join
from geoquilt.storage import stored


def aabb(points: DataFrame) -> DataFrame:
    """One row with the closed box of the points: min_x, max_x, ..."""
    return points.agg(*[f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))])


def crop(points: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Points inside a box, its faces included; the bounds reach the scan as pushed filters."""
    keep = F.lit(True)
    for c, a, b in zip(XYZ, low, high, strict=True):
        keep = keep & F.col(c).between(a, b)
    return points.where(keep)


def voxel_downsample(points: DataFrame, size: float, means: tuple[str, ...] = XYZ) -> DataFrame:
    """One row per occupied cell: ix, iy, iz, n and the means of the given columns."""
    keyed = points.withColumns(dict(zip(("ix", "iy", "iz"), cells(size), strict=True)))
    return keyed.groupBy("ix", "iy", "iz").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in means])


def voxelize(points: DataFrame, size: float) -> DataFrame:
    """Distinct occupied cells (iz, iy, ix)."""
    ix, iy, iz = cells(size)
    return points.select(iz.alias("iz"), iy.alias("iy"), ix.alias("ix")).distinct()


def voxel_grid(points: DataFrame, size: float, padding: int = 2, max_voxels: int = 60_000_000) -> DataFrame:
    """One row: the cell size and the dimensions of the padded grid.

    If the grid has more than ``max_voxels`` cells the size grows by 1.1 times
    the cube root of the excess.
    """
    spans = [F.col(f"max_{c}") - F.col(f"min_{c}") for c in XYZ]
    dims = lambda s: [F.greatest(F.lit(1), F.ceil(d / s)) + 1 + 2 * padding for d in spans]
    size_c = F.lit(float(size))
    total = dims(size_c)[0] * dims(size_c)[1] * dims(size_c)[2]
    grown = F.when(total > max_voxels, size_c * F.pow(total / max_voxels, F.lit(1 / 3)) * 1.1).otherwise(size_c)
    return aabb(points).withColumn("voxel", grown).select("voxel", *[d.cast("long").alias(n) for d, n in zip(dims(F.col("voxel")), ("nx", "ny", "nz"), strict=True)])


def statistical_outliers(points: DataFrame, k: int = 20, ratio: float = 2.0) -> DataFrame:
    """Rows of ``points(pid, ...)`` whose mean distance to ``k`` neighbours stays below mean + ratio * deviation.

    The deviation is the sample one.  A point without neighbours is dropped.
    """
    near = knn_self(points, k).groupBy(F.col("i").alias("kept")).agg(F.avg("d").alias("mean_d"))
    level = near.agg((F.avg("mean_d") + ratio * F.stddev_samp("mean_d")).alias("most"))
    kept = near.join(F.broadcast(level), F.col("mean_d") < F.col("most"))  # one row
    return points.join(kept.select("kept"), F.col("pid") == F.col("kept"), "left_semi")


def radius_outliers(points: DataFrame, radius: float, least: int = 8) -> DataFrame:
    """Rows of ``points(pid, ...)`` with at least ``least`` other points within ``radius``."""
    near = radius_join(points.withColumnRenamed("pid", "i"), points.select(F.col("pid").alias("j"), *XYZ), radius)
    kept = near.where("i <> j").groupBy(F.col("i").alias("kept")).count().where(F.col("count") >= least)
    return points.join(kept, F.col("pid") == F.col("kept"), "left_semi")


def local_radii(points: DataFrame, k: int = 8, scale: float = 1.0) -> DataFrame:
    """(pid, radius): scaled median distance to the ``k`` nearest neighbours."""
    near = knn_self(points, k)
    return near.groupBy(F.col("i").alias("pid")).agg((scale * F.percentile("d", 0.5)).alias("radius"))


def mean_spacing(points: DataFrame, k: int = 8, first: int = 500) -> DataFrame:
    """One row: the median over the ``first`` points, by id, of their mean distance to ``k`` neighbours."""
    chosen = points.orderBy("pid").limit(first).withColumnRenamed("pid", "i")
    near = knn(chosen, points.withColumnRenamed("pid", "j"), k).groupBy("i").agg(F.avg("d").alias("mean_d"))
    return near.agg(F.percentile("mean_d", 0.5).alias("spacing"))


def spacing_quantile(points: DataFrame, k: int = 7, q: float = 0.1) -> DataFrame:
    """One row: the ``q`` quantile of all points' distances to their ``k`` nearest neighbours; 1 for fewer than three points.

    The distances are numbered in ranges, so no task holds them all.
    """
    d = stored(numbered(knn_self(points, k).select("d"), "d", "at"), "spacings")
    total = d.agg(((F.count("*") - 1) * q).alias("place"))
    around = d.join(F.broadcast(total), F.abs(F.col("at") - F.col("place")) < 1)  # one row
    share = 1 - F.abs(F.col("at") - F.col("place"))
    found = around.agg((F.sum(F.col("d") * share) / F.sum(share)).alias("spacing"))
    n = points.agg(F.count("*").alias("n"))
    return found.join(F.broadcast(n)).select(F.when(F.col("n") < 3, 1.0).otherwise(F.col("spacing")).alias("spacing"))


def select_rows(points: DataFrame, index: DataFrame, invert: bool = False) -> DataFrame:
    """Rows of ``points(pid, ...)`` whose pid is among ``index(pid)``, or is not; repeated ids of the index count once, null ids never match."""
    chosen = index.select(F.col("pid").alias("__chosen"))
    return points.join(chosen, F.col("pid") == F.col("__chosen"), "left_anti" if invert else "left_semi")


def covariance(columns: tuple[str, str, str] = XYZ, sample: bool = False) -> list[Column]:
    """Aggregates xx, yy, zz, xy, xz, yz."""
    f = F.covar_samp if sample else F.covar_pop
    a, b, c = columns
    return [f(p, q) for p, q in ((a, a), (b, b), (c, c), (a, b), (a, c), (b, c))]


def surface_variation(points: DataFrame, radius: float) -> DataFrame:
    """(pid, n, variation): least eigenvalue over the trace in the ball; 0 with fewer than three points."""
    near = radius_join(points.withColumnRenamed("pid", "i"), points.select(F.col("pid").alias("j"), *XYZ), radius)
    names = ("xx", "yy", "zz", "xy", "xz", "yz")
    moments = near.groupBy(F.col("i").alias("pid")).agg(F.count("*").alias("n"), *[c.alias(n) for c, n in zip(covariance(), names, strict=True)])
    least = F.greatest(symmetric_eigenvalues(*map(F.col, names))[2], F.lit(1e-12))
    trace = F.greatest(F.col("xx") + F.col("yy") + F.col("zz"), F.lit(1e-12))
    return moments.select("pid", "n", F.when(F.col("n") < 3, 0.0).otherwise(least / trace).alias("variation"))


def pca_spectrum(points: DataFrame) -> DataFrame:
    """One row: count, centroid and descending eigenvalues of the sample covariance."""
    names = ("xx", "yy", "zz", "xy", "xz", "yz")
    m = points.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"c{c}") for c in XYZ], *[c.alias(n) for c, n in zip(covariance(sample=True), names, strict=True)])
    values = symmetric_eigenvalues(*map(F.col, names))
    return m.select("n", "cx", "cy", "cz", *[v.alias(f"l{i + 1}") for i, v in enumerate(values)])


def cloud_stats(points: DataFrame, by: str) -> DataFrame:
    """Per cloud: count, centroid, bounds and the box's diagonal."""
    bounds = [f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))]
    s = points.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"c{c}") for c in XYZ], *bounds)
    span = [F.col(f"max_{c}") - F.col(f"min_{c}") for c in XYZ]
    return s.withColumn("diagonal", F.sqrt(span[0] * span[0] + span[1] * span[1] + span[2] * span[2]))


def quantize(c: Column, step: float) -> Column:
    """Nearest multiple of ``step``, halves to even."""
    return F.bround(c / step) * step


def encode_text(points: DataFrame, position_step: float = 0.0005, normal_step: float = 0.01) -> DataFrame:
    """``points(pid, x, y, z, nx, ny, nz, r, g, b)`` as lines of nine space-separated fields (pid, value).

    Positions have six decimals, normals three, colors are 0-255; a missing color is 200.
    """
    p = [quantize(F.col(c), position_step) + F.lit(0.0) for c in XYZ]
    n = [quantize(F.col(c), normal_step) + F.lit(0.0) for c in ("nx", "ny", "nz")]
    rgb = [F.when(F.col(c).isNull(), 200).otherwise(F.bround(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * 255)).cast("int") for c in "rgb"]
    return points.select("pid", F.format_string("%.6f %.6f %.6f %.3f %.3f %.3f %d %d %d", *p, *n, *rgb).alias("value"))


def decode_text(lines: DataFrame) -> DataFrame:
    """Columns x..b of text lines (pid, value); a line without exactly nine fields is an error."""
    f = F.split(F.trim("value"), r"\s+")
    good = F.when(F.size(f) == 9, f).otherwise(F.raise_error(F.concat(F.lit("not nine fields: "), "value")))
    names = (*XYZ, "nx", "ny", "nz")
    rgb = [F.least(F.greatest(F.col("f")[6 + i].cast("double") / 255, F.lit(0.0)), F.lit(1.0)).alias(c) for i, c in enumerate("rgb")]
    return lines.select("pid", good.alias("f")).select("pid", *[F.col("f")[i].cast("double").alias(c) for i, c in enumerate(names)], *rgb)


def deterministic_sample(points: DataFrame, n: int) -> DataFrame:
    """``n`` rows in the order of an arithmetic hash of pid, the same in every run."""
    key = F.pmod(F.col("pid") * 2_654_435_761, F.lit(1_000_003))
    return points.orderBy(key, "pid").limit(n)


def gray_by_height(points: DataFrame) -> DataFrame:
    """``points`` with r, g, b: given colors stay, missing ones are the height's place between least and largest z."""
    span = points.agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
    height = F.when(F.col("z1") > F.col("z0"), (F.col("z") - F.col("z0")) / (F.col("z1") - F.col("z0"))).otherwise(0.5)
    own = [F.coalesce(F.col(c), height) if c in points.columns else height for c in "rgb"]
    return points.join(F.broadcast(span)).select(*[c for c in points.columns if c not in "rgb"], *[v.alias(c) for v, c in zip(own, "rgb", strict=True)])  # one row


def tinted(points: DataFrame, color: tuple[float, float, float], amount: float) -> DataFrame:
    """``points`` with r, g, b mixed with a color: (1 - amount) * own + amount * color."""
    return points.withColumns({c: (1 - amount) * F.col(c) + amount * v for c, v in zip("rgb", color, strict=True)})


def hue(index: Column, n: int, saturation: float = 0.65, value: float = 1.0) -> list[Column]:
    """r, g, b of ``n`` evenly spaced hues."""
    h = F.pmod(index, F.lit(n)) * (6.0 / n)
    channel = lambda k: value - value * saturation * F.greatest(F.least(F.pmod(h + k, F.lit(6.0)), 4 - F.pmod(h + k, F.lit(6.0)), F.lit(1.0)), F.lit(0.0))
    return [channel(5.0), channel(3.0), channel(1.0)]


def kernel_radius(points: DataFrame, scale: float = 0.55, most: int = 16) -> DataFrame:
    """One row: pixel radius of a disk, from the median third-neighbour distance, and the odd closing and opening sizes.

    Fewer than eight points give radius 1.
    """
    third = knn_self(points, 3).where("rank = 3").agg(F.percentile("d", 0.5).alias("d"), (F.count("*")).alias("n"))
    radius = F.when(F.col("n") < 8, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.col("d") * scale)))).cast("int")
    sized = third.select(radius.alias("radius"))
    return sized.select("radius", F.greatest(F.lit(3), 2 * F.col("radius") + 1).alias("closing"), F.greatest(F.lit(3), (2 * F.bround(1.5 * F.col("radius")) + 1)).cast("int").alias("opening"))


def typical_spacing(points: DataFrame, scale: float = 1.0, default: float = 0.01) -> DataFrame:
    """One row: the scaled median distance to the nearest neighbour, ``default`` without one."""
    return knn_self(points, 1).agg(F.coalesce(scale * F.percentile("d", 0.5), F.lit(default)).alias("sigma"))
