"""Normals, smoothing, contraction and line fits from neighbourhood covariances.

Neighbourhoods are joins and covariances are grouped sums; only the 3 x 3
eigenproblem of each finished row goes through an Arrow UDF, in batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquilt.functions.eigen import principal_axes
from geoquilt.functions.linalg import dot, norm
from geoquilt.operators.clouds import covariance
from geoquilt.operators.spatial import XYZ, knn_self, radius_join
from geoquilt.storage import stored

MOMENTS = ("xx", "yy", "zz", "xy", "xz", "yz")


def _neighbour_points(points: DataFrame, k: int) -> DataFrame:
    """(i, d, x, y, z) of each point's k nearest neighbours."""
    near = knn_self(points, k).select("i", "j", "d")
    return near.join(points.select(F.col("pid").alias("pj"), *XYZ), F.col("j") == F.col("pj")).select("i", "d", *XYZ)


def _moments(near: DataFrame, sample: bool = False) -> DataFrame:
    return near.groupBy("i").agg(
        F.count("*").alias("n"), F.avg("d").alias("mean_d"), *[F.avg(c).alias(f"m{c}") for c in XYZ],
        *[c.alias(n) for c, n in zip(covariance(sample=sample), MOMENTS, strict=True)],
    )


def _axis(which: int) -> list[Column]:
    """Components of the eigenvector of the largest (0) to the least (2) eigenvalue."""
    return [F.col("axes")[3 * which + c] for c in range(3)]


def estimate_normals(points: DataFrame, k: int = 12) -> DataFrame:
    """``points`` with unit normals nx, ny, nz: the least axis of the k neighbours, turned away from the centroid.

    A point with fewer than three neighbours gets (0, 0, 1).
    """
    m = _moments(_neighbour_points(points, k)).withColumn("axes", principal_axes(*map(F.col, MOMENTS)))
    center = F.broadcast(points.agg(*[F.avg(c).alias(f"c{c}") for c in XYZ]))  # one row
    base = points.drop("nx", "ny", "nz").join(m, F.col("pid") == F.col("i"), "left").join(center)
    n = _axis(2)
    out = dot(n, [F.col(c) - F.col(f"c{c}") for c in XYZ])
    sign = F.when(out < 0, -1.0).otherwise(1.0)
    names = zip(n, ("nx", "ny", "nz"), (0.0, 0.0, 1.0), strict=True)
    return base.select(*[c for c in points.columns if c not in ("nx", "ny", "nz")], *[F.when(F.coalesce("n", F.lit(0)) >= 3, sign * v).otherwise(d).alias(a) for v, a, d in names])


def contract_step(points: DataFrame, k: int = 12, pull: float = 0.5, step: float = 0.5) -> DataFrame:
    """``points(pid, x, y, z)`` moved towards the mean of their neighbours, less along the least axis.

    The target is (1 - pull) * mean + pull * the point's projection on the line
    through the mean along the least axis; a point goes ``step`` of the way.
    """
    m = _moments(_neighbour_points(points, k)).withColumn("axes", principal_axes(*map(F.col, MOMENTS)))
    joined = points.select("pid", *XYZ).join(m, F.col("pid") == F.col("i"), "left")
    u = _axis(2)
    along = dot([F.col(c) - F.col(f"m{c}") for c in XYZ], u)
    moved = []
    for c, v in zip(XYZ, u, strict=True):
        mean = F.col(f"m{c}")
        target = (1 - pull) * mean + pull * (mean + along * v)
        moved.append(F.coalesce(F.col(c) + step * (target - F.col(c)), F.col(c)).alias(c))
    return joined.select("pid", *moved)


def contract(points: DataFrame, rounds: int, k: int = 12, pull: float = 0.5, step: float = 0.5) -> DataFrame:
    """(step, pid, x, y, z): the history of ``rounds`` contraction steps, each stored."""
    current = stored(points.select("pid", *XYZ), "contract")
    history = current.withColumn("step", F.lit(0))
    for r in range(1, rounds + 1):
        current = stored(contract_step(current, k, pull, step), "contract")
        history = history.unionByName(current.withColumn("step", F.lit(r)))
    return history.select("step", "pid", *XYZ)


def laplacian_blend(points: DataFrame, k: int = 14, strength: float = 0.5) -> DataFrame:
    """``points`` blended with the Gaussian-weighted mean of their neighbours; sigma is 0.6 of the median spacing."""
    near = _neighbour_points(points, k).select("i", "d", *[F.col(c).alias(f"n{c}") for c in XYZ])
    sigma = F.greatest(0.6 * F.percentile("d", 0.5).over(Window.partitionBy("i")), F.lit(1e-12))
    w = F.greatest(F.exp(-(F.col("d") * F.col("d")) / (2 * F.col("sigma") * F.col("sigma"))), F.lit(1e-12))
    mean = near.withColumn("sigma", sigma).withColumn("w", w).groupBy("i").agg(*[(F.sum(F.col("w") * F.col(f"n{c}")) / F.sum("w")).alias(f"m{c}") for c in XYZ])
    joined = points.select("pid", *XYZ).join(mean, F.col("pid") == F.col("i"), "left")
    return joined.select("pid", *[F.coalesce((1 - strength) * F.col(c) + strength * F.col(f"m{c}"), F.col(c)).alias(c) for c in XYZ])


def mls_step(points: DataFrame, radius: float = 0.1, least: int = 8, strength: float = 1.0) -> DataFrame:
    """``points`` moved along the normal of a Gaussian-weighted plane of the ball around them.

    The move is scaled by planarity, 1 - 3 * least eigenvalue / trace; points with
    fewer than ``least`` neighbours stay.
    """
    near = radius_join(points.withColumnRenamed("pid", "i").select("i", *XYZ), points.select(F.col("pid").alias("j"), *XYZ), radius)
    w = F.exp(-(F.col("d") * F.col("d")) / (0.5 * radius * radius))
    sums = near.withColumn("w", w).groupBy("i").agg(
        F.count("*").alias("n"), F.sum("w").alias("sw"), *[F.sum(F.col("w") * F.col(c)).alias(f"s{c}") for c in XYZ],
        *[F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in MOMENTS],
    )
    means = sums.select("i", "n", "sw", *[(F.col(f"s{c}") / F.col("sw")).alias(f"m{c}") for c in XYZ], *[f"s{m}" for m in MOMENTS])
    cov = means.withColumns({m: F.col(f"s{m}") / F.col("sw") - F.col(f"m{m[0]}") * F.col(f"m{m[1]}") for m in MOMENTS})
    cov = cov.withColumn("axes", principal_axes(*map(F.col, MOMENTS)))
    n = _axis(2)
    flat = dot(n, [dot(n, [F.col(a) for a in row]) for row in (("xx", "xy", "xz"), ("xy", "yy", "yz"), ("xz", "yz", "zz"))])
    planarity = F.greatest(1 - 3 * flat / F.greatest(F.col("xx") + F.col("yy") + F.col("zz"), F.lit(1e-12)), F.lit(0.0))
    joined = points.select("pid", *XYZ).join(cov, F.col("pid") == F.col("i"), "left")
    off = dot(n, [F.col(c) - F.col(f"m{c}") for c in XYZ])
    move = F.when(F.col("n") >= least, strength * planarity * off).otherwise(0.0)
    return joined.select("pid", *[(F.col(c) - F.coalesce(move * v, F.lit(0.0))).alias(c) for c, v in zip(XYZ, n, strict=True)])


def fit_lines(lines: DataFrame) -> DataFrame:
    """(line_id, n, linearity, length, and the end points a*, b*) of a straight fit to each polyline.

    Linearity is the share of the two lesser eigenvalues over the largest; 0 is
    straight.  Ends are the outermost projections on the fitted axis.
    """
    m = lines.groupBy("line_id").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in XYZ], *[c.alias(k) for c, k in zip(covariance(), MOMENTS, strict=True)]
    )
    m = m.withColumn("axes", principal_axes(*map(F.col, MOMENTS)))
    keyed = m.withColumnRenamed("line_id", "fit_id")
    u = _axis(0)
    t = dot(u, [F.col(c) - F.col(f"m{c}") for c in XYZ])
    spread = lines.join(keyed, F.col("line_id") == F.col("fit_id")).groupBy("line_id").agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.var_pop(t).alias("along"))
    joined = m.join(spread.withColumnRenamed("line_id", "sid"), F.col("line_id") == F.col("sid"))
    rest = (F.col("xx") + F.col("yy") + F.col("zz") - F.col("along")) / F.greatest(F.col("along"), F.lit(1e-300))
    ends = [(F.col(f"m{c}") + F.col(k) * v).alias(f"{p}{c}") for p, k in (("a", "t0"), ("b", "t1")) for c, v in zip(XYZ, u, strict=True)]
    return joined.select("line_id", "n", F.greatest(rest, F.lit(0.0)).alias("linearity"), (F.col("t1") - F.col("t0")).alias("length"), *ends)


def straighten(lines: DataFrame, min_length: float = 0.08, max_linearity: float = 0.08, step: float = 0.02) -> DataFrame:
    """(line_id, k, x, y, z): long, nearly straight polylines replaced by even points on their fitted segment."""
    good = fit_lines(lines).where((F.col("length") >= min_length) & (F.col("linearity") <= max_linearity))
    n = F.greatest(F.lit(2), F.ceil(F.col("length") / step) + 1).cast("long")
    marks = good.withColumn("n", n).select("line_id", "n", *[f"{p}{c}" for p in "ab" for c in XYZ], F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    t = F.col("k") / (F.col("n") - 1)
    return marks.select("line_id", "k", *[(F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * t).alias(c) for c in XYZ])


def taubin(nodes: DataFrame, edges: DataFrame, rounds: int = 8, shrink: float = 0.5, grow: float = -0.53) -> DataFrame:
    """``nodes(pid, x, y, z)`` smoothed at nodes of two edges by alternating steps; the others stay."""
    arcs = stored(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "taubin-arcs")
    two = stored(arcs.groupBy("u").count().where("count = 2").select(F.col("u").alias("two")), "taubin-nodes")
    moved = arcs.join(two, F.col("u") == F.col("two"), "left_semi")
    current = stored(nodes.select("pid", *XYZ), "taubin")
    for r in range(2 * rounds):
        strength = shrink if r % 2 == 0 else grow
        at = current.select(F.col("pid").alias("q"), *[F.col(c).alias(f"q{c}") for c in XYZ])
        mean = moved.join(at, F.col("v") == F.col("q")).groupBy("u").agg(*[F.avg(f"q{c}").alias(f"m{c}") for c in XYZ])
        joined = current.join(mean, F.col("pid") == F.col("u"), "left")
        current = stored(joined.select("pid", *[F.coalesce(F.col(c) + strength * (F.col(f"m{c}") - F.col(c)), F.col(c)).alias(c) for c in XYZ]), "taubin")
    return current


def opposite_centers(nodes: DataFrame, points: DataFrame, radius: float, least: int = 5, width: tuple[float, float] = (0.3, 2.2)) -> DataFrame:
    """(pid, x, y, z): nodes moved midway between the two sides of the surface around them.

    The points in the ball are split by the sign of their normals along the main
    axis of the normals; a node moves if both sides have ``least`` points and the
    gap between their means is within ``width`` times the radius.
    """
    normal = ("nx", "ny", "nz")
    near = stored(radius_join(nodes.select(F.col("pid").alias("i"), *XYZ), points.select(F.col("pid").alias("j"), *XYZ, *normal), radius), "ball")
    m = near.groupBy(F.col("i").alias("mi")).agg(*[F.avg(c).alias(f"m{c}") for c in normal], *[c.alias(k) for c, k in zip(covariance(normal), MOMENTS, strict=True)])
    m = m.withColumn("axes", principal_axes(*map(F.col, MOMENTS)))
    side = dot(_axis(0), [F.col(c) - F.col(f"m{c}") for c in normal])
    split = near.join(m, F.col("i") == F.col("mi")).groupBy("i").agg(
        *[F.sum((side > 0).cast("int") if s else (side <= 0).cast("int")).alias(f"n{s}") for s in (0, 1)],
        *[F.avg(F.when(side > 0 if s else side <= 0, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in XYZ],
    )
    gap = norm([F.col(f"{c}1") - F.col(f"{c}0") for c in XYZ])
    good = split.where((F.col("n0") >= least) & (F.col("n1") >= least) & gap.between(width[0] * radius, width[1] * radius))
    joined = nodes.select("pid", *XYZ).join(good, F.col("pid") == F.col("i"), "left")
    return joined.select("pid", *[F.coalesce((F.col(f"{c}0") + F.col(f"{c}1")) / 2, F.col(c)).alias(c) for c in XYZ])
