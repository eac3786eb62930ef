"""Neighbour joins on a grid: fixed radius, radius per row, k nearest.

A predicate on distance alone would compare all pairs.  Points are dealt into
cells as wide as the radius, the probing side is copied to the 27 cells around
it, and the join is an equality on the cell, followed by the exact distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquilt.functions.linalg import squared_distance
from geoquilt.storage import stored

XYZ = ("x", "y", "z")


def cells(size: float | Column, columns: tuple[str, ...] = XYZ) -> list[Column]:
    """Cell indices of a point, the grid's origin at zero."""
    return [F.floor(F.col(c) / size).cast("long") for c in columns]


def radius_join(probe: DataFrame, points: DataFrame, radius: float, probe_id: str = "i", point_id: str = "j") -> DataFrame:
    """(i, j, d) of all ``probe(i, x, y, z)`` and ``points(j, x, y, z)`` within ``radius`` of each other.

    The ball is closed.  A point also meets itself if it is on both sides.  Other
    columns of ``points`` are carried, those of ``probe`` are not.
    """
    home = probe.select(F.col(probe_id), *[F.col(c).alias(f"p{c}") for c in XYZ])
    for c in XYZ:
        cell = F.floor(F.col(f"p{c}") / radius).cast("long")
        home = home.withColumn(f"g{c}", F.explode(F.array(cell - 1, cell, cell + 1)))
    held = points.withColumns({f"h{c}": v for c, v in zip(XYZ, cells(radius), strict=True)})
    same = (F.col("gx") == F.col("hx")) & (F.col("gy") == F.col("hy")) & (F.col("gz") == F.col("hz"))
    d2 = squared_distance([F.col(f"p{c}") for c in XYZ], [F.col(c) for c in XYZ])
    joined = home.join(held, same).withColumn("d", F.sqrt(d2)).where(F.col("d") <= radius)
    return joined.select(probe_id, *points.columns, "d")


def radius_pairs(points: DataFrame, radius: float) -> DataFrame:
    """Pairs (u, v, w) of ``points(pid, x, y, z)`` with u < v and distance w up to ``radius``."""
    other = points.select(F.col("pid").alias("v"), *XYZ)
    own = points.select(F.col("pid").alias("u"), *XYZ)
    found = radius_join(own, other, radius, "u", "v").where(F.col("u") < F.col("v"))
    return found.select("u", "v", F.col("d").alias("w"))


def within_reach(probe: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Rows of ``probe(x, y, z, ...)`` with one of ``points(x, y, z)`` within ``radius``.

    The points are copied to the cells around them and the probes stay single rows, each
    looked at until a point is near: no pair leaves the join, and none is broadcast.
    """
    there = points.select(*[F.col(c).alias(f"p{c}") for c in XYZ]).distinct()
    for c in XYZ:
        cell = F.floor(F.col(f"p{c}") / radius).cast("long")
        there = there.withColumn(f"g{c}", F.explode(F.array(cell - 1, cell, cell + 1)))
    home = probe.withColumns({f"h{c}": v for c, v in zip(XYZ, cells(radius), strict=True)})
    near = F.sqrt(squared_distance([F.col(c) for c in XYZ], [F.col(f"p{c}") for c in XYZ])) <= radius
    for c in XYZ:
        near = near & (F.col(f"h{c}") == F.col(f"g{c}"))
    return home.join(there.hint("merge"), near, "left_semi").drop(*[f"h{c}" for c in XYZ])


def radius_join_own(probe: DataFrame, points: DataFrame, radius: str = "radius", probe_id: str = "i", point_id: str = "j", most: int = 16_384) -> DataFrame:
    """(i, j, d) of all ``points(j, x, y, z)`` within the radius that each ``probe(i, x, y, z, radius)`` has of its own.

    Probes are grouped by the power of two that their radius does not exceed, each
    power with a grid of its own, so a probe of any radius looks into 27 cells.  A cell
    that more than ``most`` probes look into is given to several tasks, each with its points.
    Probes with a null, negative or infinite radius meet nothing.
    """
    level = F.when(F.col(radius) > 0, F.ceil(F.log2(radius))).otherwise(-40).cast("int")
    home = probe.where((F.col(radius) >= 0) & (F.col(radius) < float("inf"))).select(
        F.col(probe_id), F.col(radius).alias("own"), level.alias("level"), *[F.col(c).alias(f"p{c}") for c in XYZ]
    )
    levels = [r[0] for r in home.select("level").distinct().collect()]  # one for each power of two in use
    size = F.pow(F.lit(2.0), F.col("level"))
    for c in XYZ:
        cell = F.floor(F.col(f"p{c}") / size).cast("long")
        home = home.withColumn(f"g{c}", F.explode(F.array(cell - 1, cell, cell + 1)))
    held = points.withColumn("grid", F.explode(F.array(*map(F.lit, levels or [0]))))
    held = held.withColumns({f"h{c}": F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("grid"))).cast("long") for c in XYZ})
    crowd = home.groupBy("level", "gx", "gy", "gz").agg(F.ceil(F.count("*") / most).cast("int").alias("chunks")).where("chunks > 1").toDF("wl", "wx", "wy", "wz", "chunks")
    crowd = F.broadcast(stored(crowd, "crowded-cells"))  # at most one row for ``most`` copies of probes
    at = lambda k, n: (F.col(k) == F.col("wl")) & (F.col(f"{n}x") == F.col("wx")) & (F.col(f"{n}y") == F.col("wy")) & (F.col(f"{n}z") == F.col("wz"))
    chunks = F.coalesce("chunks", F.lit(1))
    home = home.join(crowd, at("level", "g"), "left").withColumn("own_chunk", F.pmod(F.xxhash64(probe_id), chunks).cast("int")).drop(*crowd.columns)
    held = held.join(crowd, at("grid", "h"), "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop(*crowd.columns)
    same = (F.col("level") == F.col("grid")) & (F.col("own_chunk") == F.col("chunk"))
    for c in XYZ:
        same = same & (F.col(f"g{c}") == F.col(f"h{c}"))
    d2 = squared_distance([F.col(f"p{c}") for c in XYZ], [F.col(c) for c in XYZ])
    return home.join(held.hint("merge"), same).withColumn("d", F.sqrt(d2)).where(F.col("d") <= F.col("own")).select(probe_id, point_id, "d")


def hybrid_neighbours(points: DataFrame, radius: float, max_nn: int) -> DataFrame:
    """(i, j, d, rank) of the ``max_nn`` nearest within ``radius`` of every point, itself left out; ties go by j."""
    return knn_self(points.select("pid", *XYZ), max_nn, reach=radius).where(F.col("d") <= radius)


def typical_radius(points: DataFrame, k: int) -> float:
    """Radius of a ball that would hold about ``k`` points, where most points are.

    It starts from the box without the outermost hundredth on each side, so that a
    far point does not widen it, and is halved while the cells of that size in
    which points stand are crowded, as on surfaces and in clusters.
    """
    ends = points.agg(F.count("*").alias("n"), *[F.percentile_approx(c, [0.01, 0.99], 1000).alias(c) for c in XYZ]).first()
    spans = [ends[c][1] - ends[c][0] if ends[c] else 0.0 for c in XYZ]
    if not ends["n"] or max(spans) == 0:
        return 1.0
    volume = 1.0
    for s in spans:
        volume *= max(s, 0.01 * max(spans))
    radius = (0.75 / 3.141592653589793 * k * volume / ends["n"]) ** (1 / 3)
    for _ in range(20):  # repeated points crowd any cell
        held = points.groupBy(*[c.alias(n) for n, c in zip("abc", cells(radius), strict=True)]).agg(F.count("*").alias("n"))
        if held.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] <= 2 * k + 2:
            break
        radius /= 2
    return radius


def knn(probe: DataFrame, points: DataFrame, k: int, radius: float | None = None, exclude_self: bool = True, reach: float | None = None) -> DataFrame:
    """(i, j, d, rank) of the ``k`` nearest ``points(j)`` of every ``probe(i)``; ties go by j.

    Within a radius that holds k neighbours the answer is exact; probes that find
    fewer try again with twice the radius, until the radius covers the joint box,
    so ``k`` may exceed the number of points.  With ``exclude_self`` a point is no
    neighbour of the row with its id.  With ``reach`` nobody looks further than that,
    so that rows come with what of their k nearest lies within it, or with less.
    """
    both = probe.select(*XYZ).unionByName(points.select(*XYZ))
    span = both.agg(F.sqrt(sum((F.max(c) - F.min(c)) * (F.max(c) - F.min(c)) for c in XYZ))).first()[0] or 0.0
    reach = float("inf") if reach is None else reach
    radius = min(radius or typical_radius(points, k), reach)
    points = points.select("j", *XYZ)
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    todo, done = probe.select("i", *XYZ), None
    while True:
        found = radius_join(todo, points, radius)
        found = found.where(F.col("i") != F.col("j")) if exclude_self else found
        best = stored(found.select("i", "j", "d", rank.alias("rank")).where(F.col("rank") <= k), "nearest")
        if radius > span or radius >= reach:
            part, left = best, None
        else:
            full = best.where(F.col("rank") == k).select(F.col("i").alias("full"))
            part = best.join(full, F.col("i") == F.col("full"), "left_semi")
            left = todo.join(full, F.col("i") == F.col("full"), "left_anti")
        done = part if done is None else done.unionByName(part)
        if left is None or left.isEmpty():
            return done
        todo, radius = left, min(radius * 2, reach)


def knn_self(points: DataFrame, k: int, radius: float | None = None, reach: float | None = None) -> DataFrame:
    """k nearest neighbours within one cloud ``points(pid, x, y, z)``, the point itself excluded."""
    return knn(points.withColumnRenamed("pid", "i"), points.withColumnRenamed("pid", "j"), k, radius, reach=reach)
