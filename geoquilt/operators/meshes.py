"""Mesh cleaning and sampling, synthetic clouds, several planes and tuned morphology."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoquilt.functions.linalg import cross, norm
from geoquilt.operators import graphs, raster, shapes
from geoquilt.operators.spatial import XYZ, within_reach
from geoquilt.sources.views import hash_uniform
from geoquilt.storage import stored


def keep_vertices(triangles: DataFrame, kept: DataFrame, all_corners: bool = False) -> DataFrame:
    """Triangles with any (or all) corner in ``kept(vid)``.

    Both joins are by exchange: files tell too little of how many rows a broadcast would hold.
    """
    corners = triangles.select("tid", F.explode(F.array("a", "b", "c")).alias("corner"))
    hits = corners.join(kept.hint("merge"), F.col("corner") == F.col("vid"), "left_semi").groupBy(F.col("tid").alias("hit")).count()
    return triangles.join(hits.where(F.col("count") >= (3 if all_corners else 1)).hint("merge"), F.col("tid") == F.col("hit"), "left_semi")


def crop_to_cloud(vertices: DataFrame, triangles: DataFrame, points: DataFrame, expand: float = 1.05) -> DataFrame:
    """Triangles whose corners all lie in the cloud's box, grown about its centre."""
    box = points.agg(*[((F.min(c) + F.max(c)) / 2).alias(f"m{c}") for c in XYZ], *[((F.max(c) - F.min(c)) / 2 * expand).alias(f"h{c}") for c in XYZ])
    inside = F.lit(True)
    for c in XYZ:
        inside = inside & (F.abs(F.col(c) - F.col(f"m{c}")) <= F.col(f"h{c}"))
    return keep_vertices(triangles, vertices.join(F.broadcast(box)).where(inside).select("vid"), True)  # one row


def prune_by_distance(vertices: DataFrame, triangles: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Triangles with a corner within ``radius`` of a point of the cloud."""
    near = within_reach(vertices.select("vid", *XYZ), points.select(*XYZ), radius)
    return keep_vertices(triangles, near.select("vid"))


def sample_surface(vertices: DataFrame, triangles: DataFrame, n: int) -> DataFrame:
    """(k, tid, x, y, z): about ``n`` points, each triangle's share its part of the area, by hashed coordinates.

    A triangle gets its expected number rounded by a hash, so nothing has to be
    accumulated over all triangles.
    """
    t = triangles.select("tid", "a", "b", "c")
    for p in "abc":
        corner = vertices.select(F.col("vid").alias(f"v{p}"), *[F.col(c).alias(f"{p}{c}") for c in XYZ])
        t = t.join(corner.hint("merge"), F.col(p) == F.col(f"v{p}"))
    side = lambda p: [F.col(f"{p}{c}") - F.col(f"a{c}") for c in XYZ]
    t = stored(t.withColumn("area", norm(cross(side("b"), side("c"))) / 2), "areas")
    total = F.broadcast(t.agg(F.sum("area").alias("total")))  # one row
    want = F.col("area") / F.col("total") * n
    t = t.join(total).withColumn("m", F.floor(want + hash_uniform(F.col("tid"))).cast("int")).where("m > 0")
    t = t.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    key = F.col("tid") * 1009 + F.col("k")
    u, v = F.sqrt(hash_uniform(key, 1)), hash_uniform(key, 2)
    at = [((1 - u) * F.col(f"a{c}") + u * (1 - v) * F.col(f"b{c}") + u * v * F.col(f"c{c}")).alias(c) for c in XYZ]
    return t.select("k", "tid", *at)


def vertex_normals(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Vertices with the unit mean of their triangles' normals; lone vertices get (0, 0, 1)."""
    n = ("nx", "ny", "nz")
    corners = graphs.triangle_normals(vertices, triangles).select(F.explode(F.array("a", "b", "c")).alias("v"), *n)
    mean = corners.groupBy("v").agg(*[F.sum(c).alias(c) for c in n])
    size = norm([F.col(c) for c in n])
    joined = vertices.join(mean, F.col("vid") == F.col("v"), "left")
    return joined.select(*vertices.columns, *[F.when(size > 0, F.col(c) / size).otherwise(d).alias(c) for c, d in zip(n, (0.0, 0.0, 1.0), strict=True)])


def two_cylinders(spark: SparkSession, n_first: int = 800, n_second: int = 600, noise: float = 0.02) -> DataFrame:
    """(pid, x, y, z): a cylinder of radius 1.5 and height 8, and one of 1.2 and 5 tilted by 45 degrees from its middle.

    Uniforms come from an arithmetic hash of the id, noise from pairs of them.
    """
    k = F.col("id")
    first = k < n_first
    turn = 2 * math.pi * hash_uniform(k, 1)
    r, h = F.when(first, 1.5).otherwise(1.2), F.when(first, 8.0).otherwise(5.0)
    x, y, z = r * F.cos(turn), r * F.sin(turn), h * hash_uniform(k, 2)
    s = math.sqrt(0.5)
    tilted = (s * x + s * z, y, 4.0 - s * x + s * z)
    gauss = lambda salt: noise * F.sqrt(-2 * F.log(hash_uniform(k, salt) + 1e-6)) * F.cos(2 * math.pi * hash_uniform(k, salt + 1))
    parts = [F.when(first, a).otherwise(b) + gauss(10 + 2 * i) for i, (a, b) in enumerate(zip((x, y, z), tilted, strict=True))]
    return spark.range(n_first + n_second).select(k.alias("pid"), *[p.alias(c) for p, c in zip(parts, XYZ, strict=True)])


def planes(points: DataFrame, distance: float, most: int = 4, trials: int = 64, least: int = 20) -> list[tuple[float, float, float, float, int]]:
    """Up to ``most`` planes (a, b, c, d, inliers), each of what the ones before have left."""
    rest, found = stored(points.select("pid", *XYZ), "planes"), []
    while len(found) < most:
        best = shapes.ransac_planes(rest, trials, distance).orderBy(F.desc("inliers"), "trial").first()
        if best is None or best["inliers"] < least:
            break
        found.append((best["a"], best["b"], best["c"], best["d"], best["inliers"]))
        taken = shapes.plane_inliers(rest, found[-1][:4], distance).select(F.col("pid").alias("taken"))
        rest = stored(rest.join(taken, F.col("pid") == F.col("taken"), "left_anti"), "planes")
    return found


def tuned_morphology(cells: DataFrame, closings: Sequence[int] = (1, 2), openings: Sequence[int] = (0, 1)) -> DataFrame:
    """One row per pair of sizes: components, share of the largest, growth, and the score; the least is best.

    The score is 1 - largest share + 0.3 * overgrowth + 0.25 * (components - 1) / 10,
    the last at most 0.25.
    """
    n = max(1, cells.count())
    out = None
    for c in closings:
        for o in openings:
            made = raster.closing(cells, c) if c else cells.select("row", "col")
            made = stored(raster.opening(made, o) if o else made, "morphology")
            ids = made.select((F.col("row") * (1 << 31) + F.col("col")).alias("vid"))
            near = raster.shifted(made, [x for x in raster.EIGHT if x > (0, 0)])
            links = near.select((F.col("row") * (1 << 31) + F.col("col")).alias("v"), ((F.col("row") - F.col("dr")) * (1 << 31) + F.col("col") - F.col("dc")).alias("u"))
            links = links.join(ids, F.col("v") == F.col("vid"), "left_semi")
            sizes = graphs.label_components(ids, links).groupBy("component").count()
            row = sizes.agg(F.count("*").alias("parts"), F.max("count").alias("top"), F.sum("count").alias("total"))
            top = F.coalesce(F.col("top") / F.col("total"), F.lit(0.0))
            grown = F.greatest(F.col("total") / n - 1, F.lit(0.0))
            score = 1 - top + 0.3 * grown + 0.25 * F.least((F.col("parts") - 1) / 10, F.lit(1.0))
            one = row.select(F.lit(c).alias("closing"), F.lit(o).alias("opening"), "parts", F.coalesce(score, F.lit(1.0)).alias("score"))
            out = one if out is None else out.unionByName(one)
    return out


def prune_polylines(lines: DataFrame, points: DataFrame, expand: float = 1.10) -> DataFrame:
    """Polylines whose middle vertex lies in the cloud's grown box."""
    box = points.agg(*[((F.min(c) + F.max(c)) / 2).alias(f"m{c}") for c in XYZ], *[((F.max(c) - F.min(c)) / 2 * expand + 1e-12).alias(f"h{c}") for c in XYZ])
    order = Window.partitionBy("line_id").orderBy("seq")
    ranked = lines.withColumn("k", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("line_id")))
    inside = F.lit(True)
    for c in XYZ:
        inside = inside & (F.abs(F.col(c) - F.col(f"m{c}")) <= F.col(f"h{c}"))
    good = ranked.where(F.col("k") == F.floor(F.col("n") / 2)).join(F.broadcast(box)).where(inside).select(F.col("line_id").alias("good"))  # one row
    return lines.join(good, F.col("line_id") == F.col("good"), "left_semi")
