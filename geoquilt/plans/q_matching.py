"""Queries of matched features and color gradients, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquilt.functions.linalg import rounded
from geoquilt.operators import colored, matching
from geoquilt.plans.oracles import ORIENTED, using
from geoquilt.sources import views
from geoquilt.storage import table


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The clouds of even and of odd label, with the whole embedding as feature."""
    every = table(s, d, "embeddings").select(F.col("vec_id").alias("pid"), F.col("embedding").alias("feature"), F.pmod("label", F.lit(2)).alias("half"))
    return every.where("half = 0").drop("half"), every.where("half = 1").drop("half")


def feature_nearest(s: SparkSession, d: str) -> DataFrame:
    """Nearest feature in the odd clouds of every point of the even ones."""
    return matching.nearest_features(*_halves(s, d)).select("i", "j", rounded(F.col("d")).alias("d"))


def feature_matches(s: SparkSession, d: str) -> DataFrame:
    """Points of even and odd clouds that are each other's nearest by feature."""
    return matching.mutual_matches(*_halves(s, d)).select("i", "j", rounded(F.col("d")).alias("d"))


def color_gradients(s: SparkSession, d: str) -> DataFrame:
    """Gradient of the intensity in the tangent plane of every point."""
    p = views.oriented_points(s, d).select("pid", "x", "y", "z", "nx", "ny", "nz", colored.intensity())
    return colored.color_gradients(p, 0.15).select("pid", *[F.round(g, 4).alias(g) + F.lit(0.0) for g in colored.GRADIENT]).toDF("pid", *colored.GRADIENT)


_PAIRS = """SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.label % 2 = 0 AND b.label % 2 = 1"""
_THERE = "SELECT i, min_by(j, (d, j)) AS j, min(d) AS d FROM pairs GROUP BY i"
_BACK = "SELECT j, min_by(i, (d, i)) AS i FROM pairs GROUP BY j"
_FLAT = """SELECT i, n, sx - off * nx AS fx, sy - off * ny AS fy, sz - off * nz AS fz, rise FROM (
  SELECT a.pid AS i, a.nx, a.ny, a.nz, b.x - a.x AS sx, b.y - a.y AS sy, b.z - a.z AS sz, (b.x - a.x) * a.nx + (b.y - a.y) * a.ny + (b.z - a.z) * a.nz AS off, b.shade - a.shade AS rise, count(*) OVER (PARTITION BY a.pid) AS n
  FROM shaded a JOIN shaded b ON a.pid <> b.pid AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.15)"""
_SUMS = "SELECT i, sum(fx * fx) AS xx, sum(fx * fy) AS xy, sum(fx * fz) AS xz, sum(fy * fy) AS yy, sum(fy * fz) AS yz, sum(fz * fz) AS zz, sum(fx * rise) AS tx, sum(fy * rise) AS ty, sum(fz * rise) AS tz FROM flat WHERE n >= 4 GROUP BY i"
#: The two in-plane equations with the normal's row added, solved by Cramer's rule.
_FULL = """SELECT p.pid, nx, ny, nz, tx, ty, tz, xx + h * nx * nx + e AS a, xy + h * nx * ny AS b, xz + h * nx * nz AS c, yy + h * ny * ny + e AS d, yz + h * ny * nz AS f, zz + h * nz * nz + e AS g
  FROM shaded p LEFT JOIN (SELECT *, xx + yy + zz AS h, (xx + yy + zz) * 1e-9 + 1e-12 AS e FROM sums) s ON s.i = p.pid"""
_SLOPE = """SELECT *, (tx * (d * g - f * f) - b * (ty * g - f * tz) + c * (ty * f - d * tz)) / det AS ux, (a * (ty * g - f * tz) - tx * (b * g - f * c) + c * (b * tz - ty * c)) / det AS uy,
  (a * (d * tz - ty * f) - b * (b * tz - ty * c) + tx * (b * f - d * c)) / det AS uz FROM (SELECT *, a * (d * g - f * f) - b * (b * g - f * c) + c * (b * f - d * c) AS det FROM full_rows)"""
QUERIES = {f.__name__: f for f in (feature_nearest, feature_matches, color_gradients)}
ORACLES = {
    "feature_nearest": using("SELECT i, j, round(d, 6) AS d FROM there", pairs=_PAIRS, there=_THERE),
    "feature_matches": using("SELECT t.i, t.j, round(d, 6) AS d FROM there t JOIN back b ON b.i = t.i AND b.j = t.j", pairs=_PAIRS, there=_THERE, back=_BACK),
    "color_gradients": using(
        "SELECT pid, " + ", ".join(f"round(coalesce(u{c} - (ux * nx + uy * ny + uz * nz) * n{c}, 0), 4) + 0.0::DOUBLE AS g{c}" for c in "xyz") + " FROM slope",
        oriented=ORIENTED, shaded="SELECT *, (r + g + b) / 3 AS shade FROM oriented", flat=_FLAT, sums=_SUMS, full_rows=_FULL, slope=_SLOPE,
    ),
}
