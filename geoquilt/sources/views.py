"""Geometric relations derived from the input tables.

Geometry is flat columns (so that statistics and push-down apply) with explicit
ids; arrays appear only where a row owns them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoquilt.storage import table

MODULUS, FACTOR = 1_000_003, 2_654_435_761


def hash_uniform(key, salt: int = 0):
    """A number in [0, 1) from an integer key, by arithmetic that every SQL engine can repeat."""
    # the factor is reduced first, which leaves the same number and keeps large keys from an overflow
    return F.pmod(F.pmod(key, F.lit(MODULUS)) * (FACTOR % MODULUS) + F.lit(salt * 7919), F.lit(MODULUS)) / float(MODULUS)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point clouds: pid, cloud, x, y, z from the first three embedding dimensions."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("pid"), F.col("label").alias("cloud"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")],
    )


def oriented_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with unit normals (dimensions 3-5) and colors in [0, 1] (dimensions 6-8)."""
    e = table(spark, sf_dir, "embeddings")
    dim = lambda i: F.col("embedding")[i].cast("double")
    norm = F.sqrt(dim(3) * dim(3) + dim(4) * dim(4) + dim(5) * dim(5))
    return e.select(
        F.col("vec_id").alias("pid"), F.col("label").alias("cloud"),
        *[dim(i).alias(c) for i, c in enumerate("xyz")],
        *[(dim(3 + i) / norm).alias(c) for i, c in enumerate(("nx", "ny", "nz"))],
        *[((dim(6 + i) + 1) / 2).alias(c) for i, c in enumerate("rgb")],
    )


def large_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many points by frame, without identity: frame, x, y, z."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_suppkey").alias("frame"), F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"),
    )


def depth_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth frames of 25 x 40 pixels: frame, row, col, raw (millimetres)."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.floor(i / 1000).alias("frame"), F.floor(i % 1000 / 40).alias("row"), (i % 1000 % 40).alias("col"),
        (F.col("value") * 10).alias("raw"),
    )


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera poses by frame: position in millimetres, angles in degrees."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("frame"), (F.col("s_acctbal") / 10).alias("x"), (k * 5).cast("double").alias("y"), (k + 500).cast("double").alias("z"),
        *[(k * f % 360 - 180).cast("double").alias(c) for c, f in (("rx", 37), ("ry", 53), ("rz", 71))],
    )


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreground cells (row, col) of a binary image: those with more than a 2600th of all lines."""
    t = table(spark, sf_dir, "lineitem")
    cells = t.groupBy(
        F.floor(F.col("l_extendedprice") / 2100).alias("row"), F.col("l_quantity").cast("long").alias("col")
    ).count()
    total = F.broadcast(t.agg(F.count("*").alias("total")))
    return cells.join(total, F.col("count") > F.col("total") / 2600).select("row", "col")


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines: line_id, seq (from 1), x, y, z, one line per user in the order of events."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.withColumn("seq", F.row_number().over(order).cast("long")).select(
        F.col("user_id").alias("line_id"), "seq", (F.col("seq") * 0.1).alias("x"), (F.col("value") / 100).alias("y"),
        (F.col("event_id") % 7 * 0.1).alias("z"),
    )


def height_mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every depth frame as a height field: vertices (vid, x, y, z) and triangles (tid, a, b, c)."""
    d = depth_pixels(spark, sf_dir).withColumn("vid", F.col("frame") * 1000 + F.col("row") * 40 + F.col("col"))
    vertices = d.select(
        "vid", (F.col("col") * 0.01).alias("x"), (F.col("row") * 0.01).alias("y"), (F.col("raw") / 100000).alias("z")
    )
    # a quad is known by its first pixel, to which each of its four reports: one exchange, and nothing that a join might broadcast
    v = F.col("vid")
    reports = d.select(F.inline(F.array(*[F.struct((v - o).alias("q"), F.lit(1 << k).alias("bit")) for k, o in enumerate((0, 1, 40, 41))])))
    seen = reports.groupBy("q").agg(F.bit_or("bit").alias("bits"), F.count_if(F.col("bit") == 1).cast("int").alias("n"))
    inside = (F.floor(F.col("q") % 1000 / 40) < 24) & (F.col("q") % 1000 % 40 < 39) & (F.col("q") >= 0)
    quads = seen.where(inside & (F.col("n") > 0) & (F.col("bits") >= 7))
    q = F.col("q")
    halves = F.array(
        F.struct((2 * q).alias("tid"), q.alias("a"), (q + 1).alias("b"), (q + 40).alias("c"), F.lit(7).alias("need")),
        F.struct((2 * q + 1).alias("tid"), (q + 1).alias("a"), (q + 41).alias("b"), (q + 40).alias("c"), F.lit(14).alias("need")),
    )
    # a frame that is cut off has no triangle beyond its last pixel; a repeated pixel repeats its triangles
    made = quads.select("bits", "n", F.inline(halves)).where(F.col("bits").bitwiseAND(F.col("need")) == F.col("need"))
    corner = made.select("tid", "a", "b", "c", F.explode(F.array_repeat(F.lit(0), F.col("n")))).drop("col")
    return vertices, corner


METRICS = ("bottleneck", "w2", "em_smooth", "ct_smooth", "em_bounded", "ct_bounded", "em_centered", "ct_centered")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials with eight metrics from arithmetic hashes; every 17th value of a metric is NaN."""
    k = F.col("p_partkey")
    value = lambda i: F.when((k + i) % 17 == 0, F.lit(float("nan"))).otherwise(F.pmod(k * (7919 + 104729 * i), F.lit(1009)) / 1009.0)
    return table(spark, sf_dir, "part").select(k.alias("trial"), *[value(i).alias(m) for i, m in enumerate(METRICS)])
