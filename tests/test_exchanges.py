"""What is exchanged and broadcast: work in proportion to the rows, not to their pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquilt.operators import graphs, meshes, spatial
from geoquilt.sources import views
from geoquilt.storage import stored
from tests.test_balls import exchanged

KEY = 72_000_000 * 1009 + 7


def _broadcasts(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_hash_of_a_large_key_does_not_overflow(spark):
    got = spark.range(KEY, KEY + 3).select(views.hash_uniform(F.col("id"), 2).alias("h"))
    want = [((KEY + k) * views.FACTOR + 2 * 7919) % views.MODULUS / views.MODULUS for k in range(3)]
    assert [r["h"] for r in got.collect()] == want


def test_hash_of_a_small_key_is_what_it_was(spark):
    got = spark.range(-2, 3).select("id", views.hash_uniform(F.col("id"), 5).alias("h")).collect()
    assert [r["h"] for r in got] == [(r["id"] * views.FACTOR + 5 * 7919) % views.MODULUS / views.MODULUS for r in got]


def test_pruned_mesh_broadcasts_no_table(spark):
    vertices = spark.range(600).select(F.col("id").alias("vid"), (F.col("id") % 30 * 0.1).alias("x"), (F.floor(F.col("id") / 30) * 0.1).alias("y"), F.lit(0.0).alias("z"))
    triangles = spark.range(570).where("id % 30 < 29").select(F.col("id").alias("tid"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") + 30).alias("c"))
    cloud = spark.createDataFrame([(0, 1.0, 1.0, 0.0), (1, 1.0, 1.0, 0.04), (2, 9.0, 9.0, 0.0)], "pid long, x double, y double, z double")
    kept = meshes.prune_by_distance(vertices, triangles, cloud, 0.05)
    assert sorted(r["tid"] for r in kept.collect()) == [280, 309, 310]
    assert _broadcasts(kept) == 0


@pytest.mark.parametrize("gone", [0, 1, 40, 41, 1024])
def test_triangles_of_a_frame_that_lacks_a_pixel(spark, tmp_path, gone):
    events = spark.range(1025).where(F.col("id") != gone).select(F.col("id").alias("event_id"), F.lit(1.0).alias("value"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    _, triangles = views.height_mesh(spark, str(tmp_path))
    there = set(range(1025)) - {gone}
    want = []
    for v in there:
        if v % 1000 // 40 < 24 and v % 1000 % 40 < 39:
            want += [t for t in ((2 * v, v, v + 1, v + 40), (2 * v + 1, v + 1, v + 41, v + 40)) if there.issuperset(t[1:])]
    assert sorted(map(tuple, triangles.collect())) == sorted(want)


def test_parts_of_neighbouring_ids_go_through_no_round(spark):
    """Paths of 1,000 ids each, joined in their blocks; what crosses a block, and ids below zero, still meet."""
    size = 1 << graphs.SPAN_BITS
    ids = spark.range(-1000, 3 * size).withColumnRenamed("id", "vid")
    steps = ids.where("vid % 1000 <> 0").select("vid", (F.col("vid") - 1).alias("v")).toDF("u", "v")
    extra = [(-1000, 2 * size + 5), (7, 7), (8, 7), (40 * size, 3)]
    nodes = stored(ids.unionByName(spark.createDataFrame([(40 * size,), (50 * size,)], "vid long")), "nodes")
    links = stored(steps.unionByName(spark.createDataFrame(extra, "u long, v long")), "links")
    part = {r["vid"]: r["vid"] for r in nodes.collect()}

    def root(v):
        while part[v] != v:
            part[v] = v = part[part[v]]
        return v

    for r in links.collect():
        a, b = sorted((root(r["u"]), root(r["v"])))
        part[b] = a
    got = {}
    count = exchanged(spark, lambda: got.update({r["vid"]: r["component"] for r in graphs.label_components(nodes, links).collect()}))
    assert got == {v: root(v) for v in part}
    assert count < 5 * nodes.count()  # the stars alone exchanged every edge many times
    texts = spark.createDataFrame([("b", "a"), ("c", "b")], "u string, v string")
    lone = spark.createDataFrame([("a",), ("c",), ("z",)], "vid string")
    assert {tuple(r) for r in graphs.label_components(lone, texts).collect()} == {("a", "a"), ("c", "a"), ("z", "z")}


def test_a_crowded_cell_is_dealt_to_several_tasks(spark):
    rng = np.random.default_rng(1)
    at = rng.random((400, 3)) * 0.9 + 0.05  # one cell of the greater radii
    rows = [(i, *map(float, p), 0.6 if i % 2 else 0.05) for i, p in enumerate(at)]
    probe = spark.createDataFrame(rows, "i long, x double, y double, z double, radius double")
    points = probe.select(F.col("i").alias("j"), "x", "y", "z")
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be one task
    try:
        got = spatial.radius_join_own(probe, points, most=32).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r["i"], r["j"]) for r in got) == [(i, j) for i in range(400) for j in range(400) if d[i, j] <= rows[i][4]]
    tasks = [r["task"] for r in got]
    assert max(tasks.count(k) for k in set(tasks)) < 0.7 * len(got)
