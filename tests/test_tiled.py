"""Pairs put out in tiles: the rows of the joins, in an order that makes small files."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquilt.functions.linalg import rounded, rounded_soon
from geoquilt.operators import balls, graphs, spatial
from geoquilt.plans.queries import QUERIES

EXTRA = [(None, 0.1, 0.1, 0.1), (7000, None, 0.0, 0.0), (7001, 0.3, 0.3, 0.3), (7002, 0.3, 0.3, 0.3)]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    at = np.concatenate([rng.normal(0, 0.03, (500, 3)), rng.uniform(-1, 1, (60, 3))])
    at[40:60] = at[3]
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)] + EXTRA, "pid long, x double, y double, z double").cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("wide", "slice_", "tile"), [(4096, 1 << 20, 1 << 22), (16, 64, 100)])
def test_tiles_have_the_rows_of_the_joins(spark, points, monkeypatch, wide, slice_, tile):
    monkeypatch.setattr(balls, "WIDE", wide)
    monkeypatch.setattr(balls, "SLICE", slice_)
    monkeypatch.setattr(balls, "TILE", tile)
    want = rows(spatial.radius_pairs(points, 0.05))
    assert rows(balls.near_pairs(points, 0.05)) == want
    long = [r for r in want if r[2] >= 0.02]
    assert rows(graphs.near_adjacency(points, 0.05, 0.02)) == sorted(long + [(v, u, w) for u, v, w in long])


def test_tiles_of_radii_of_their_own(spark, points):
    radius = F.when(F.col("pid") == 5, None).when(F.col("pid") == 6, -1.0).when(F.col("pid") == 7, float("inf")).when(F.col("pid") < 50, 0.0).otherwise(0.001 * 2.0 ** (F.col("pid") % 9))
    probe = points.select(F.col("pid").alias("i"), "x", "y", "z", radius.alias("radius"))
    other = points.withColumnRenamed("pid", "j")
    want = rows(spatial.radius_join_own(probe, other).where("i <> j"))
    assert rows(balls.near_pairs_own(probe, other, np.not_equal)) == want and len(want) > 1000
    assert rows(balls.near_pairs_own(probe.where("i < 50"), other, np.not_equal)) == rows(spatial.radius_join_own(probe.where("i < 50"), other).where("i <> j"))
    assert balls.near_pairs_own(probe.where("i = 6"), other).count() == 0


def _bytes_a_row(spark, df, folder) -> float:
    df.coalesce(1).write.parquet(str(folder))
    return sum(f.stat().st_size for f in folder.iterdir() if f.name.endswith(".parquet")) / spark.read.parquet(str(folder)).count()


def test_files_of_pairs_are_small(spark, tmp_path):
    rng = np.random.default_rng(6)
    cloud = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 0.1, (2000, 3)))], "pid long, x double, y double, z double").cache()
    assert _bytes_a_row(spark, graphs.near_adjacency(cloud, 0.1, 0.0513).select("u", "v", rounded(F.col("w")).alias("w")), tmp_path / "both") < 4
    assert _bytes_a_row(spark, balls.near_pairs(cloud, 0.1).select("u", "v", rounded(F.col("w")).alias("w")), tmp_path / "once") < 4


def test_quick_rounding_is_rounding(spark):
    odd = [float("nan"), float("inf"), -float("inf"), None, 0.0, -0.0, 1e300, -1e-300, 5e-7, 1.5e-6, -5e-7, 2.5e-6, 1e9, 123456.1234565, 0.1234565]
    more = [k / 2e6 for k in range(-2000, 2000)] + np.random.default_rng(8).normal(0, 1, 4000).tolist()
    df = spark.createDataFrame([(v,) for v in odd + more], "x double")
    same = rounded(F.col("x")).cast("string").eqNullSafe(rounded_soon(F.col("x")).cast("string"))
    assert df.where(~same).count() == 0


@pytest.mark.parametrize("name", ["em_estep", "em_estep_all", "edge_samples"])
def test_rows_of_pairs_are_rounded_by_arithmetic(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FLOOR" in plan.split("Join")[0]
