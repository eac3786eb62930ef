"""Folds and pairs of what lies around points, against plain numpy, and what they exchange."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquilt.operators import balls, metrics, registration, skeletons, spatial

XYZ = ("x", "y", "z")
N = 700


def exchanged(spark, action) -> int:
    """Rows that all stages of ``action`` hand to an exchange."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def stages() -> dict:
        none = jvm.java.util.ArrayList()
        found = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none).iterator()
        out = {}
        while found.hasNext():
            stage = found.next()
            out[stage.stageId()] = stage.shuffleWriteRecords()
        return out

    before = stages()
    action()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.fixture(scope="module")
def crowd(spark):
    """A dense ball, copies of one of its points and a few far points; pid, x, y, z, normal."""
    rng = np.random.default_rng(7)
    at = rng.normal(0, 0.02, (N, 3))
    at[N - 40 : N - 20] = at[0]
    at[N - 20 :] = rng.uniform(-1, 1, (20, 3))
    normal = rng.normal(0, 1, (N, 3))
    normal /= np.linalg.norm(normal, axis=1)[:, None]
    rows = [(i, *map(float, at[i]), *map(float, normal[i])) for i in range(N)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, nx double, ny double, nz double").cache()
    return df, at, normal


def distances(at):
    gap = at[:, None, :] - at[None, :, :]
    return np.sqrt(gap[..., 0] ** 2 + gap[..., 1] ** 2 + gap[..., 2] ** 2)


@pytest.mark.parametrize("most", [4, 64, 5000])
def test_counts_and_pairs_in_boxes_of_any_size(spark, crowd, most, monkeypatch):
    df, at, _ = crowd
    monkeypatch.setattr(balls.dealt, "__defaults__", (most,))
    within = distances(at) <= 0.03
    assert {r["pid"]: r["n"] for r in balls.counts(df, 0.03).collect()} == dict(enumerate(within.sum(axis=1)))
    other = df.select(F.col("pid").alias("j"), *[F.col(c).alias(f"p{c}") for c in XYZ])
    got = balls.dealt(df.select(F.col("pid").alias("i"), *XYZ), 0.03).pairs(other).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted(zip(*map(lambda v: v.tolist(), np.nonzero(within)), strict=True))


def test_responsibilities_exchange_no_pair(spark, crowd):
    df, at, _ = crowd
    mu = df.withColumn("mu", F.pmod("pid", F.lit(10)) / 10.0)
    rows = []
    step = lambda: rows.extend(metrics.expectation_step(mu.withColumnRenamed("pid", "i"), mu.withColumnRenamed("pid", "j"), 0.2, 0.08, 3.0, 0.01).collect())
    assert exchanged(spark, step) < 100 * N
    d, m = distances(at), np.arange(N) % 10 / 10
    w = np.where(d <= 0.2, np.exp(-3.0 * abs(m[:, None] - m[None, :])) * np.exp(-d * d / (2 * 0.08**2)), 0)
    want = w / (w.sum(axis=0)[None, :] + 0.01)
    assert len(rows) == (d <= 0.2).sum() > 400 * N
    assert all(math.isclose(r["r"], want[r["i"], r["j"]], rel_tol=1e-9) for r in rows)


def test_junctions_move_to_medians_without_exchanged_pairs(spark, crowd):
    df, at, _ = crowd
    rows = []
    assert exchanged(spark, lambda: rows.extend(metrics.junction_medians(df, df.select(F.col("pid").alias("vid")), df, 0.1).collect())) < 100 * N
    d = distances(at)
    for r in rows:
        assert np.allclose([r["x"], r["y"], r["z"]], np.median(at[d[r["pid"]] <= 0.1], axis=0), atol=1e-15) and r["n"] == (d[r["pid"]] <= 0.1).sum()
    assert len(rows) == N


def test_gated_means_without_exchanged_pairs(spark, crowd):
    df, at, normal = crowd
    rows = []
    assert exchanged(spark, lambda: rows.extend(skeletons.gated_means(df, df.select(F.col("pid").alias("vid")), df, 0.1, 60.3).collect())) < 100 * N
    d = distances(at)
    for r in rows:
        near = d[r["pid"]] <= 0.1
        m = normal[near].mean(axis=0)
        ok = normal[near] @ m > math.cos(math.radians(60.3)) * np.linalg.norm(m)
        assert np.allclose([r["x"], r["y"], r["z"]], at[near][ok if ok.any() else slice(None)].mean(axis=0), atol=1e-12)
    assert len(rows) == N


def test_nearest_within_reach_exchange_few_pairs(spark, crowd):
    df, at, _ = crowd
    rows = []
    assert exchanged(spark, lambda: rows.extend(spatial.hybrid_neighbours(df, 0.15, 6).collect())) < 200 * N
    d = distances(at)
    want = []
    for i in range(N):
        order = [j for j in np.lexsort((np.arange(N), d[i])) if j != i and d[i, j] <= 0.15][:6]
        want += [(i, int(j), k + 1) for k, j in enumerate(order)]
    assert sorted((r["i"], r["j"], r["rank"]) for r in rows) == sorted(want)


def test_feature_histograms_exchange_no_pair(spark, crowd):
    df, at, normal = crowd
    rows = []
    assert exchanged(spark, lambda: rows.extend(registration.feature_histograms(df, 0.15).collect())) < 100 * N
    d = distances(at)
    near = (d <= 0.15) & (d > 0)
    share = np.zeros((N, 33))
    for i in np.nonzero(near.any(axis=1))[0]:
        for j in np.nonzero(near[i])[0]:
            u, n, line = normal[i], normal[j], (at[j] - at[i]) / d[i, j]
            v = np.cross(line, u)
            v /= max(np.linalg.norm(v), 1e-12)
            w = np.cross(u, v)
            for k, x in enumerate((v @ n, u @ line, math.atan2(w @ n, u @ n) / math.pi)):
                share[i, int(min(max(math.floor((x + 1) / 2 * 11), 0), 10)) + 11 * k] += 1
        share[i] *= 100 / near[i].sum()
    got = {r["pid"]: np.array(r["fpfh"]) for r in rows}
    assert set(got) == set(np.nonzero(near.any(axis=1))[0])
    for i, f in got.items():
        j = np.nonzero(near[i])[0]
        assert np.allclose(f, share[i] + (1 / d[i, j]) @ share[j] / len(j), rtol=1e-9)
