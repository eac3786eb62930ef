"""Feature matching and colored registration against brute force and planted motions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from geoquilt.operators import colored, matching, registration, smoothing
from geoquilt.operators.registration import Alignment
from geoquilt.storage import stored
from tests.test_balls import exchanged


def features(spark, x, extra=()):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(len(x) + k, e) for k, e in enumerate(extra)]
    return spark.createDataFrame(rows, "pid long, feature array<double>")


def turned(angle, shift):
    t = np.eye(4)
    t[:2, :2] = [[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]]
    t[:3, 3] = shift
    return t


def test_nearest_features_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(150, 33)), rng.normal(size=(260, 33)) * rng.random((260, 1)) * 3
    b[200:] = b[7]  # many copies
    a[100:] = b[7] + 1e-9 * rng.integers(0, 2, size=(50, 1))
    got = {r.i: (r.j, r.d) for r in matching.nearest_features(features(spark, a, [None]), features(spark, b, [None]), 9, 5, 16).collect()}
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert set(got) == set(range(150))
    assert all(got[i][0] == d[i].argmin() and math.isclose(got[i][1], d[i].min(), abs_tol=1e-9) for i in got)
    both = {(r.i, r.j) for r in matching.mutual_matches(features(spark, a), features(spark, b), pivots=300, rings=3).collect()}
    assert both == {(i, j) for i in range(150) for j in [d[i].argmin()] if d[:, j].argmin() == i}
    assert matching.nearest_features(features(spark, a), features(spark, [])).count() == 0
    assert matching.nearest_features(features(spark, []), features(spark, b)).count() == 0


def test_registration_without_matches(spark):
    rng = np.random.default_rng(2)
    x = rng.random((300, 3)) * 2
    x[:, 2] = 0.5 * np.sin(3 * x[:, 0]) * np.cos(2 * x[:, 1]) + 0.2 * x[:, 0] ** 2
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    target = smoothing.estimate_normals(spark.createDataFrame(rows, "pid long, x double, y double, z double"), 12)
    t = turned(0.7, (0.5, -0.3, 0.2))
    source = registration.transformed(target.select("pid", "x", "y", "z", "nx", "ny", "nz"), t)
    found = matching.register(source, target, 0.45, 1.0, 24)
    assert np.abs(found @ t - np.eye(4)).max() < 0.02
    few = source.limit(2)
    assert np.array_equal(matching.register(few, few, 1e-6, 1.0), np.eye(4))


def test_triples_drop_false_matches(spark):
    rng = np.random.default_rng(3)
    p = rng.random((120, 3))
    q = p + (1.0, 2.0, 3.0)
    q[100:] = rng.random((20, 3)) * 20
    rows = [(i, i, *map(float, p[i]), *map(float, q[i])) for i in range(120)]
    names = "i long, j long, px double, py double, pz double, qx double, qy double, qz double"
    kept = {r.i for r in matching.alike_triples(spark.createDataFrame(rows, names)).collect()}
    assert set(range(100)) <= kept and len(kept & set(range(100, 120))) <= 2
    assert matching.alike_triples(spark.createDataFrame(rows[:2], names)).count() == 0


def plane(spark, shift=0.0):
    g = np.stack(np.meshgrid(np.arange(16), np.arange(16)), -1).reshape(-1, 2) * 0.1
    rows = [(i, float(x), float(y), 0.0, 0.0, 0.0, 1.0, 0.5 + 0.2 * math.sin(2.0 * (x + shift)) + 0.2 * math.cos(1.7 * y)) for i, (x, y) in enumerate(g)]
    return spark.createDataFrame(rows, "pid long, x double, y double, z double, nx double, ny double, nz double, shade double")


def test_color_gradient_of_a_plane(spark):
    rows = [(i, x, y, 0.3 * x, -0.3 / math.hypot(1, 0.3), 0.0, 1 / math.hypot(1, 0.3), 2.0 * x - y) for i, (x, y) in enumerate(np.random.default_rng(4).random((60, 2)).tolist())]
    far = (99, 50.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0)
    p = spark.createDataFrame([*rows, far], plane(spark).schema)
    got = {r.pid: np.array([r.gx, r.gy, r.gz]) for r in colored.color_gradients(p, 0.4).collect()}
    assert not got[99].any() and len(got) == 61
    n = np.array(rows[0][4:7])
    assert all(abs(g @ n) < 1e-9 for k, g in got.items() if k != 99)
    assert all(np.allclose(g @ [1, 0, 0.3], 2, atol=1e-5) and np.allclose(g[1], -1, atol=1e-5) for k, g in got.items() if k != 99)


def test_textured_plane_slides_into_place(spark):
    target, shift = plane(spark), 0.04
    source = plane(spark, shift).select("pid", "x", "y", "z", "shade")  # the same texture, seen from a moved grid
    start = registration.icp_point_to_plane(source, target, 0.2, 0.2, 3)
    assert abs(start.transform[0, 3]) < 1e-3  # planes alone do not see it
    got = colored.colored_levels(source, target, start, (0.2, 0.15), (12, 12))
    assert abs(got.transform[0, 3] - shift) < 0.01 and abs(got.transform[1, 3]) < 0.01 and got.fitness > 0.9


def test_gates_of_colored_levels(spark):
    target = plane(spark)
    source = target.select("pid", "x", "y", "z", "shade")
    weak = Alignment(turned(0.1, (9.0, 0.0, 0.0)), 0.19, 1.0)
    assert colored.colored_levels(source, target, weak, (0.2,), (5,)) is weak
    lost = colored.colored_levels(source, target, Alignment(turned(0.0, (9.0, 0.0, 0.0)), 0.5, 1.0), (0.2, 0.1), (2, 2))
    assert lost.fitness == 0.0
    # a start below the second gate looks twice as far: 0.08 off the plane is out of reach of 0.05 only
    off = turned(0.0, (0.0, 0.0, 0.08))
    assert colored.colored_levels(source, target, Alignment(off, 0.4, 1.0), (0.05,), (3,)).fitness == 0.0
    assert colored.colored_levels(source, target, Alignment(off, 0.25, 1.0), (0.05,), (3,)).fitness == 1.0


def test_copies_sent_follow_blocks_and_not_rings(spark):
    """In many dimensions no ring is ruled out: probes are sent to as many groups as there are blocks."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(300, 48)), rng.normal(size=(600, 48))
    b[1] = b[0] + 1e-8  # nearer to each other than products can tell
    a[0] = b[0] + 6e-9
    frames = [stored(features(spark, x), "features") for x in (a, b)]
    got = {}
    count = exchanged(spark, lambda: got.update({r.i: r.j for r in matching.nearest_features(*frames, pivots=4, rings=64).collect()}))
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert got == dict(enumerate(d.argmin(1).tolist()))
    assert count < 300 * 4 + 12 * 900


def test_nearest_by_products_holds_little(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(40, 8)) + 1e4
    b = np.concatenate([a[:20] + 1e-7, a[:20], a[:20], rng.normal(size=(30, 8)) + 1e4])
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    best, at = matching._nearest(a, b)
    assert (at == d.argmin(1)).all() and np.allclose(best, d.min(1), atol=1e-12)
    promised = matching._promising(F.col("away"), F.col("reach"), np.array([0, 1]), np.array([0.0, 2.0]), np.array([1.0, 3.0]))
    frame = spark.createDataFrame([([0.5, 9.0], 0.1), ([1.5, 2.5], 0.1), ([9.0, 9.0], 0.1)], "away array<double>, reach double")
    assert [list(r[0]) for r in frame.select(promised).collect()] == [[0], [1], []]


def test_the_way_back_asks_only_those_that_were_met(spark, monkeypatch):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(5, 4)), rng.normal(size=(60, 4))
    asked, whole = [], matching.nearest_features
    monkeypatch.setattr(matching, "nearest_features", lambda p, q, **k: (asked.append(p.count()), whole(p, q, **k))[1])
    both = {(r.i, r.j) for r in matching.mutual_matches(features(spark, a), features(spark, b), pivots=4, rings=2).collect()}
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert both == {(i, j) for i in range(5) for j in [d[i].argmin()] if d[:, j].argmin() == i}
    assert asked == [5, len(set(d.argmin(1)))]
