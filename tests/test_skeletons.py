"""Chains, skeletons and meshes on known shapes."""

from __future__ import annotations

import inspect
import math

import pytest
from pyspark.sql import functions as F

from geoquilt.operators import graphs, meshes, skeletons, spatial
from geoquilt.plans.queries import QUERIES
from geoquilt.sources import views
from geoquilt.storage import stored
from tests.test_balls import exchanged

SF = "/root/testdata/sf0.001"
POINT = "pid long, x double, y double, z double"


@pytest.fixture(scope="module")
def tee(spark):
    rows = [(0, 0.0, 0.0, 0.0)] + [(1 + 4 * a + k, dx * (k + 1.0), dy * (k + 1.0), 0.0) for a, (dx, dy) in enumerate([(1, 0), (-1, 0), (0, 1)]) for k in range(4)]
    nodes = spark.createDataFrame(rows, POINT)
    return nodes, spatial.radius_pairs(nodes, 1.0)


def test_chains_of_a_tee_and_a_ring(spark, tee):
    got = {}
    for r in skeletons.chains(tee[1]).collect():
        got.setdefault((r.start, r.end), []).append((r.seq, r.vid))
    lines = sorted([v for _, v in sorted(c)] for c in got.values())
    flat = [x if x[0] == 0 else x[::-1] for x in lines]
    assert sorted(flat) == [[0, 1, 2, 3, 4], [0, 5, 6, 7, 8], [0, 9, 10, 11, 12]]
    assert sorted(map(tuple, skeletons.chain_graph(skeletons.chains(tee[1])).collect())) == [(0, 4), (0, 8), (0, 12)]
    ring = spark.createDataFrame([(i, (i + 1) % 12, 1.0) for i in range(12)], "u long, v long, w double")
    assert skeletons.chains(ring).count() == 0
    assert skeletons.chains(ring.limit(0)).count() == 0


def test_chains_of_near_points_exchange_no_pair(spark, tee):
    """A crowd, whose pairs are chains of their own, beside the tee."""
    crowd = [(100 + k, 50.0 + 0.01 * (k % 8), 0.01 * (k // 8), 0.0) for k in range(240)]
    points = stored(tee[0].unionByName(spark.createDataFrame(crowd, POINT)), "crowd").unionByName(tee[0])
    pairs = spatial.radius_pairs(points, 1.0).distinct()
    want = sorted(map(tuple, skeletons.chains(pairs).collect()))
    got = []
    count = exchanged(spark, lambda: got.extend(map(tuple, skeletons.near_chains(points, 1.0).collect())))
    assert sorted(got) == want and len(want) == 240 * 239 + 15
    assert count < 240 * 239 / 2
    assert skeletons.near_chains(points.limit(0), 1.0).count() == 0


def test_landmarks_and_tree(tee):
    found = skeletons.farthest_landmarks(tee[1], 4, 3)
    assert found == [4, 8, 12]
    assert skeletons.landmark_tree(tee[1], found).count() == 12


def test_skeletons_lie_inside_a_cylinder(spark):
    points = meshes.two_cylinders(spark, 240, 0, 0.0)
    assert points.where(F.abs(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) - 1.5) > 1e-6).count() == 0
    nodes, edges = skeletons.fit_skeleton(points, 1.6, rounds=1)
    assert nodes.count() > 2 and edges.count() > 0
    row = skeletons.report(nodes, edges, points).first()
    assert 0 <= row.bounded_mean <= 1 and 0 <= row.centered_mean <= 1 and row.total_length > 0
    thin, forest = skeletons.contraction_skeleton(points, 1, 1.6)
    assert forest.count() == thin.count() - graphs.label_components(thin.select(F.col("pid").alias("vid")), forest).select("component").distinct().count()


def test_gated_junctions_drop_foreign_normals(spark, tee):
    rows = [(100, 0.1, 0.0, 0.0, 0.0, 0.0, 1.0), (101, -0.1, 0.2, 0.0, 0.0, 0.0, 1.0), (102, 0.0, 0.4, 0.0, 0.6, 0.0, 0.8)]
    points = spark.createDataFrame(rows, POINT + ", nx double, ny double, nz double")
    got = skeletons.gated_junctions(*tee, points, 0.5, 20.0).first()
    assert (got.pid, got.y) == (0, pytest.approx(0.1))


def test_meshes(spark):
    vertices, triangles = views.height_mesh(spark, SF)
    first = triangles.where("tid < 2000")
    sample = meshes.sample_surface(vertices, first, 500)
    assert abs(sample.count() - 500) < 60
    assert meshes.vertex_normals(vertices, first).where("abs(nx*nx+ny*ny+nz*nz-1) > 1e-9").count() == 0
    few = spark.createDataFrame([(0, 0.05, 0.05, 0.005)], POINT)
    near = meshes.prune_by_distance(vertices, first, few, 0.03)
    assert 0 < near.count() < first.count()
    assert meshes.crop_to_cloud(vertices, first, vertices.select(F.col("vid").alias("pid"), "x", "y", "z")).count() == first.count()


def test_planes_one_after_another(spark):
    rows = [(i, (i % 10) / 10, (i // 10) / 10, 0.0) for i in range(100)] + [(100 + i, (i % 8) / 10, 0.35, 0.1 + (i // 8) / 10) for i in range(64)]
    found = meshes.planes(spark.createDataFrame(rows, POINT), 1e-6, 3)
    assert [p[4] for p in found] == [100, 64] and abs(abs(found[1][1]) - 1) < 1e-9


def test_morphology_and_pruning(spark):
    cells = spark.createDataFrame([(r, c) for r in range(6) for c in range(6) if (r, c) != (3, 3)] + [(20, 20)], "row long, col long")
    scores = {(r.closing, r.opening): r for r in meshes.tuned_morphology(cells).collect()}
    assert scores[1, 1].parts == 1 and scores[1, 1].score < scores[1, 0].score
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 0.5, 0.5, 0.5), (2, 0, 0.0, 0.0, 0.0), (2, 1, 9.0, 9.0, 9.0)], "line_id long, seq long, x double, y double, z double")
    box = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 1.0, 1.0)], POINT)
    assert {r.line_id for r in meshes.prune_polylines(lines, box).collect()} == {1}
    assert math.isfinite(meshes.two_cylinders(spark).agg(F.sum("x")).first()[0])


def test_report_query_fits_all_rounds(spark, monkeypatch):
    rounds = []
    fit = inspect.signature(skeletons.fit_skeleton)
    monkeypatch.setattr(skeletons, "fit_skeleton", lambda *a, **b: (bound := fit.bind(*a, **b), bound.apply_defaults(), rounds.append(bound.arguments["rounds"]), (None, None))[-1])
    monkeypatch.setattr(skeletons, "report", lambda *a: None)
    QUERIES["skeleton_report"](spark, "/root/testdata/sf0.001")
    assert rounds == [3]


def test_every_edge_lies_on_one_polyline_and_rings_are_cut(spark):
    ring = [(10 + k, 10 + (k + 1) % 7) for k in range(7)]
    edges = [*ring, (1, 2), (2, 3), (3, 4), (3, 5), (5, 6), (30, 31), (31, 32), (32, 33), (33, 31), (40, 41), (41, 42), (42, 40)]
    frame = spark.createDataFrame(edges, "u long, v long")
    lines = {}
    for r in skeletons.traced(frame).collect():
        lines.setdefault((r.start, r.end), []).append((r.seq, r.vid))
    ways = [[v for _, v in sorted(x)] for x in lines.values()]
    walked = sorted(tuple(sorted(e)) for w in ways for e in zip(w, w[1:]))
    assert walked == sorted(tuple(sorted(e)) for e in edges)
    closed = sorted(w[0] for w in ways if w[0] == w[-1])
    assert closed == [10, 31, 40] and len(ways) == 7
    assert sorted(map(tuple, skeletons.loops(frame).collect())) == [(10, 7), (40, 3)]
    kept = skeletons.traced(frame, 3).select("start", "end").distinct().count()
    assert kept == 7 - 2  # the arms 3-4 and 30-31 are short and end at a tip
    assert skeletons.traced(frame.where("false")).count() == 0


def test_a_raster_ring_is_traced(spark):
    art = ["..####....", ".#....#...", ".#....####", ".#....#...", "..####....", "..........", "##........"]
    cells = [(i, j) for i, line in enumerate(art) for j, c in enumerate(line) if c == "#"]
    got = skeletons.trace_pixels(spark.createDataFrame(cells, "row long, col long")).collect()
    assert {(r.row, r.col) for r in got} == set(cells)
    lines = {}
    for r in got:
        lines.setdefault((r.start, r.end), []).append((r.seq, (r.row, r.col)))
    ways = [[p for _, p in sorted(x)] for x in lines.values()]
    assert all(max(abs(a - c), abs(b - d)) == 1 for w in ways for (a, b), (c, d) in zip(w, w[1:])) and len(ways) == 3
