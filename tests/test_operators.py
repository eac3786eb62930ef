"""Operators on shapes small enough to know the answer."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquilt.operators import cameras, clouds, graphs, metrics, raster, registration, search, shapes, smoothing, spatial

POINT = "pid long, x double, y double, z double"
EDGE = "u long, v long, w double"


def frame(spark, rows, schema=POINT):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


@pytest.fixture(scope="module")
def cube(spark):
    return frame(spark, [(i, *map(float, c)) for i, c in enumerate(itertools.product((0, 1), repeat=3))])


@pytest.fixture(scope="module")
def line(spark):
    return frame(spark, [(i, float(i), 0.0, 0.0) for i in range(10)])


@pytest.fixture(scope="module")
def blobs(spark):
    lattice = list(itertools.product(range(3), repeat=3))
    rows = [(i, *map(float, p)) for i, p in enumerate(lattice)] + [(27 + i, p[0] + 10.0, float(p[1]), float(p[2])) for i, p in enumerate(lattice)]
    return frame(spark, [*rows, (54, 100.0, 0.0, 0.0)])


def test_crop_keeps_the_faces(cube):
    assert clouds.crop(cube, (0, 0, 0), (1, 1, 0)).count() == 4


def test_voxels_and_stats(cube):
    assert clouds.voxel_downsample(cube, 2.0).first().asDict() == {"ix": 0, "iy": 0, "iz": 0, "n": 8, "x": 0.5, "y": 0.5, "z": 0.5}
    assert clouds.voxelize(cube, 1.0).count() == 8
    row = clouds.pca_spectrum(cube).first()
    assert [round(row[k], 9) for k in ("l1", "l2", "l3")] == [round(2 / 7, 9)] * 3


def test_knn_breaks_ties_by_id_and_takes_k_beyond_n(cube, line):
    got = {(r.i, r.rank): r.j for r in spatial.knn_self(cube, 3).collect()}
    assert [got[0, k] for k in (1, 2, 3)] == [1, 2, 4]
    assert spatial.knn_self(line, 50).count() == 90


def test_knn_equals_brute_force_whatever_the_partitions(spark):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=(60, 3)), rng.normal(size=(5, 3)) * 0.01 + 7]
    p = frame(spark, [(i, *map(float, r)) for i, r in enumerate(x)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    expect = {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i])[:4]}
    for q in (p, p.repartition(7), p.orderBy(F.desc("pid"))):
        assert {(r.i, r.j) for r in spatial.knn_self(q, 4).collect()} == expect


def test_empty_and_tiny_clouds(spark):
    none, two = frame(spark, []), frame(spark, [(0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0)])
    assert spatial.knn_self(none, 3).count() == 0
    assert clouds.statistical_outliers(none).count() == 0
    assert [(r.i, r.j, r.d) for r in spatial.knn_self(two, 3).orderBy("i").collect()] == [(0, 1, 0.0), (1, 0, 0.0)]
    assert {r.variation for r in clouds.surface_variation(two, 1.0).collect()} == {0.0}


def test_outliers_and_radii(blobs, line):
    assert 54 not in {r.pid for r in clouds.statistical_outliers(blobs, 5, 2.0).collect()}
    assert clouds.radius_outliers(blobs, 1.1, 3).count() == 54
    assert {r.radius for r in clouds.local_radii(line, 2).where("pid BETWEEN 1 AND 8").collect()} == {1.0}


def test_text_round_trip(spark):
    p = frame(spark, [(0, 0.12345, -0.5, 0.0, 0.0, 0.6, 0.8, 1.0, 0.0, None)], POINT + ", nx double, ny double, nz double, r double, g double, b double")
    lines = clouds.encode_text(p)
    assert lines.first().value == "0.123500 -0.500000 0.000000 0.000 0.600 0.800 255 0 200"
    assert clouds.decode_text(lines).first().x == 0.1235
    with pytest.raises(Exception, match="not nine fields"):
        clouds.decode_text(spark.createDataFrame([(0, "1 2 3")], "pid long, value string")).collect()


def test_components_of_blobs(blobs):
    edges = spatial.radius_pairs(blobs, 1.0)
    parts = graphs.label_components(blobs.select(F.col("pid").alias("vid")), edges)
    assert {r.component for r in parts.collect()} == {0, 27, 54}
    assert graphs.largest_component(blobs.select(F.col("pid").alias("vid")), edges).select("component").distinct().first()[0] == 0
    found = {r.pid: r.cluster for r in graphs.dbscan(blobs, 1.0, 4).collect()}
    assert (found[0], found[30], found[54]) == (0, 27, -1)


def test_paths_and_forests(spark, line):
    edges = spatial.radius_pairs(line, 1.0)
    mst = graphs.minimum_spanning_forest(spatial.radius_pairs(line, 3.0))
    assert mst.agg(F.sum("w"), F.count("*")).first()[:] == (9.0, 9)
    paths = graphs.shortest_paths(edges, 0)
    assert {r.vid: r.dist for r in paths.collect()} == {i: float(i) for i in range(10)}
    way = graphs.backtrack(paths, frame(spark, [(9,)], "vid long"))
    assert [r.vid for r in way.orderBy("step").collect()] == list(range(9, -1, -1))
    ring = frame(spark, [(i, (i + 1) % 12, 1.0) for i in range(12)], EDGE)
    assert graphs.shortest_paths(ring, 0).agg(F.max("dist")).first()[0] == 6.0
    assert graphs.minimum_spanning_forest(frame(spark, [], EDGE)).count() == 0


def test_forest_equals_kruskal(spark):
    rng = np.random.default_rng(3)
    rows = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 40, (120, 2)).tolist() if a != b})
    edges = [(u, v, float(w)) for (u, v), w in zip(rows, rng.integers(1, 9, len(rows)), strict=True)]
    root = list(range(40))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    expect = set()
    for w, u, v in sorted((w, u, v) for u, v, w in edges):
        if find(u) != find(v):
            root[find(u)] = find(v)
            expect.add((u, v))
    got = {(r.u, r.v) for r in graphs.minimum_spanning_forest(frame(spark, edges, EDGE)).collect()}
    assert got == expect


def test_greedy_clusters_equal_the_sequence(spark):
    rng = np.random.default_rng(5)
    x = rng.random((80, 3))
    p = frame(spark, [(i, *map(float, r)) for i, r in enumerate(x)])
    centers, expect = [], {}
    for i, q in enumerate(x):
        near = [c for c in centers if np.linalg.norm(x[c] - q) <= 0.25]
        expect[i] = near[0] if near else i
        centers += [] if near else [i]
    assert {r.pid: r.center for r in graphs.greedy_cluster(p, 0.25).collect()} == expect


def test_adaptive_graph_skips_the_same_direction(line):
    got = {(r.u, r.v) for r in graphs.adaptive_graph(line, 4, 5.0, math.cos(math.radians(70))).collect()}
    assert got == {(i, i + 1) for i in range(9)}


def test_adaptive_graph_equals_a_loop(spark):
    rng = np.random.default_rng(8)
    x = rng.random((50, 3))
    p = frame(spark, [(i, *map(float, r)) for i, r in enumerate(x)])
    expect, cos = set(), math.cos(math.radians(60))
    for i in range(50):
        d = np.linalg.norm(x - x[i], axis=1)
        d[i] = np.inf
        order, taken = np.argsort(d)[:8], []
        for j in order:
            u = (x[j] - x[i]) / d[j]
            if d[j] <= 2.0 * d[order[0]] and all(u @ t <= cos for t in taken):
                taken.append(u)
                expect.add((min(i, int(j)), max(i, int(j))))
    assert {(r.u, r.v) for r in graphs.adaptive_graph(p, 8, 2.0, cos).collect()} == expect


def test_smoothness_of_a_tee(spark):
    rows = [(0, 0.0, 0.0, 0.0)] + [(1 + 3 * a + k, dx * (k + 1.0), dy * (k + 1.0), 0.0) for a, (dx, dy) in enumerate([(1, 0), (-1, 0), (0, 1)]) for k in range(3)]
    nodes = frame(spark, rows)
    edges = spatial.radius_pairs(nodes, 1.0)
    deg = {r.vid: r.degree for r in graphs.degrees(edges).collect()}
    assert deg[0] == 3 and sorted(deg.values()).count(1) == 3
    assert {r.smooth for r in metrics.smoothness(nodes, edges).collect()} == {1.0}
    moved = metrics.refine_junctions(nodes, edges, nodes, 1.0).collect()
    assert [(r.pid, r.n) for r in moved] == [(0, 4)]


def cells(spark, rows):
    return spark.createDataFrame(rows, "row long, col long")


def test_morphology_and_thinning(spark):
    plus = cells(spark, [(r, c) for r in range(9) for c in range(9) if 3 <= r <= 5 or 3 <= c <= 5])
    assert raster.erode(raster.dilate(cells(spark, [(4, 4)]))).collect() == [(4, 4)]
    assert raster.opening(plus).count() == plus.count()
    thin = {tuple(r) for r in raster.thin(plus).collect()}
    assert 0 < len(thin) < plus.count() / 2
    nodes = graphs.label_components(
        spark.createDataFrame([(r * 100 + c,) for r, c in thin], "vid long"),
        spark.createDataFrame([(a * 100 + b, c * 100 + d) for a, b in thin for c, d in thin if max(abs(a - c), abs(b - d)) == 1], "u long, v long"),
    )
    assert nodes.select("component").distinct().count() == 1
    assert raster.thin(cells(spark, [])).count() == 0


def test_blur_keeps_a_constant(spark):
    flat = spark.createDataFrame([(r, c, 2.0) for r in range(4) for c in range(5)], "row long, col long, v double")
    got = raster.gaussian_blur(flat, 1.0, 4, 5).collect()
    assert len(got) == 20 and all(abs(r.v - 2) < 1e-12 for r in got)


def test_blur_keeps_frames_apart(spark):
    frames = spark.createDataFrame([(f, i, j, float(f)) for f in range(3) for i in range(4) for j in range(5)], "frame long, row long, col long, v double")
    got = raster.gaussian_blur(frames, 1.0, 4, 5, by=("frame",)).collect()
    assert len(got) == 60 and all(abs(r.v - r.frame) < 1e-12 for r in got)


def test_depth_guards(spark):
    d = spark.createDataFrame([(0, 0, 0, float("nan")), (0, 0, 1, None), (0, 0, 2, 1500.0)], "frame long, row long, col long, raw double")
    metres = cameras.to_metres(d)
    assert sorted(r.d for r in metres.collect()) == [0.0, 0.0, 1.5]
    assert cameras.back_project(metres, 1, 1, 0, 0).count() == 1


def test_volume_crosses_at_the_surface(spark):
    d = spark.createDataFrame([(0, r, c, 1.0) for r in range(5) for c in range(5)], "frame long, row long, col long, d double")
    volume = cameras.fuse_volume(d, 10, 10, 2, 2, 0.1, 0.3)
    crossing = cameras.surface_crossings(volume, 0.1).select("z").collect()
    assert crossing and all(abs(r.z - 1.0) < 0.11 for r in crossing)


def test_planes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *rng.random(2).tolist(), 0.0) for i in range(100)] + [(100 + i, *rng.random(2).tolist(), 1.0 + i) for i in range(5)]
    p = frame(spark, rows)
    best = shapes.ransac_planes(p, 16, 1e-6).orderBy(F.desc("inliers"), "trial").first()
    assert best.inliers == 100 and abs(abs(best.c) - 1) < 1e-9


def test_resample_and_lines(spark, line):
    poly = line.select(F.lit(1).alias("line_id"), F.col("pid").alias("seq"), "x", "y", "z")
    got = [r.x for r in shapes.resample(poly, 2.0).orderBy("k").collect()]
    assert got == [0.0, 2.0, 4.0, 6.0, 8.0]
    assert [r.x for r in shapes.resample(poly, 1.2).orderBy("k").collect()][-1] == pytest.approx(8.4)
    fit = smoothing.fit_lines(poly).first()
    assert fit.linearity == pytest.approx(0) and fit.length == pytest.approx(9)
    assert smoothing.straighten(poly, 0.08, 0.08, 1.0).count() == 10
    assert shapes.line_angle_groups(poly, (1.0, 0.0, 0.0)).first().bin == 0


def test_skeleton_json(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 1.0, 0.0, 0.0), (1, 3, 0.0, 0.0, 0.0)]
    model = shapes.skeleton_json(spark.createDataFrame(rows, "line_id long, seq long, x double, y double, z double")).first().model
    assert model == '{"points":[[0.0,0.0,0.0],[1.0,0.0,0.0]],"lines":[[0,1],[1,0]]}'


def test_normals_and_contraction(spark):
    sphere = np.random.default_rng(4).normal(size=(150, 3))
    sphere /= np.linalg.norm(sphere, axis=1)[:, None]
    p = frame(spark, [(i, *map(float, r)) for i, r in enumerate(sphere)])
    out = smoothing.estimate_normals(p, 10).collect()
    assert np.mean([r.x * r.nx + r.y * r.ny + r.z * r.nz for r in out]) > 0.9
    moved = smoothing.contract(p, 2, 10).where("step = 2").collect()
    assert np.mean([r.x**2 + r.y**2 + r.z**2 for r in moved]) < 1
    assert smoothing.laplacian_blend(p, 8).count() == 150 and smoothing.mls_step(p, 0.5).count() == 150


def test_icp_finds_a_small_motion(spark):
    rng = np.random.default_rng(6)
    x = rng.random((200, 3)) * 2
    x[:, 2] = 0.3 * np.sin(2 * x[:, 0]) + 0.2 * np.cos(3 * x[:, 1])
    target = smoothing.estimate_normals(frame(spark, [(i, *map(float, r)) for i, r in enumerate(x)]), 8)
    t = np.eye(4)
    t[:3, :3] = [[math.cos(0.03), -math.sin(0.03), 0], [math.sin(0.03), math.cos(0.03), 0], [0, 0, 1]]
    t[:3, 3] = (0.02, -0.01, 0.015)
    source = registration.transformed(target.select("pid", "x", "y", "z"), t)
    found = registration.icp_point_to_plane(source, target, 0.3, 0.3, 15)
    assert found.fitness > 0.95 and np.abs(found.transform @ t - np.eye(4)).max() < 0.02
    pairs = target.join(source.toDF("p2", "px", "py", "pz"), F.col("pid") == F.col("p2")).select("px", "py", "pz", *[F.col(c).alias(f"q{c}") for c in "xyz"])
    assert np.abs(registration.global_registration(pairs, 0.5, 12) @ t - np.eye(4)).max() < 1e-3
    features = registration.feature_histograms(target, 0.4).first().fpfh
    assert len(features) == 33 and sum(features) > 0


def test_search(spark):
    grid = search.parameter_grid(spark, {"a": [1.0, 2.0], "b": [10.0, 20.0, 30.0]})
    assert [tuple(r) for r in grid.orderBy("combo").collect()] == list(enumerate_grid())
    assert spark.range(1).select(search.decode(F.lit(0.5), 0.0, 5.0, True)).first()[0] == 2.0


def enumerate_grid():
    for k, (a, b) in enumerate(itertools.product((1.0, 2.0), (10.0, 20.0, 30.0))):
        yield k, a, b


def test_numbers_are_dense_and_ordered(spark):
    from geoquilt.operators.numbering import numbered

    df = spark.createDataFrame([(int(x),) for x in np.random.default_rng(0).permutation(200)], "v long")
    assert [r.n for r in numbered(df, "v", "n", 20).orderBy("v").collect()] == list(range(200))
    assert numbered(df.limit(0), "v", "n").count() == 0


def test_projections_and_colors(spark, cube, line):
    ball = frame(spark, [(i, math.cos(t), math.sin(t), 0.1) for i, t in enumerate(np.linspace(-3, 3, 40))])
    flat = shapes.sinusoidal(ball).collect()
    assert len(flat) == 40 and all(abs(r.u) <= math.pi for r in flat)
    assert shapes.hybrid_projection(ball).count() == 40
    assert shapes.slab(line, (2.0, 0.0, 0.0), (1.0, 0.0, 0.0), 1.0).count() == 3
    gray = {r.pid: r.r for r in clouds.gray_by_height(cube).collect()}
    assert (gray[0], gray[1]) == (0.0, 1.0)
    rgb = spark.range(3).select(*clouds.hue(F.col("id"), 3, 1.0)).collect()
    assert [tuple(r) for r in rgb] == [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    assert clouds.kernel_radius(line.limit(4)).first()[:] == (1, 3, 5)
    assert clouds.typical_spacing(line).first().sigma == 1.0


def test_splat_and_threshold(spark):
    dots = spark.createDataFrame([(2.5, 2.5)] * 5 + [(9.5, 2.5)], "u double, v double")
    grid = raster.splat(dots, 1.0, 0.5)
    best = grid.orderBy(F.desc("v")).first()
    assert (best.row, best.col, best.v) == (2, 2, 1.0)
    assert (2, 2) in {tuple(r) for r in raster.thresholded(grid).collect()}


def test_barcode_and_noise(spark, line):
    bars = metrics.barcode(graphs.minimum_spanning_forest(spatial.radius_pairs(line, 1.0)), 0.5)
    got = metrics.barcode_distances(bars, bars).first()
    assert (got.n, got.bottleneck, got.wasserstein) == (9, 0.0, 0.0)
    assert math.isnan(metrics.barcode_distances(bars, bars.limit(0)).first().bottleneck)
    assert metrics.noise_level(line.where("pid < 9"), line).first().epsilon == 1.0


def test_greedy_clusters_settle_all_or_fail(spark):
    chain = frame(spark, [(i, float(i), 0.0, 0.0) for i in range(9)])
    got = {r.pid: r.center for r in graphs.greedy_cluster(chain, 1.1).collect()}
    assert got == {i: i if i % 2 == 0 else i - 1 for i in range(9)}
    with pytest.raises(RuntimeError):
        graphs.greedy_cluster(chain, 1.1, max_rounds=2)


def test_own_radii_and_hybrid_search_equal_brute_force(spark):
    rng = np.random.default_rng(21)
    p = rng.normal(size=(120, 3))
    radii = [None, -1.0, 0.0, float("inf"), float("nan"), *np.exp(rng.normal(-1, 2, 115)).tolist()]
    rows = [(i, *map(float, x), r) for i, (x, r) in enumerate(zip(p, radii, strict=True))]
    frame = spark.createDataFrame(rows, "i long, x double, y double, z double, radius double")
    cloud = frame.select(F.col("i").alias("j"), "x", "y", "z")
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    got = {(r.i, r.j) for r in spatial.radius_join_own(frame, cloud).collect()}
    assert got == {(i, j) for i, r in enumerate(radii) if r is not None and 0 <= r < float("inf") for j in range(120) if d[i, j] <= r}
    got = {(r.i, r.j, r.rank) for r in spatial.hybrid_neighbours(cloud.withColumnRenamed("j", "pid"), 0.8, 3).collect()}
    near = {i: sorted((d[i, j], j) for j in range(120) if j != i and d[i, j] <= 0.8)[:3] for i in range(120)}
    assert got == {(i, j, k + 1) for i, x in near.items() for k, (_, j) in enumerate(x)}


def test_a_far_point_does_not_widen_the_search(spark):
    rng = np.random.default_rng(22)
    p = np.vstack([rng.random((20_000, 3)) * [1, 1, 0.01], [[1e4, 0, 0]]])
    cloud = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "pid long, x double, y double, z double")
    radius = spatial.typical_radius(cloud, 8)
    probe, points = cloud.withColumnRenamed("pid", "i"), cloud.withColumnRenamed("pid", "j")
    assert radius < 0.1 and spatial.radius_join(probe, points, radius).count() < 5_000_000
    assert {r.i for r in spatial.knn(probe.where("i = 20000"), points, 2).collect()} == {20_000}


def test_distances_are_exact_at_any_reach(spark):
    rng = np.random.default_rng(23)
    cells = [(int(r), int(c)) for r, c in rng.integers(0, 90, (150, 2))]
    targets = [(0, 3), (88, 70), (40, 41)]
    frame = lambda x: spark.createDataFrame(x, "row long, col long")
    got = {(r.row, r.col): r.d2 for r in raster.distance_to(frame(cells), frame(targets), 2).collect()}
    assert got == {(r, c): min((r - a) ** 2 + (c - b) ** 2 for a, b in targets) for r, c in cells}
    assert {r.d2 for r in raster.distance_to(frame(cells), frame([])).collect()} == {None}


def test_spacing_quantile_of_a_line_and_of_two_points(spark, line):
    assert clouds.spacing_quantile(line, 1).first()["spacing"] == 1.0
    assert clouds.spacing_quantile(line.limit(2), 1).first()["spacing"] == 1.0
    assert clouds.spacing_quantile(line.limit(0), 1).first()["spacing"] == 1.0
    far = frame(spark, [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 3.0, 0.0, 0.0)])  # distances 1, 1, 2
    assert math.isclose(clouds.spacing_quantile(far, 1, 0.75).first()["spacing"], 1.5)


def test_selected_and_other_rows_make_up_the_cloud(spark, line):
    index = spark.createDataFrame([(3,), (3,), (7,), (99,), (None,)], "pid long")
    ids = lambda df: sorted(r["pid"] for r in df.collect())
    assert ids(clouds.select_rows(line, index)) == [3, 7]
    assert ids(clouds.select_rows(line, index, invert=True)) == [0, 1, 2, 4, 5, 6, 8, 9]


def test_short_edges_leave_the_adjacency(spark, line):
    edges = spark.createDataFrame([(0, 1), (0, 4), (2, 2)], "u long, v long")
    nodes = line.withColumnRenamed("pid", "vid")
    found = {tuple(r) for r in graphs.weighted_adjacency(nodes, edges, 0.5).collect()}
    assert found == {(0, 1, 1.0), (1, 0, 1.0), (0, 4, 4.0), (4, 0, 4.0)}


def test_groups_of_equal_size_rank_by_label(spark):
    parts = spark.createDataFrame([(i, g) for i, g in enumerate([5, 5, 2, 2, 9, 7, 7, 7])], "vid long, component long")
    found = [tuple(r) for r in graphs.largest_groups(parts, "component", 3).orderBy("rank").collect()]
    assert found == [(7, 3, 1), (2, 2, 2), (5, 2, 3)]
    assert graphs.largest_groups(parts.limit(0), "component").count() == 0


def test_contour_links_of_a_square(spark):
    cells = spark.createDataFrame(list(itertools.product(range(3), repeat=2)), "row long, col long")
    found = {tuple(r) for r in raster.contour_links(cells).collect()}
    ring = set(itertools.product(range(3), repeat=2)) - {(1, 1)}
    assert found == {(*a, *b) for a in ring for b in ring if a < b and max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1}


def test_samples_stay_in_their_space(spark):
    space = {"n": (2, 5, True), "x": (-1.0, 1.0, False)}
    rows = search.random_sample(spark.range(2000), "id", space).collect()
    assert {r["n"] for r in rows} == {2, 3, 4, 5} and all(-1 <= r["x"] < 1 for r in rows)
    assert search.random_sample(spark.range(2000), "id", space).collect() == rows


def test_inclusive_clusters_average_all_points_in_reach(spark):
    p = frame(spark, [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 2.0, 0.0, 0.0), (3, 9.0, 0.0, 0.0)])
    got = {r.center: (r.n, r.x) for r in graphs.inclusive_clusters(p, 1.0).collect()}
    assert got == {0: (2, 0.5), 2: (2, 1.5), 3: (1, 9.0)}
    assert graphs.inclusive_clusters(frame(spark, []), 1.0).count() == 0


def test_slab_centeredness_equals_singular_values(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 3)) * (1.0, 2.0, 0.5)
    u = np.array([0.6, 0.0, 0.8])
    g, h = np.array([0.8, 0.0, -0.6]), np.array([0.0, 1.0, 0.0])
    at = [(0.0, 0.0, 0.0), (0.5, 0.3, 0.1), (90.0, 0.0, 0.0)]
    samples = spark.createDataFrame([(i, *map(float, a), *map(float, u)) for i, a in enumerate(at)], "i long, x double, y double, z double, ux double, uy double, uz double")
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "j long, x double, y double, z double")
    got = {r.i: (r.n, r.centered) for r in metrics.slab_centeredness(samples, points, 2.0).collect()}
    for i, a in enumerate(at[:2]):
        o = x[np.linalg.norm(x - a, axis=1) <= 2.0] - a
        y = np.stack([o @ g, o @ h], axis=1)
        sigma = np.linalg.svd(y - y.mean(0), compute_uv=False) / np.sqrt(len(y))
        assert got[i][0] == len(o)
        assert abs(got[i][1] - np.clip(1 - np.linalg.norm(y.mean(0)) / sigma.mean(), 0, 1)) < 1e-9
    assert got[2] == (0, 0.0)


def test_lowest_parabolas_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    for n, m in ((1, 1), (7, 30), (40, 1), (60, 90)):
        feet, at = (np.sort(rng.choice(200, k, replace=False)) - 50 for k in (n, m))
        heights = rng.integers(0, 400, n) * rng.integers(0, 2, n)
        assert (raster.lowest_parabolas(heights, feet, at) == (heights[:, None] + (feet[:, None] - at) ** 2).min(0)).all()
    side = 1200  # a filled square and one far target
    square = spark.range(side * side).select(F.floor(F.col("id") / side).alias("row"), (F.col("id") % side).alias("col"))
    got = raster.distance_to(square, spark.createDataFrame([(0, 0), (3 * side, 5)], "row long, col long")).where("row >= 0")
    wrong = got.where("d2 <> least(row * row + col * col, power(row - 3600, 2) + power(col - 5, 2)) OR d2 IS NULL")
    assert got.count() == side * side and wrong.isEmpty()
    odd = spark.createDataFrame([(None, 1), (2, 2), (2, 2)], "row long, col long")
    assert {tuple(r) for r in raster.distance_to(odd, square.where("row = 0 AND col = 0")).collect()} == {(None, 1, None), (2, 2, 8)}
