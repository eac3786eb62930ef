"""Captures: transforms, pairwise alignment, image files and the whole merge."""

from __future__ import annotations

import io
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquilt.operators import capture
from geoquilt.operators.numbering import indexed
from geoquilt.sources import files, images

rng = np.random.default_rng(0)


def rigid(angles, shift):
    out = np.eye(4)
    for k, a in enumerate(angles):
        c, s = np.cos(a), np.sin(a)
        turn = np.eye(4)
        i, j = ((1, 2), (2, 0), (0, 1))[k]
        turn[i, i], turn[i, j], turn[j, i], turn[j, j] = c, -s, s, c
        out = turn @ out
    out[:3, 3] = shift
    return out


@pytest.mark.parametrize(("n", "block"), [(1, 4), (4, 4), (5, 4), (70, 3), (200, 64)])
def test_prefix_products_equal_the_sequential_product(spark, n, block):
    steps = [rigid(rng.normal(0, 0.3, 3), rng.normal(0, 1, 3)) for _ in range(n)]
    chain = spark.createDataFrame([(i, t[:3].ravel().tolist()) for i, t in enumerate(steps)], "i long, t array<double>").repartition(5)
    got = {r.i: np.reshape(r.t, (3, 4)) for r in capture.prefix_products(chain, block).collect()}
    whole = np.eye(4)
    assert sorted(got) == list(range(n))
    for i, t in enumerate(steps):
        whole = whole @ t
        assert np.allclose(got[i], whole[:3], atol=1e-9)


def test_chained_follows_the_order_of_frames(spark):
    move = lambda x: [1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    frames = spark.createDataFrame([("c",), ("a",), ("b",), ("a",)], "frame string")
    steps = spark.createDataFrame([("a", move(1.0)), ("c", move(5.0))], "frame string, t array<double>")
    got = {r.frame: r.t[3] for r in capture.chained(frames, steps).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 6.0}
    assert capture.chained(frames.where("false"), steps).count() == 0


def test_rows_are_indexed_in_order(spark):
    rows = spark.createDataFrame([(chr(97 + i % 26) * (i % 3), i) for i in range(500)] + [(None, 1000)], "k string, v long").repartition(7)
    got = sorted(indexed(rows, "k", "v", name="n").collect(), key=lambda r: r.n)
    assert [r.n for r in got] == list(range(501))
    assert [(r.k, r.v) for r in got] == sorted(((r.k, r.v) for r in got), key=lambda x: (x[0] is not None, x[0] or "", x[1]))


def bumpy(n, seed=1):
    r = np.random.default_rng(seed)
    xy = r.uniform(-0.2, 0.2, (n, 2))
    z = 0.05 * np.sin(20 * xy[:, 0]) + 0.04 * np.cos(17 * xy[:, 1])
    normal = np.column_stack([-np.cos(20 * xy[:, 0]), 0.68 * np.sin(17 * xy[:, 1]), np.ones(n)])
    return np.column_stack([xy, z]), normal / np.linalg.norm(normal, axis=1)[:, None]


def test_all_pairs_are_aligned_at_once(spark):
    target, normal = bumpy(4000)
    rows, sources, planted = [], [], {}
    for pair in range(3):
        rows += [(pair, *map(float, (*p, *m))) for p, m in zip(target, normal, strict=True)]
        t = rigid(rng.normal(0, 0.02, 3), rng.normal(0, 0.004, 3))
        planted[pair] = t
        own = bumpy(1500, 5 + pair)[0]
        back = np.linalg.inv(t)
        sources += [(pair, i, *map(float, back[:3, :3] @ p + back[:3, 3])) for i, p in enumerate(own)]
    sources += [(9, i, 0.0, 0.0, 0.0) for i in range(10)]
    source = spark.createDataFrame(sources, "pair long, pid long, x double, y double, z double")
    goal = spark.createDataFrame(rows, "pair long, x double, y double, z double, nx double, ny double, nz double")
    got = {r.pair: r for r in capture.align_pairs(source, goal, capture.Refinement(reaches=(0.02,), rounds=10, tolerance=1e-5)).collect()}
    assert set(got) == {0, 1, 2}  # the pair of few points is left out
    for pair, t in planted.items():
        assert np.allclose(np.reshape(got[pair].t, (3, 4)), t[:3], atol=1e-3) and got[pair].fitness > 0.9


def test_the_meaning_of_poses_is_found(spark):
    points = spark.createDataFrame([("a", *map(float, p)) for p in rng.uniform(-0.1, 0.1, (50, 3))], "frame string, x double, y double, z double")
    poses = spark.createDataFrame([("a", 300.0, -200.0, 500.0, 30.0, 60.0, -40.0)], f"frame string, {files.POSE}")
    he = [0, -1, 0, 0.5, 1, 0, 0, 0.1, 0, 0, 1, -0.2]
    true = capture.pose_transforms(poses, "ZYX", 0.001, capture.hand_eye(he, "cam_tcp_inv"))
    base = capture.to_base(points, true)
    box = base.agg(*[f(c) for f in (F.min, F.max) for c in "xyz"]).first()
    got = capture.autotune(points, poses, [v - 1e-9 for v in box[:3]], [v + 1e-9 for v in box[3:]], he).orderBy(F.desc("inliers"), "k").first()
    assert (got.scale, got.axis_order, got.direction, got.inliers) == (0.001, "ZYX", "cam_tcp_inv", 50)
    with pytest.raises(ValueError, match="direction"):
        capture.hand_eye(direction="up")


def png(image, kinds=(0,)):
    """An RGB image with the filters ``kinds`` in turn."""
    h, w, _ = image.shape
    lines, above = [], np.zeros((w, 3), int)
    for y in range(h):
        line, kind = image[y].astype(int), kinds[y % len(kinds)]
        left, corner = np.vstack([np.zeros((1, 3), int), line[:-1]]), np.vstack([np.zeros((1, 3), int), above[:-1]])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0 * line, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][kind]
        lines.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def npy(array):
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def test_images_are_decoded(spark, tmp_path):
    image = rng.integers(0, 256, (11, 7, 3)).astype(np.uint8)
    assert (images.decode_png(png(image, (0, 1, 2, 3, 4))) == image).all()
    with pytest.raises(ValueError, match="not a PNG"):
        images.decode_png(b"GIF")
    depth = rng.uniform(100, 2000, (11, 7))
    depth[0, 0], depth[1, 1] = np.nan, np.inf
    (tmp_path / "000_rgb.png").write_bytes(png(image))
    (tmp_path / "000_depth.npy").write_bytes(npy(depth))
    (tmp_path / "001_rgb.png").write_bytes(png(image))
    got = images.read_pairs(spark, str(tmp_path)).collect()
    assert len(got) == 77 and {r.frame for r in got} == {"000"}
    assert all(r.raw == (depth[r.row, r.col] if np.isfinite(depth[r.row, r.col]) else 0) and r.g == image[r.row, r.col, 1] / 255 for r in got)


def test_a_capture_is_merged_and_its_drift_is_removed(spark, tmp_path):
    """Three views of one surface, of which the poses of two are off."""
    w, h, f = 90, 70, 100.0
    origin = (0.1, 0.05, 0.02)  # of the first pose, from which its unit is told
    (tmp_path / "imgs").mkdir()
    surface = lambda x, y: 0.5 + 0.03 * np.sin(25 * x) + 0.03 * np.cos(21 * y)
    poses = {}
    for k, (shift, error) in enumerate([((0, 0, 0), (0, 0, 0)), ((0.03, 0, 0), (0.003, 0.002, -0.003)), ((0.05, 0.02, 0), (0.006, -0.002, 0.004))]):
        col, row = np.meshgrid(np.arange(w), np.arange(h))
        d = np.full((h, w), 0.5)
        for _ in range(50):
            d = surface((col - w / 2) * d / f + shift[0], (row - h / 2) * d / f + shift[1])
        (tmp_path / "imgs" / f"00{k}_rgb.png").write_bytes(png(np.full((h, w, 3), 40 * k + 50, np.uint8)))
        (tmp_path / "imgs" / f"00{k}_depth.npy").write_bytes(npy(np.round(d * 1000, 3)))
        poses[f"00{k}"] = dict(zip(("x", "y", "z", "rx", "ry", "rz"), [*(1000 * (a + b + o) for a, b, o in zip(shift, error, origin, strict=True)), 0, 0, 0], strict=True))
    poses["009"] = poses["000"]  # a pose without images
    (tmp_path / "poses.json").write_text(json.dumps(poses))
    pixels = images.read_pairs(spark, str(tmp_path / "imgs"))
    where = files.read_poses(spark, str(tmp_path / "poses.json"))
    how = capture.Refinement(reaches=(0.012,), rounds=7, least_source=300, least_target=300, tolerance=1e-4)
    args = (pixels, where, (f, f, w / 2, h / 2), (-0.3, -0.35, 0.3), (0.5, 0.45, 0.7), capture.IDENTITY)
    error = {}
    for name, refine in (("as posed", None), ("refined", how)):
        got = capture.merge_capture(*args, how=refine, outliers=None).collect()
        assert sorted(r.pid for r in got) == list(range(len(got))) and all(0 < r.r < 1 for r in got)
        p = np.array([[r.x, r.y, r.z] for r in got])
        p = p - origin
        error[name] = np.abs(p[:, 2] - surface(p[:, 0], p[:, 1])).mean()
    assert error["refined"] < 0.5 * error["as posed"] and error["refined"] < 0.001
    assert capture.merge_capture(*args[:3], (5, 5, 5), (6, 6, 6), capture.IDENTITY).count() == 0
