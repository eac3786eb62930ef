"""Files and streams."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquilt.operators import clouds
from geoquilt.sources import files, ply, views
from geoquilt.streaming import frames

SF = "/root/testdata/sf0.001"


def test_text_cloud_round_trip(spark, tmp_path):
    points = views.oriented_points(spark, SF)
    files.write_text_cloud(points, str(tmp_path / "cloud"))
    back = files.read_text_cloud(spark, str(tmp_path / "cloud"))
    names = ("x", "y", "z", "nx", "ny", "nz")
    want = clouds.decode_text(clouds.encode_text(points))
    assert sorted(map(tuple, back.select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))


def test_json_sources(spark, tmp_path):
    (tmp_path / "poses.json").write_text('{"f1": {"x": 1, "y": 2, "z": 3, "rx": 0, "ry": 90, "rz": 0}, "f2": {"x": 4}}')
    got = {r.frame: r for r in files.read_poses(spark, str(tmp_path / "poses.json")).collect()}
    assert (got["f1"].ry, got["f2"].x, got["f2"].y) == (90.0, 4.0, None)
    (tmp_path / "intrinsics.json").write_text('{"intrinsics": {"color": {"width": 640, "fx": "bad", "ppx": 10.5}}}')
    row = files.read_intrinsics(spark, str(tmp_path / "intrinsics.json")).first()
    assert (row.width, row.height, row.fx, row.ppx) == (640.0, 720.0, 920.0, 10.5)


def test_missing_json_files(spark, tmp_path):
    assert files.read_poses(spark, str(tmp_path / "none.json")).count() == 0
    assert files.read_intrinsics(spark, str(tmp_path / "none.json")).first().asDict() == files.INTRINSICS


def test_ply_folder_round_trip(spark, tmp_path):
    points = views.oriented_points(spark, SF).repartition(3)
    ply.write_ply(points, str(tmp_path / "cloud"), rows_per_file=70)
    back = ply.read_ply(spark, str(tmp_path / "cloud"), rows_per_task=33).collect()
    assert sorted(r.pid for r in back) == list(range(points.count()))
    rows = {tuple(r[c] for c in ply.GEOMETRY): tuple(r[c] for c in "rgb") for r in points.collect()}
    assert len(back) == len(rows) and all(max(abs(a - b) for a, b in zip(rows[tuple(r[c] for c in ply.GEOMETRY)], (r.r, r.g, r.b), strict=True)) <= 0.5 / 255 + 1e-9 for r in back)
    parts = sorted((tmp_path / "cloud").glob("*.ply"))
    assert len(parts) >= 8 and not list((tmp_path / "cloud").glob("_temporary*"))
    one = ply.read_ply(spark, str(parts[0])).orderBy("pid").collect()
    assert [r.pid for r in one] == list(range(70)) and one[5].x == next(r.x for r in back if r.pid == 5)
    ply.write_ply(points.limit(0), str(tmp_path / "empty"))
    assert ply.read_ply(spark, str(tmp_path / "empty")).count() == 0


def test_ascii_ply_is_split_and_numbered(spark, tmp_path):
    head = "ply\r\nformat ascii 1.0\r\ncomment made\r\nelement camera 2\r\nproperty float f\r\nelement vertex 20000\r\nproperty float x\r\nproperty uchar red\r\nelement face 1\r\nproperty list uchar int v\r\nend_header\r\n1\r\n2\r\n"
    (tmp_path / "a.ply").write_text(head + "".join(f"{i}.5 {i % 256}\r\n" for i in range(20_000)) + "3 0 1 2\r\n", newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = ply.read_ply(spark, str(tmp_path / "a.ply"))
        assert got.rdd.getNumPartitions() > 1 and spark.read.text(str(tmp_path / "a.ply")).rdd.getNumPartitions() > 10
        assert sorted(map(tuple, got.collect())) == [(i, i + 0.5, i % 256 / 255) for i in range(20_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_binary_ply_of_both_byte_orders(spark, tmp_path):
    for order, name in (("<", "little"), (">", "big")):
        rows = np.zeros(1000, [("x", order + "f4"), ("id", order + "i4"), ("green", "u1")])
        rows["x"], rows["id"], rows["green"] = np.arange(1000) / 4, np.arange(1000) * 7, np.arange(1000) % 256
        head = f"ply\nformat binary_{name}_endian 1.0\nelement camera 3\nproperty double f\nelement vertex 1000\nproperty float x\nproperty int id\nproperty uint8 green\nelement face 9\nproperty list uchar int v\nend_header\n"
        (tmp_path / f"{name}.ply").write_bytes(head.encode() + b"\0" * 24 + rows.tobytes() + b"\1\0\0\0\0" * 9)
        got = ply.read_ply(spark, f"file://{tmp_path}/{name}.ply", rows_per_task=300)
        assert sorted(map(tuple, got.collect())) == [(i, i / 4, i * 7.0, i % 256 / 255) for i in range(1000)]
        assert spark.read.format("ply").option("rowsPerTask", 100).load(f"{tmp_path}/{name}.ply").rdd.getNumPartitions() == 10
    (tmp_path / "cut.ply").write_bytes(head.encode() + rows.tobytes()[:500])
    with pytest.raises(Exception, match="ends before its last vertex"):
        ply.read_ply(spark, str(tmp_path / "cut.ply")).collect()


@pytest.mark.parametrize(
    ("data", "match"),
    [("plain", "not a PLY"), ("ply\nformat ascii 1.0\n", "no end"), ("ply\nformat odd 1.0\nend_header\n", "format"), ("ply\nformat ascii 1.0\nend_header\n", "no vertices"),
     ("ply\nformat binary_little_endian 1.0\nelement face 1\nproperty list uchar int v\nelement vertex 1\nproperty float x\nend_header\n", "lists")],
)
def test_bad_ply_headers(spark, tmp_path, data, match):
    (tmp_path / "bad.ply").write_text(data)
    with pytest.raises(ValueError, match=match):
        ply.read_ply(spark, str(tmp_path / "bad.ply"))


def test_search_order_of_clouds(spark, tmp_path):
    body = "ply\nformat ascii 1.0\nelement vertex {n}\nproperty float x\nend_header\n{rows}"
    (tmp_path / "debug").mkdir()
    with pytest.raises(FileNotFoundError):
        ply.load_cloud(spark, str(tmp_path))
    for k, name in enumerate(("b.ply", "a.ply", "merged.ply", "final_merged.ply")):
        (tmp_path / "debug" / name).write_text(body.format(n=1, rows=f"{k}\n"))
        assert ply.load_cloud(spark, str(tmp_path)).first().x == k
    assert ply.load_cloud(spark, str(tmp_path), str(tmp_path / "debug" / "b.ply")).first().x == 0
    with pytest.raises(FileNotFoundError):
        ply.find_cloud(spark, str(tmp_path), str(tmp_path / "none.ply"))
    (tmp_path / "debug" / "final_merged.ply").write_text(body.format(n=0, rows=""))
    with pytest.raises(ValueError, match="empty"):
        ply.load_cloud(spark, str(tmp_path))


def test_streams_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "events"))
    stream = frames.event_stream(spark, str(tmp_path / "events"))
    frames.to_memory(frames.running_voxels(frames.depth_stream(stream), 30, 30, 20, 12.5, 0.1), "voxels", "complete")
    want = frames.running_voxels(frames.depth_stream(events), 30, 30, 20, 12.5, 0.1)
    key = ("ix", "iy", "iz", "n")
    assert sorted(map(tuple, spark.table("voxels").select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    frames.to_memory(frames.windowed_events(stream, "1 hour", "30 minutes", "3650 days"), "windows", "update")
    last = spark.table("windows").groupBy("start", "end", "event_type").agg(F.max("n").alias("n"))
    assert last.agg(F.sum("n")).first()[0] == 2 * events.count()
    frames.to_memory(frames.sessions(stream, "10 minutes", "3650 days"), "sessions", "complete")
    assert spark.table("sessions").agg(F.sum("n")).first()[0] == events.count()
