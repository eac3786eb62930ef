"""Queries of cloud files and captures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquilt.functions.linalg import rounded
from geoquilt.operators import cameras, capture, clouds
from geoquilt.operators.numbering import indexed
from geoquilt.plans.oracles import CAMERA, DEPTH, METRES, ORIENTED, POSES, r, rotated, using
from geoquilt.sources import ply, views
from geoquilt.storage import shared_dir

XYZ = ("x", "y", "z")
INTRINSICS = (30.0, 30.0, 20.0, 12.5)
LOW, HIGH, VOXEL = (-1.513, -1.317, -1.2111), (1.537, 1.5713, 1.8137), 0.05
#: Rows of a transform by name.
NAMES = [f"{a}{k}" for a in "xyz" for k in range(4)]


def ply_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """All oriented points through files of at most 300 rows, read back in pieces of 128."""
    path = shared_dir(s, "cloud")
    ply.write_ply(views.oriented_points(s, d), path, rows_per_file=300)
    back = ply.read_ply(s, path, rows_per_task=128)
    return back.select(*[rounded(F.col(c)).alias(c) for c in (*XYZ, "nx", "ny", "nz")], *[F.rint(F.col(c) * 255).cast("long").alias(c) for c in "rgb"])


def pose_chain(s: SparkSession, d: str) -> DataFrame:
    """The product of all poses up to each frame."""
    poses = capture.pose_transforms(views.poses(s, d))
    order = indexed(poses, "frame", name="i")
    products = capture.prefix_products(order.select("i", "t"))
    return order.select("frame", F.col("i").alias("at")).join(products, F.col("at") == F.col("i")).select("frame", *[rounded(F.get("t", F.lit(k))).alias(n) for k, n in enumerate(NAMES)])


def capture_autotune(s: SparkSession, d: str) -> DataFrame:
    """Points in the box under every meaning of the poses and the calibration."""
    cloud = cameras.back_project(cameras.to_metres(views.depth_pixels(s, d)), *INTRINSICS)
    return capture.autotune(cloud, views.poses(s, d), LOW, HIGH)


def fused_capture(s: SparkSession, d: str) -> DataFrame:
    """All frames moved to the base through the calibration, cropped and averaged by cell."""
    cloud = capture.frame_clouds(views.depth_pixels(s, d), INTRINSICS, smooth=False)
    base = capture.to_base(cloud, capture.pose_transforms(views.poses(s, d), calibration=capture.hand_eye()))
    cells = clouds.voxel_downsample(clouds.crop(base, LOW, HIGH), VOXEL)
    return cells.select("ix", "iy", "iz", "n", *[rounded(F.col(c) + 1e-9).alias(c) for c in XYZ])


def _matrix(order: str = "XYZ", scale: float = 0.001) -> str:
    """x0..z3 of every pose: its rotation by the images of the axes, and its scaled position."""
    images = []
    for axis in "xyz":
        unit = {c: "1.0::DOUBLE" if c == axis else "0.0::DOUBLE" for c in "xyz"}
        images.append(f"SELECT frame, {', '.join(f'{v} AS {c}' for v, c in zip(rotated(order), 'xyz', strict=True))} FROM (SELECT *, {', '.join(f'{u} AS {c}' for c, u in unit.items())} FROM poses)")
    columns = ", ".join(f"{a}.{c} AS {c}{k}" for c in "xyz" for k, a in enumerate(("a", "b", "c")))
    return f"SELECT frame, {columns}, {', '.join(f't{c} * {scale}::DOUBLE AS {c}3' for c in 'xyz')} FROM ({images[0]}) a JOIN ({images[1]}) b USING (frame) JOIN ({images[2]}) c USING (frame) JOIN poses USING (frame)"


def _product(a: str, b: str) -> str:
    return ", ".join(f"{a}.{c}0 * {b}.x{k} + {a}.{c}1 * {b}.y{k} + {a}.{c}2 * {b}.z{k}" + (f" + {a}.{c}3" if k == 3 else "") + f" AS {c}{k}" for c in "xyz" for k in range(4))


def _calibrated(direction: str) -> str:
    """x, y, z of camera points in the tool's frame."""
    h = capture.hand_eye(direction=direction)
    move = ", ".join(f"{h[4 * i]!r}::DOUBLE * x + {h[4 * i + 1]!r}::DOUBLE * y + {h[4 * i + 2]!r}::DOUBLE * z + {h[4 * i + 3]!r}::DOUBLE AS {c}" for i, c in enumerate("xyz"))
    return f"SELECT frame, {move} FROM camera"


def _hypothesis(k: int, scale: float, order: str, direction: str) -> str:
    inside = " AND ".join(f"{v} + t{c} * {scale}::DOUBLE BETWEEN {a} AND {b}" for v, c, a, b in zip(rotated(order), "xyz", LOW, HIGH, strict=True))
    return f"SELECT {k} AS k, {scale}::DOUBLE AS scale, '{order}' AS axis_order, '{direction}' AS direction, count(*) FILTER ({inside})::BIGINT AS inliers FROM {direction} JOIN poses USING (frame)"


QUERIES = {f.__name__: f for f in (ply_roundtrip, pose_chain, capture_autotune, fused_capture)}
_DEPTHS = {"depth": DEPTH, "metres": METRES, "camera": CAMERA, "poses": POSES}
ORACLES = {
    "ply_roundtrip": using(f"SELECT {r('x', 'y', 'z', 'nx', 'ny', 'nz')}, {', '.join(f'round_even(oriented.{c} * 255, 0)::BIGINT AS {c}' for c in 'rgb')} FROM oriented", oriented=ORIENTED),
    "pose_chain": using(
        f"SELECT frame, {r(*NAMES)} FROM walk", True, poses=POSES, matrices=f"SELECT *, row_number() OVER (ORDER BY frame) AS i FROM ({_matrix()})",
        walk=f"SELECT i, frame, {', '.join(NAMES)} FROM matrices WHERE i = 1 UNION ALL SELECT m.i, m.frame, {_product('w', 'm')} FROM walk w JOIN matrices m ON m.i = w.i + 1",
    ),
    "capture_autotune": using(
        " UNION ALL ".join(_hypothesis(k, *h) for k, h in enumerate((s, o, c) for s in (1.0, 0.001) for o in ("XYZ", "ZYX") for c in capture.DIRECTIONS)),
        **_DEPTHS, **{c: _calibrated(c) for c in capture.DIRECTIONS},
    ),
    "fused_capture": using(
        f"SELECT floor(x / {VOXEL}::DOUBLE)::BIGINT AS ix, floor(y / {VOXEL}::DOUBLE)::BIGINT AS iy, floor(z / {VOXEL}::DOUBLE)::BIGINT AS iz, count(*) AS n, "
        + ", ".join(f"round(avg({c}) + 1e-9::DOUBLE, 6) + 0.0::DOUBLE AS {c}" for c in "xyz")
        + f" FROM base WHERE {' AND '.join(f'base.{c} BETWEEN {a} AND {b}' for c, a, b in zip('xyz', LOW, HIGH, strict=True))} GROUP BY ALL",
        **_DEPTHS, tool=_calibrated("tcp_cam"),
        base="SELECT " + ", ".join(f"{v} + t{c} * 0.001::DOUBLE AS {c}" for v, c in zip(rotated("XYZ"), "xyz", strict=True)) + " FROM tool JOIN poses USING (frame)",
    ),
}
