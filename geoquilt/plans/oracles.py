"""DuckDB SQL of the geometric queries, written against the input tables alone."""

from __future__ import annotations

POINTS = "SELECT vec_id AS pid, label AS cloud, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings"
ORIENTED = """SELECT vec_id AS pid, label AS cloud, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
  a / n AS nx, b / n AS ny, c / n AS nz, (embedding[7]::DOUBLE + 1) / 2 AS r, (embedding[8]::DOUBLE + 1) / 2 AS g, (embedding[9]::DOUBLE + 1) / 2 AS b
  FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM (SELECT *, embedding[4]::DOUBLE AS a, embedding[5]::DOUBLE AS b, embedding[6]::DOUBLE AS c FROM embeddings))"""
LARGE = "SELECT l_suppkey AS frame, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem"
DEPTH = """SELECT event_id // 1000 AS frame, event_id % 1000 // 40 AS row, event_id % 1000 % 40 AS col, value * 10 AS raw FROM events"""
METRES = """SELECT d.frame, row, col, CASE WHEN raw IS NULL OR NOT isfinite(raw) THEN 0 ELSE raw END / CASE WHEN q < 10 THEN 1.0 ELSE 1000.0 END AS d
  FROM depth d JOIN (SELECT frame, quantile_cont(raw, 0.95) AS q FROM depth GROUP BY frame) u ON u.frame = d.frame"""
POSES = """SELECT s_suppkey AS frame, s_acctbal / 10 AS tx, (s_suppkey * 5)::DOUBLE AS ty, (s_suppkey + 500)::DOUBLE AS tz,
  radians((s_suppkey * 37 % 360 - 180)::DOUBLE) AS rx, radians((s_suppkey * 53 % 360 - 180)::DOUBLE) AS ry, radians((s_suppkey * 71 % 360 - 180)::DOUBLE) AS rz FROM supplier"""
CAMERA = """SELECT frame, row, col, (col - 20.0::DOUBLE) * d / 30.0::DOUBLE AS x, (row - 12.5::DOUBLE) * d / 30.0::DOUBLE AS y, d AS z FROM metres WHERE d > 0 AND d <= 2.5"""
MASK = """SELECT row, col FROM (SELECT floor(l_extendedprice / 2100)::BIGINT AS row, l_quantity::BIGINT AS col, count(*) AS n FROM lineitem GROUP BY ALL)
  WHERE n > (SELECT count(*) FROM lineitem) / 2600"""
LINES = """SELECT user_id AS line_id, seq, seq * 0.1::DOUBLE AS x, value / 100 AS y, event_id % 7 * 0.1::DOUBLE AS z
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"""
MESH_V = "SELECT frame * 1000 + row * 40 + col AS vid, col * 0.01::DOUBLE AS x, row * 0.01::DOUBLE AS y, raw / 100000 AS z FROM depth"
MESH_T = """SELECT t.* FROM (
  SELECT 2 * vid AS tid, vid AS a, vid + 1 AS b, vid + 40 AS c FROM corner UNION ALL SELECT 2 * vid + 1, vid + 1, vid + 41, vid + 40 FROM corner) t
  WHERE EXISTS (FROM mesh_v WHERE vid = a) AND EXISTS (FROM mesh_v WHERE vid = b) AND EXISTS (FROM mesh_v WHERE vid = c)"""
METRICS = ("bottleneck", "w2", "em_smooth", "ct_smooth", "em_bounded", "ct_bounded", "em_centered", "ct_centered")
TRIALS = "SELECT p_partkey AS trial, " + ", ".join(
    f"CASE WHEN (p_partkey + {i}) % 17 = 0 THEN NULL ELSE (p_partkey * {7919 + 104729 * i}) % 1009 / 1009.0::DOUBLE END AS {m}" for i, m in enumerate(METRICS)
) + " FROM part"
LOSS = """SELECT trial, coalesce(bottleneck, 1) + 0.7::DOUBLE * coalesce(w2, 1) + 0.3::DOUBLE * (1 - least(coalesce(em_smooth, 0), 1))
  + 0.45::DOUBLE * (1 - least(coalesce(ct_smooth, 0), 1)) + 0.15::DOUBLE * (1 - (coalesce(em_bounded, 0) + coalesce(ct_bounded, 0)) / 2)
  + 0.15::DOUBLE * (1 - (coalesce(em_centered, 0) + coalesce(ct_centered, 0)) / 2) AS loss FROM trials"""
DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
PAIRS = f"SELECT a.pid AS u, b.pid AS v, {DIST} AS w FROM points a JOIN points b ON a.pid < b.pid AND {DIST} <= %s"
NEAR = f"SELECT * FROM (SELECT a.pid AS i, b.pid AS j, {DIST} AS d, row_number() OVER (PARTITION BY a.pid ORDER BY {DIST}, b.pid) AS rank FROM points a JOIN points b ON a.pid <> b.pid) WHERE rank <= %s"
BOTH = "SELECT u, v, w FROM pairs UNION ALL SELECT v, u, w FROM pairs"
REACH = "SELECT pid AS a, pid AS b FROM points UNION SELECT r.a, e.v FROM reach r JOIN arcs e ON e.u = r.b"


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0::DOUBLE AS {n}" for n in names)


def means(*names: str) -> str:
    return ", ".join(f"round({n} + 1e-9::DOUBLE, 6) + 0.0::DOUBLE AS {n}" for n in names)


def using(body: str, recursive: bool = False, **views: str) -> str:
    heads = ", ".join(f"{k} AS ({v})" for k, v in views.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{heads} {body}"


def square(n: int) -> str:
    return f"SELECT i - {n} AS dr, j - {n} AS dc FROM range({2 * n + 1}) a(i), range({2 * n + 1}) b(j)"


DILATED = "SELECT DISTINCT row + dr AS row, col + dc AS col FROM %s, around"
ERODED = "SELECT row + dr AS row, col + dc AS col FROM %s, around GROUP BY 1, 2 HAVING count(*) = 9"
NEIGHBOURS = ", ".join(
    f"EXISTS (FROM mask n WHERE n.row = m.row + ({a}) AND n.col = m.col + ({b}))::INT AS p{i}"
    for i, (a, b) in zip(range(2, 10), ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)), strict=True)
)
RING = f"SELECT row, col, {NEIGHBOURS} FROM mask m"
TURNS = " + ".join(f"(p{i} = 0 AND p{i % 9 + 1 if i < 9 else 2} = 1)::INT" for i in range(2, 10))
TOTAL = " + ".join(f"p{i}" for i in range(2, 10))


def rotated(order: str) -> list[str]:
    """x, y, z of a camera point after the axes of ``order`` in turn."""
    v = {"X": "x", "Y": "y", "Z": "z"}
    for axis in order:
        c, s = f"cos(r{axis.lower()})", f"sin(r{axis.lower()})"
        a, b = {"X": ("Y", "Z"), "Y": ("Z", "X"), "Z": ("X", "Y")}[axis]
        v = v | {a: f"({v[a]} * {c} - {v[b]} * {s})", b: f"({v[a]} * {s} + {v[b]} * {c})"}
    return [v[k] for k in "XYZ"]


def hypothesis(k: int, order: str, scale: float) -> str:
    inside = " AND ".join(f"{v} + t{c} * {scale}::DOUBLE BETWEEN {a} AND {b}" for v, c, a, b in zip(rotated(order), "xyz", (-0.513, -0.317, -0.2111), (1.037, 1.0713, 1.4137), strict=True))
    return f"SELECT {k} AS k, '{order}' AS axis_order, {scale}::DOUBLE AS scale, count(*) FILTER ({inside})::BIGINT AS inliers FROM camera JOIN poses USING (frame)"


def eigenvalues(source: str) -> str:
    """l1, l2, l3 of the moments xx..yz of ``source``, with its other columns."""
    return f"""SELECT *, q + 2 * p * cos(phi) AS l1, 3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2.0943951023931953)) AS l2, q + 2 * p * cos(phi + 2.0943951023931953) AS l3 FROM (
    SELECT *, acos(least(greatest(CASE WHEN p > 0 THEN ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p) ELSE 0 END, -1), 1)) / 3 AS phi FROM (
    SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM (
    SELECT *, (xx + yy + zz) / 3 AS q FROM {source})))"""


def moments(kind: str) -> str:
    return ", ".join(f"covar_{kind}({a}, {b}) AS {a}{b}" for a, b in (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")))


def blurred_frames(source: str, axis: str, other: str, n: int) -> str:
    return blurred(source, axis, f"frame, {other}", n)


def blurred(source: str, axis: str, other: str, n: int) -> str:
    return f"""SELECT t AS {axis}, {other}, sum(w * v) AS v FROM range({n}) a(t), (SELECT i - 3 AS o, exp(-0.5 * (i - 3) * (i - 3)) / (SELECT sum(exp(-0.5 * (i - 3) * (i - 3))) FROM range(7) z(i)) AS w FROM range(7) k(i)) k, {source}
    WHERE {source}.{axis} = greatest(least(t + o, {n - 1}), 0) GROUP BY ALL"""


TRIANGLES = """SELECT tid, a, b, c, n1 / greatest(s, 1e-300) AS nx, n2 / greatest(s, 1e-300) AS ny, n3 / greatest(s, 1e-300) AS nz FROM (
  SELECT *, sqrt(n1 * n1 + n2 * n2 + n3 * n3) AS s FROM (
  SELECT tid, a, b, c, (q.y - p.y) * (o.z - p.z) - (q.z - p.z) * (o.y - p.y) AS n1, (q.z - p.z) * (o.x - p.x) - (q.x - p.x) * (o.z - p.z) AS n2, (q.x - p.x) * (o.y - p.y) - (q.y - p.y) * (o.x - p.x) AS n3
  FROM mesh_t JOIN mesh_v p ON p.vid = a JOIN mesh_v q ON q.vid = b JOIN mesh_v o ON o.vid = c))"""
SIDES = """SELECT tid, nx, ny, nz, least(a, b) AS u, greatest(a, b) AS v FROM tri UNION ALL SELECT tid, nx, ny, nz, least(b, c), greatest(b, c) FROM tri UNION ALL SELECT tid, nx, ny, nz, least(c, a), greatest(c, a) FROM tri"""
ADJACENT = """SELECT p.u, p.v, p.tid AS t1, q.tid AS t2, p.nx * q.nx + p.ny * q.ny + p.nz * q.nz AS cosine FROM sides p JOIN sides q ON p.u = q.u AND p.v = q.v AND p.tid < q.tid
  JOIN (SELECT u, v FROM sides GROUP BY ALL HAVING count(*) = 2) k ON k.u = p.u AND k.v = p.v"""
MESH = {"depth": DEPTH, "mesh_v": MESH_V, "corner": "SELECT frame * 1000 + row * 40 + col AS vid FROM depth WHERE row < 24 AND col < 39", "mesh_t": MESH_T, "tri": TRIANGLES, "sides": SIDES, "adjacent": ADJACENT}
CELLS = "SELECT *, floor(x / 0.15)::BIGINT AS kx, floor(y / 0.15)::BIGINT AS ky, floor(z / 0.15)::BIGINT AS kz FROM points"
MERGED = "SELECT kx, ky, kz, row_number() OVER (ORDER BY min(pid)) - 1 AS new_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM cells GROUP BY ALL"
COLOR = lambda c: f"round_even(least(greatest({c}, 0), 1) * 255, 0)::INT"
ENCODED = "SELECT pid, printf('%.6f %.6f %.6f %.3f %.3f %.3f %d %d %d', " + ", ".join(
    [f"round_even({c} / 0.0005::DOUBLE, 0) * 0.0005::DOUBLE + 0.0" for c in "xyz"] + [f"round_even({c} / 0.01::DOUBLE, 0) * 0.01::DOUBLE + 0.0" for c in ("nx", "ny", "nz")] + [COLOR(c) for c in "rgb"]
) + ") AS value FROM oriented"
ARCS_09 = {"points": POINTS, "pairs": PAIRS % 0.09, "arcs": BOTH}
#: Shortest ways by rounds of relaxation over all nodes.
RELAX = """SELECT 0 AS k, 0::BIGINT AS vid, 0.0::DOUBLE AS dist UNION ALL
  SELECT k + 1, v, min(dist + w) FROM ways JOIN arcs ON u = vid WHERE k < 60 GROUP BY ALL"""

ORACLES: dict[str, str] = {
    "voxel_downsample": using(f"SELECT ix, iy, iz, n, {means('x', 'y', 'z')} FROM (SELECT floor(x / 2)::BIGINT AS ix, floor(y / 2)::BIGINT AS iy, floor(z / 2)::BIGINT AS iz, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM large GROUP BY ALL)".replace("FROM large GROUP BY ALL", "FROM large GROUP BY 1, 2, 3"), large=LARGE),
    "flagship_crop_downsample": using(f"SELECT ix, iy, iz, n, {means('x', 'y', 'z')} FROM (SELECT floor(x / 2)::BIGINT AS ix, floor(y / 2)::BIGINT AS iy, floor(z / 2)::BIGINT AS iz, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM large WHERE x BETWEEN 1 AND 40 AND y BETWEEN 5 AND 60 AND z BETWEEN 0 AND 8 GROUP BY 1, 2, 3)", large=LARGE),
    "aabb_crop": using(f"SELECT pid, cloud, {r('x', 'y', 'z')} FROM points WHERE x BETWEEN -0.15::DOUBLE AND 0.15::DOUBLE AND y BETWEEN -0.15::DOUBLE AND 0.15::DOUBLE AND z BETWEEN -0.15::DOUBLE AND 0.15::DOUBLE", points=POINTS),
    "cloud_stats": using("SELECT cloud, n, " + r("cx", "cy", "cz", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z") + ", round(sqrt((max_x - min_x) * (max_x - min_x) + (max_y - min_y) * (max_y - min_y) + (max_z - min_z) * (max_z - min_z)), 6) AS diagonal FROM (SELECT cloud, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM points GROUP BY cloud)", points=POINTS),
    "knn": using(f"SELECT i, j, rank, {r('d')} FROM near", points=POINTS, near=NEAR % 8),
    "radius_pairs": using(f"SELECT u, v, {r('w')} FROM pairs", points=POINTS, pairs=PAIRS % 0.1),
    "radius_pairs_own": using(f"SELECT a.pid AS i, b.pid AS j, round({DIST}, 6) AS d FROM points a JOIN points b ON a.pid <> b.pid AND {DIST} <= 0.03 + (a.pid % 10) * 0.0137", points=POINTS),
    "hybrid_neighbours": using(f"SELECT i, j, rank, {r('d')} FROM near WHERE near.d <= 0.15", points=POINTS, near=NEAR % 6),
    "statistical_outlier": using("SELECT pid, cloud FROM points JOIN m ON pid = i WHERE md < (SELECT avg(md) + 2 * stddev_samp(md) FROM m)", points=POINTS, near=NEAR % 20, m="SELECT i, avg(d) AS md FROM near GROUP BY i"),
    "radius_outlier": using("SELECT pid, cloud FROM points WHERE pid IN (SELECT u FROM arcs GROUP BY u HAVING count(*) >= 8)", points=POINTS, pairs=PAIRS % 0.1, arcs=BOTH),
    "local_radii": using(f"SELECT pid, {r('radius')} FROM (SELECT i AS pid, quantile_cont(d, 0.5) AS radius FROM near GROUP BY i)", points=POINTS, near=NEAR % 8),
    "mean_spacing": using(f"SELECT {r('spacing')} FROM (SELECT quantile_cont(md, 0.5) AS spacing FROM (SELECT i, avg(d) AS md FROM near WHERE i IN (SELECT pid FROM points ORDER BY pid LIMIT 500) GROUP BY i))", points=POINTS, near=NEAR % 8),
    "surface_variation": using(f"SELECT pid, n, round(CASE WHEN n < 3 THEN 0 ELSE greatest(l3, 1e-12) / greatest(xx + yy + zz, 1e-12) END, 6) + 0.0::DOUBLE AS variation FROM ({eigenvalues('m')})", points=POINTS, ball=f"SELECT a.pid, b.x, b.y, b.z FROM points a JOIN points b ON {DIST} <= 0.12", m=f"SELECT pid, count(*) AS n, {moments('pop')} FROM ball GROUP BY pid"),
    "pca_spectrum": using(f"SELECT n, " + ", ".join(f"round({c}, 4) + 0.0::DOUBLE AS {c}" for c in ("cx", "cy", "cz", "l1", "l2", "l3")) + f" FROM ({eigenvalues('m')})", large=LARGE, m=f"SELECT count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, {moments('samp')} FROM large"),
    "quantize_points": using("SELECT pid, " + ", ".join(f"round(round_even({c} / 0.0005::DOUBLE, 0) * 0.0005::DOUBLE, 6) + 0.0::DOUBLE AS {c}" for c in "xyz") + " FROM points", points=POINTS),
    "text_encode": using("SELECT pid, value FROM encoded", oriented=ORIENTED, encoded=ENCODED),
    "text_decode": using("SELECT pid, " + ", ".join(f"round(f[{i + 1}]::DOUBLE, 6) + 0.0::DOUBLE AS {c}" for i, c in enumerate(("x", "y", "z", "nx", "ny", "nz"))) + ", " + ", ".join(f"round(f[{i + 7}]::DOUBLE / 255, 6) AS {c}" for i, c in enumerate("rgb")) + " FROM (SELECT pid, string_split(value, ' ') AS f FROM encoded)", oriented=ORIENTED, encoded=ENCODED),
    "depth_units": using("SELECT frame, round(q, 6) AS p95, CASE WHEN q < 10 THEN 'm' ELSE 'mm' END AS unit FROM (SELECT frame, quantile_cont(raw, 0.95) AS q FROM depth GROUP BY frame)", depth=DEPTH),
    "depth_bilateral": using("SELECT frame, row, col, round(CASE WHEN v < 1e-6 THEN 0 ELSE v END, 6) + 0.0::DOUBLE AS d FROM (SELECT o.frame, o.row, o.col, sum(exp(-((n.row - o.row) * (n.row - o.row) + (n.col - o.col) * (n.col - o.col)) / 18.0::DOUBLE - (n.d - o.d) * (n.d - o.d) / (2 * 0.03::DOUBLE * 0.03::DOUBLE)) * n.d) / sum(exp(-((n.row - o.row) * (n.row - o.row) + (n.col - o.col) * (n.col - o.col)) / 18.0::DOUBLE - (n.d - o.d) * (n.d - o.d) / (2 * 0.03::DOUBLE * 0.03::DOUBLE))) AS v FROM metres o JOIN around ON true JOIN metres n ON n.frame = o.frame AND n.row = o.row + dr AND n.col = o.col + dc GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY 1, 2, 3"), depth=DEPTH, metres=METRES, around=square(2)),
    "back_project": using(f"SELECT frame, row, col, {r('x', 'y', 'z')} FROM camera", depth=DEPTH, metres=METRES, camera=CAMERA),
    "pose_transform": using("SELECT frame, row, col, " + ", ".join(f"round({v} + t{c} * 0.001::DOUBLE, 6) + 0.0::DOUBLE AS {c}" for v, c in zip(rotated("XYZ"), "xyz", strict=True)) + " FROM camera JOIN poses USING (frame)", depth=DEPTH, metres=METRES, camera=CAMERA, poses=POSES),
    "autotune_extrinsics": using(" UNION ALL ".join(hypothesis(k, o, s) for k, (o, s) in enumerate((o, s) for o in ("XYZ", "ZYX") for s in (0.001, 1.0))), depth=DEPTH, metres=METRES, camera=CAMERA, poses=POSES),
    "tsdf_fuse": using(f"SELECT ix, iy, iz, {r('sdf')}, weight FROM (SELECT floor((col - 20.0::DOUBLE) * z / 30 / 0.05::DOUBLE)::BIGINT AS ix, floor((row - 12.5::DOUBLE) * z / 30 / 0.05::DOUBLE)::BIGINT AS iy, floor(z / 0.05::DOUBLE)::BIGINT AS iz, avg((d - z) / 0.15::DOUBLE) AS sdf, count(*) AS weight FROM (SELECT *, (floor(d / 0.05::DOUBLE) + i - 3 + 0.5::DOUBLE) * 0.05::DOUBLE AS z FROM metres, range(7) k(i) WHERE d > 0 AND d <= 2.5) WHERE abs(d - z) <= 0.15::DOUBLE AND z > 0 GROUP BY 1, 2, 3)", depth=DEPTH, metres=METRES),
    "proj_sinusoidal_hist": using("SELECT b.i::INT AS bin, count(pid) AS n FROM range(90) b(i) LEFT JOIN points ON least(floor((atan2(y, x) + pi()) / (2 * pi()) * 90), 89)::INT = b.i GROUP BY b.i", points=POINTS),
    "cyl4_sectors": using("SELECT pid, sector, round(r0 * least(greatest(atan2(sin(t), cos(t)), -pi() / 4), pi() / 4), 6) + 0.0::DOUBLE AS u, round(z, 6) + 0.0::DOUBLE AS v FROM (SELECT *, atan2(y, x) - sector * (pi() / 2) AS t FROM (SELECT *, ((floor((atan2(y, x) + pi() / 4) / (pi() / 2))::INT % 4 + 4) % 4)::INT AS sector FROM points)), (SELECT quantile_cont(sqrt(x * x + y * y), 0.95) AS r0 FROM points)", points=POINTS),
    "cube_faces": using("SELECT pid, CASE WHEN v0 >= 0 THEN '+' ELSE '-' END || axis AS face, round(CASE axis WHEN 'x' THEN y ELSE x END, 6) + 0.0::DOUBLE AS u, round(CASE axis WHEN 'z' THEN y ELSE z END, 6) + 0.0::DOUBLE AS v FROM (SELECT *, CASE axis WHEN 'x' THEN x WHEN 'y' THEN y ELSE z END AS v0 FROM (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN 'x' WHEN abs(y) >= abs(z) THEN 'y' ELSE 'z' END AS axis FROM points))", points=POINTS),
    "plane_inliers": using("SELECT pid FROM points WHERE abs(x + 2 * y - z + 0.013::DOUBLE) / sqrt(6::DOUBLE) <= 0.05::DOUBLE", points=POINTS),
    "ransac_plane": using(
        "SELECT trial, inliers, " + r("a", "b", "c", "d") + " FROM (SELECT trial, a, b, c, d, count(*) FILTER (abs(a * x + b * y + c * z + d) <= 0.02171::DOUBLE)::BIGINT AS inliers FROM planes, points GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5"),
        points=POINTS,
        slots="SELECT slot, arg_min({'x': x, 'y': y, 'z': z}, {'k': (pid * 2654435761 + slot * 7919) % 1000003, 'p': pid}) AS p FROM points, range(96) s(slot) GROUP BY slot",
        triples="SELECT slot // 3 AS trial, max(p) FILTER (slot % 3 = 0) AS p, max(p) FILTER (slot % 3 = 1) AS q, max(p) FILTER (slot % 3 = 2) AS o FROM slots GROUP BY 1",
        crossed="SELECT trial::INT AS trial, p, (q.y - p.y) * (o.z - p.z) - (q.z - p.z) * (o.y - p.y) AS n1, (q.z - p.z) * (o.x - p.x) - (q.x - p.x) * (o.z - p.z) AS n2, (q.x - p.x) * (o.y - p.y) - (q.y - p.y) * (o.x - p.x) AS n3 FROM triples",
        planes="SELECT trial, a, b, c, -(a * p.x + b * p.y + c * p.z) AS d FROM (SELECT trial, p, n1 / s AS a, n2 / s AS b, n3 / s AS c FROM (SELECT *, sqrt(n1 * n1 + n2 * n2 + n3 * n3) AS s FROM crossed) WHERE s > 0)",
    ),
    "normal_angle_stats": using("SELECT cloud, count(*) AS n, round(avg(t), 6) AS mean, round(quantile_cont(t, 0.5), 6) AS median, round(stddev_pop(t), 6) AS deviation, round(min(t), 6) AS least, round(max(t), 6) AS most FROM (SELECT cloud, degrees(acos(least(1, abs(nz)))) AS t FROM oriented) GROUP BY cloud", oriented=ORIENTED),
    "side_bins": using("SELECT pid, CASE WHEN t <= 15 + 1e-9 THEN 0 WHEN t <= 35 + 1e-9 THEN 1 WHEN t <= 55 + 1e-9 THEN 2 WHEN t <= 75 + 1e-9 THEN 3 WHEN t <= 90 + 1e-9 THEN 4 END AS bin FROM (SELECT pid, degrees(acos(least(1, abs(nz)))) AS t FROM oriented)", oriented=ORIENTED),
    "inplane_quadrants": using("SELECT pid, CASE WHEN sqrt(nx * nx + ny * ny) > 1e-9 THEN least(floor((atan2(-nx, ny) + pi()) / (pi() / 2)), 3)::INT END AS quadrant FROM oriented", oriented=ORIENTED),
    "merge_nodes_cell": using(f"SELECT c.pid AS vid, m.new_id, round(m.x, 6) + 0.0::DOUBLE AS x, round(m.y, 6) + 0.0::DOUBLE AS y, round(m.z, 6) + 0.0::DOUBLE AS z FROM cells c JOIN merged m USING (kx, ky, kz)", points=POINTS, cells=CELLS, merged=MERGED),
    "edge_remap": using("SELECT DISTINCT least(a.new_id, b.new_id) AS u, greatest(a.new_id, b.new_id) AS v FROM pairs JOIN ids a ON a.pid = u JOIN ids b ON b.pid = v WHERE a.new_id <> b.new_id", points=POINTS, pairs=PAIRS % 0.1, cells=CELLS, merged=MERGED, ids="SELECT pid, new_id FROM cells JOIN merged USING (kx, ky, kz)"),
    "graph_laplacian": using("SELECT i, j, round(-w, 4) + 0.0::DOUBLE AS v FROM w UNION ALL SELECT i, i, round(sum(w), 4) + 0.0::DOUBLE FROM w GROUP BY i", points=POINTS, near=NEAR % 6, w="SELECT i, j, max(w) AS w FROM (SELECT i, j, 1 / (d + 1e-12) AS w FROM near UNION ALL SELECT j, i, 1 / (d + 1e-12) FROM near) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2")),
    "node_degree": using("SELECT u AS vid, count(*) AS degree FROM arcs GROUP BY u", points=POINTS, pairs=PAIRS % 0.1, arcs=BOTH),
    "junction_median": using(f"SELECT pid, n, {r('x', 'y', 'z')} FROM (SELECT a.pid, count(*) AS n, quantile_cont(b.x, 0.5) AS x, quantile_cont(b.y, 0.5) AS y, quantile_cont(b.z, 0.5) AS z FROM points a JOIN points b ON {DIST} <= 0.1 WHERE a.pid IN (SELECT u FROM arcs GROUP BY u HAVING count(*) >= 3) GROUP BY a.pid)", points=POINTS, pairs=PAIRS % 0.04, arcs=BOTH),
    "em_estep_all": using("SELECT i, j, round(w / (sum(w) OVER (PARTITION BY j) + 0.01::DOUBLE), 6) + 0.0::DOUBLE AS r FROM weights", points=POINTS, weights=f"SELECT a.pid AS i, b.pid AS j, exp(-3.0::DOUBLE * abs(a.pid % 10 / 10.0::DOUBLE - b.pid % 10 / 10.0::DOUBLE)) * exp(-({DIST} * {DIST}) / (2 * 0.08::DOUBLE * 0.08::DOUBLE)) AS w FROM points a JOIN points b ON {DIST} <= 0.2"),
    "boundedness": using(f"SELECT pid AS i, round(coalesce(n, 0) / 64.0::DOUBLE, 6) AS bounded FROM points LEFT JOIN (SELECT i, count(DISTINCT k) AS n FROM rays JOIN dirs ON x * ux + y * uy + z * uz >= cos(radians(30.1)) GROUP BY i) s ON s.i = pid", points=POINTS, near=NEAR % 8, rays="SELECT i, (b.x - a.x) / d AS x, (b.y - a.y) / d AS y, (b.z - a.z) / d AS z FROM near JOIN points a ON a.pid = i JOIN points b ON b.pid = j WHERE d > 0", dirs="SELECT k, sqrt(1 - uz * uz) * cos(k * (pi() * (3 - sqrt(5)))) AS ux, sqrt(1 - uz * uz) * sin(k * (pi() * (3 - sqrt(5)))) AS uy, uz FROM (SELECT k, 1 - (2 * k + 1) / 64.0::DOUBLE AS uz FROM range(64) t(k))"),
    "centeredness": using("SELECT i, round(CASE WHEN md > 0 THEN greatest(1 - sqrt((p.x - mx) * (p.x - mx) + (p.y - my) * (p.y - my) + (p.z - mz) * (p.z - mz)) / md, 0) ELSE 0 END, 6) + 0.0::DOUBLE AS centered FROM (SELECT i, avg(d) AS md, avg(b.x) AS mx, avg(b.y) AS my, avg(b.z) AS mz FROM near JOIN points b ON b.pid = j GROUP BY i) JOIN points p ON p.pid = i", points=POINTS, near=NEAR % 15),
    "slab_centeredness": using("SELECT i, n, round(CASE WHEN n < 15 THEN 0 ELSE greatest(least(1 - sqrt(mx * mx + my * my + mz * mz) / (sqrt(greatest(xx + yy + zz + 2 * sqrt(greatest(xx * yy - xy * xy + xx * zz - xz * xz + yy * zz - yz * yz, 0)), 0)) / 2 + 1e-12), 1), 0) END, 6) + 0.0::DOUBLE AS centered FROM (SELECT i, n, mx, my, mz, xx - mx * mx AS xx, yy - my * my AS yy, zz - mz * mz AS zz, xy - mx * my AS xy, xz - mx * mz AS xz, yz - my * mz AS yz FROM (SELECT i, count(*) AS n, avg(qx) AS mx, avg(qy) AS my, avg(qz) AS mz, avg(qx * qx) AS xx, avg(qy * qy) AS yy, avg(qz * qz) AS zz, avg(qx * qy) AS xy, avg(qx * qz) AS xz, avg(qy * qz) AS yz FROM flat GROUP BY i))", points=ORIENTED, held=f"SELECT a.pid AS i, b.x - a.x AS ox, b.y - a.y AS oy, b.z - a.z AS oz, a.nx, a.ny, a.nz, (b.x - a.x) * a.nx + (b.y - a.y) * a.ny + (b.z - a.z) * a.nz AS p FROM points a JOIN points b ON {DIST} <= 0.3", flat="SELECT i, ox - p * nx AS qx, oy - p * ny AS qy, oz - p * nz AS qz FROM held"),
    "smoothness": using("SELECT vid, round(degrees(acos(least(greatest(c, -1), 1))), 4) + 0.0::DOUBLE AS angle, round(abs(c), 6) AS smooth, round(length, 6) AS length FROM (SELECT o.pid AS vid, ((p.x - o.x) * (q.x - o.x) + (p.y - o.y) * (q.y - o.y) + (p.z - o.z) * (q.z - o.z)) / (sqrt((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y) + (p.z - o.z) * (p.z - o.z)) * sqrt((q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y) + (q.z - o.z) * (q.z - o.z))) AS c, (e.w + f.w) / 2 AS length FROM two JOIN arcs e ON e.u = two.u JOIN arcs f ON f.u = two.u AND e.v < f.v JOIN points o ON o.pid = two.u JOIN points p ON p.pid = e.v JOIN points q ON q.pid = f.v)", points=POINTS, pairs=PAIRS % 0.04, arcs=BOTH, two="SELECT u FROM arcs GROUP BY u HAVING count(*) = 2"),
    "boundary_points": using("SELECT pid, round(share, 6) AS share FROM (SELECT i AS pid, (count(*) FILTER (a.cloud = b.cloud) + 1) / (count(*) + 1)::DOUBLE AS share FROM near JOIN points a ON a.pid = i JOIN points b ON b.pid = j GROUP BY i) WHERE share < 0.55::DOUBLE", points=POINTS, near=NEAR % 8),
    "resample_polyline": using(
        f"SELECT line_id, k, {r('x', 'y', 'z')} FROM (SELECT s.line_id, k, x + (x2 - x) * ((k * 0.2713::DOUBLE - a) / l) AS x, y + (y2 - y) * ((k * 0.2713::DOUBLE - a) / l) AS y, z + (z2 - z) * ((k * 0.2713::DOUBLE - a) / l) AS z FROM (SELECT *, unnest(range(ceil(a / 0.2713::DOUBLE)::BIGINT, ceil(e / 0.2713::DOUBLE)::BIGINT)) AS k FROM s) s"
        " UNION ALL SELECT line_id, CASE WHEN e = floor(e / 0.2713::DOUBLE) * 0.2713::DOUBLE THEN 0 ELSE 1 END + floor(e / 0.2713::DOUBLE)::BIGINT, x2, y2, z2 FROM s WHERE e = total AND (e - floor(e / 0.2713::DOUBLE) * 0.2713::DOUBLE >= 0.7::DOUBLE * 0.2713::DOUBLE OR e = floor(e / 0.2713::DOUBLE) * 0.2713::DOUBLE))",
        lines=LINES,
        steps="SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) + (z2 - z) * (z2 - z)) AS l FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE x2 IS NOT NULL",
        s="SELECT *, e - l AS a, max(e) OVER (PARTITION BY line_id) AS total FROM (SELECT *, sum(l) OVER (PARTITION BY line_id ORDER BY seq) AS e FROM steps WHERE l > 0)",
    ),
    "group_by_angle": using("SELECT line_id, round(t, 6) + 0.0::DOUBLE AS angle, CASE WHEN t <= 15 + 1e-9 THEN 0 WHEN t <= 35 + 1e-9 THEN 1 WHEN t <= 55 + 1e-9 THEN 2 WHEN t <= 75 + 1e-9 THEN 3 WHEN t <= 90 + 1e-9 THEN 4 END AS bin FROM (SELECT line_id, degrees(acos(least(abs(dy) / sqrt(dx * dx + dy * dy + dz * dz), 1))) AS t FROM (SELECT line_id, arg_max(x, seq) - arg_min(x, seq) AS dx, arg_max(y, seq) - arg_min(y, seq) AS dy, arg_max(z, seq) - arg_min(z, seq) AS dz FROM lines GROUP BY line_id) WHERE dx * dx + dy * dy + dz * dz > 0)", lines=LINES),
    "edge_samples": using("SELECT u, v, k, " + ", ".join(f"round(a.{c} + (b.{c} - a.{c}) * (k / (n - 1)::DOUBLE), 6) + 0.0::DOUBLE AS {c}" for c in "xyz") + " FROM (SELECT u, v, n, unnest(range(n)) AS k FROM (SELECT u, v, greatest(2, ceil(w / 0.0317::DOUBLE))::BIGINT AS n FROM pairs)) JOIN points a ON a.pid = u JOIN points b ON b.pid = v", points=POINTS, pairs=PAIRS % 0.1),
    "skeleton_json": using("SELECT line_id, count(DISTINCT {'x': x, 'y': y, 'z': z})::BIGINT AS n_points, count(*) FILTER (x2 IS NOT NULL AND (x <> x2 OR y <> y2 OR z <> z2))::BIGINT AS n_lines FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY seq)) GROUP BY line_id", lines=LINES),
    "polyline_segments": using("SELECT line_id, seq, round(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) + (z2 - z) * (z2 - z)), 6) AS length FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE x2 IS NOT NULL", lines=LINES),
    "voxelize": using("SELECT DISTINCT floor(z / 0.1::DOUBLE)::BIGINT AS iz, floor(y / 0.1::DOUBLE)::BIGINT AS iy, floor(x / 0.1::DOUBLE)::BIGINT AS ix FROM points", points=POINTS),
    "voxel_grid": using("SELECT round(v, 6) AS voxel, (greatest(1, ceil(dx / v)) + 5)::BIGINT AS nx, (greatest(1, ceil(dy / v)) + 5)::BIGINT AS ny, (greatest(1, ceil(dz / v)) + 5)::BIGINT AS nz FROM (SELECT *, CASE WHEN t > 100000 THEN 0.11::DOUBLE * pow(t / 100000, 1 / 3.0::DOUBLE) * 1.1::DOUBLE ELSE 0.11::DOUBLE END AS v FROM (SELECT *, (greatest(1, ceil(dx / 0.11::DOUBLE)) + 5) * (greatest(1, ceil(dy / 0.11::DOUBLE)) + 5) * (greatest(1, ceil(dz / 0.11::DOUBLE)) + 5) AS t FROM (SELECT max(x) - min(x) AS dx, max(y) - min(y) AS dy, max(z) - min(z) AS dz FROM large)))", large=LARGE),
    "ball_dilate": using("SELECT DISTINCT iz + a.i - 2 AS iz, iy + b.i - 2 AS iy, ix + c.i - 2 AS ix FROM voxels, range(5) a(i), range(5) b(i), range(5) c(i) WHERE (a.i - 2) * (a.i - 2) + (b.i - 2) * (b.i - 2) + (c.i - 2) * (c.i - 2) <= 4", points=POINTS, voxels="SELECT DISTINCT floor(z / 0.1::DOUBLE)::BIGINT AS iz, floor(y / 0.1::DOUBLE)::BIGINT AS iy, floor(x / 0.1::DOUBLE)::BIGINT AS ix FROM points"),
    "dilate": using(DILATED % "mask", mask=MASK, around=square(1)),
    "erode": using(ERODED % "mask", mask=MASK, around=square(1)),
    "opening": using(DILATED % "thinner", mask=MASK, around=square(1), thinner=ERODED % "mask"),
    "closing": using(ERODED % "thicker", mask=MASK, around=square(1), thicker=DILATED % "mask"),
    "gaussian_blur_frames": using("SELECT frame, row, col, round(v, 4) AS v FROM c", depth=DEPTH, g="SELECT frame, row, col, raw AS v FROM depth", b=blurred_frames("g", "row", "col", 25), c=blurred_frames("b", "col", "row", 40)),
    "otsu": using("SELECT (b + 1) / 256.0::DOUBLE AS threshold FROM (SELECT b, w, m, tw, tm FROM h WHERE w > 0 AND w < tw) ORDER BY round(w::DOUBLE * (tw - w) * (m / w::DOUBLE - (tm - m) / (tw - w)::DOUBLE) * (m / w::DOUBLE - (tm - m) / (tw - w)::DOUBLE), 6) DESC, b LIMIT 1", depth=DEPTH, c="SELECT k.b, count(raw) AS n FROM range(256) k(b) LEFT JOIN depth ON least(floor(least(raw / 2000, 1) * 256), 255) = k.b GROUP BY k.b", h="SELECT b, sum(n) OVER o AS w, sum(b * n) OVER o AS m, sum(n) OVER () AS tw, sum(b * n) OVER () AS tm FROM c WINDOW o AS (ORDER BY b ROWS UNBOUNDED PRECEDING)"),
    "contour": using("SELECT row, col FROM ring WHERE p2 + p4 + p6 + p8 < 4", mask=MASK, ring=RING),
    "zhang_suen_pass": using(f"SELECT row, col FROM ring WHERE NOT ({TURNS} = 1 AND {TOTAL} BETWEEN 2 AND 6 AND p2 * p4 * p6 = 0 AND p4 * p6 * p8 = 0)", mask=MASK, ring=RING),
    "edt_ridge": using("SELECT row, col, d2 FROM e WHERE d2 > 0 AND d2 >= coalesce((SELECT max(n.d2) FROM e n WHERE greatest(abs(n.row - e.row), abs(n.col - e.col)) = 1), 0)", mask=MASK, ring=RING, edge="SELECT row, col FROM ring WHERE p2 + p4 + p6 + p8 < 4", e="SELECT m.row, m.col, coalesce(min((m.row - c.row) * (m.row - c.row) + (m.col - c.col) * (m.col - c.col)), 0)::BIGINT AS d2 FROM mask m, edge c GROUP BY m.row, m.col"),
    "skeleton_nodes": using(f"SELECT row, col, ({TOTAL})::BIGINT AS degree FROM ring WHERE {TOTAL} <> 2", mask=MASK, ring=RING),
    "plane_raster": using("SELECT DISTINCT floor((y - (SELECT min(y) FROM points)) / 0.0213::DOUBLE)::BIGINT AS row, floor((x - (SELECT min(x) FROM points)) / 0.0213::DOUBLE)::BIGINT AS col FROM points", points=POINTS),
    "connected_components": using("SELECT a AS vid, min(b) AS component FROM reach GROUP BY a", True, points=POINTS, pairs=PAIRS % 0.06, arcs=BOTH, reach=REACH),
    "largest_component": using("SELECT vid, component FROM parts WHERE component = (SELECT component FROM parts GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)", True, points=POINTS, pairs=PAIRS % 0.06, arcs=BOTH, reach=REACH, parts="SELECT a AS vid, min(b) AS component FROM reach GROUP BY a"),
    "union_find_merge": using(f'SELECT "group", n, {r("x", "y", "z")} FROM (SELECT component AS "group", count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points JOIN (SELECT a, min(b) AS component FROM reach GROUP BY a) ON a = pid GROUP BY component)', True, points=POINTS, pairs=PAIRS % 0.05, arcs=BOTH + "", reach=REACH),
    "region_growing": using("SELECT vid AS pid, component AS region FROM parts WHERE component IN (SELECT component FROM parts GROUP BY component HAVING count(*) >= 3)", True, points=ORIENTED, pairs=f"SELECT a.pid AS u, b.pid AS v, 0 AS w FROM points a JOIN points b ON a.pid < b.pid AND {DIST} <= 0.12 AND a.nx * b.nx + a.ny * b.ny + a.nz * b.nz >= cos(radians(40.3))", arcs=BOTH, reach=REACH, parts="SELECT a AS vid, min(b) AS component FROM reach GROUP BY a"),
    "dbscan": using("SELECT p.pid, coalesce(l.component, (SELECT min(component) FROM arcs JOIN labels ON labels.a = arcs.v WHERE arcs.u = p.pid), -1) AS cluster FROM points p LEFT JOIN labels l ON l.a = p.pid", True, points=POINTS, pairs=PAIRS % 0.08, arcs=BOTH, core="SELECT u FROM arcs GROUP BY u HAVING count(*) + 1 >= 5", reach="SELECT u AS a, u AS b FROM core UNION SELECT r.a, e.v FROM reach r JOIN arcs e ON e.u = r.b WHERE e.v IN (SELECT u FROM core)", labels="SELECT a, min(b) AS component FROM reach GROUP BY a"),
    "mst_edges": using("SELECT u, v, round(w, 6) AS w FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.u = p.u AND c.v = p.v)", True, points=POINTS, pairs=PAIRS % 0.09, ranked="SELECT u, v, w, row_number() OVER (ORDER BY w, u, v) AS k FROM pairs", arcs="SELECT u, v, k FROM ranked UNION ALL SELECT v, u, k FROM ranked", reach="SELECT k AS e, u AS n FROM ranked UNION SELECT r.e, a.v FROM reach r JOIN arcs a ON a.u = r.n AND a.k < r.e", cut="SELECT u, v FROM ranked JOIN reach ON e = k AND n = v"),
    "sssp": using("SELECT vid, round(min(dist), 6) AS dist FROM ways GROUP BY vid", True, **ARCS_09, ways=RELAX),
    "mesh_edges": using("SELECT DISTINCT u, v FROM sides", **MESH),
    "triangle_adjacency": using(f"SELECT u, v, t1, t2, {r('cosine')} FROM adjacent", **MESH),
    "ridge_vertices": using("SELECT DISTINCT unnest([u, v]) AS vid FROM adjacent WHERE cosine < cos(radians(35.017))", **MESH),
    "objective_topk": using("SELECT trial, round(loss, 6) AS loss FROM losses ORDER BY losses.loss, trial LIMIT 5", trials=TRIALS, losses=LOSS),
    "moving_avg_trials": using("SELECT trial % 8 AS series, trial, round(loss, 6) AS loss, round(avg(losses.loss) OVER (PARTITION BY trial % 8 ORDER BY trial ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS average FROM losses", trials=TRIALS, losses=LOSS),
    "objective_all": using("SELECT trial, round(loss, 6) AS loss FROM losses", trials=TRIALS, losses=LOSS),
    "laplacian_blend": using("SELECT pid, " + ", ".join(f"round(0.5::DOUBLE * p.{c} + 0.5::DOUBLE * m{c}, 6) + 0.0::DOUBLE AS {c}" for c in "xyz") + " FROM points p JOIN (SELECT i, sum(w * b.x) / sum(w) AS mx, sum(w * b.y) / sum(w) AS my, sum(w * b.z) / sum(w) AS mz FROM weights JOIN points b ON b.pid = j GROUP BY i) ON i = p.pid", points=POINTS, near=NEAR % 8, weights="SELECT i, j, greatest(exp(-(d * d) / (2 * s * s)), 1e-12) AS w FROM near JOIN (SELECT i, greatest(0.6::DOUBLE * quantile_cont(d, 0.5), 1e-12) AS s FROM near GROUP BY i) USING (i)"),
    "gated_junctions": using(f"SELECT pid, {r('x', 'y', 'z')} FROM (SELECT i AS pid, " + ", ".join(f"coalesce(avg({c}) FILTER (ok), avg({c})) AS {c}" for c in "xyz") + " FROM (SELECT *, nx * mx + ny * my + nz * mz > cos(radians(60.3)) * sqrt(mx * mx + my * my + mz * mz) AS ok FROM (SELECT *, avg(nx) OVER w AS mx, avg(ny) OVER w AS my, avg(nz) OVER w AS mz FROM ball WINDOW w AS (PARTITION BY i))) GROUP BY i)", points=ORIENTED, pairs=PAIRS % 0.04, arcs=BOTH, ball=f"SELECT a.pid AS i, b.x, b.y, b.z, b.nx, b.ny, b.nz FROM points a JOIN points b ON {DIST} <= 0.1 WHERE a.pid IN (SELECT u FROM arcs GROUP BY u HAVING count(*) >= 3)"),
    "polyline_prune_all": using("SELECT line_id, seq FROM lines WHERE line_id IN (SELECT line_id FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY line_id) AS n FROM lines), box WHERE k = n // 2 AND abs(x - mx) <= hx AND abs(y - my) <= hy AND abs(z - mz) <= hz)", lines=LINES, box="SELECT " + ", ".join(f"(min({c}) + max({c})) / 2 AS m{c}, (max({c}) - min({c})) / 2 * 1.1::DOUBLE + 1e-12 AS h{c}" for c in "xyz") + " FROM lines"),
    "mesh_prune_points": using("SELECT tid FROM mesh_t WHERE a IN (FROM good) OR b IN (FROM good) OR c IN (FROM good)", **MESH, points=POINTS, good=f"SELECT DISTINCT a.vid FROM mesh_v a JOIN points b ON {DIST} <= 0.0213"),
    "vertex_normals": using("SELECT vid, " + ", ".join(f"round(CASE WHEN s > 0 THEN {c} / s ELSE {e} END, 6) + 0.0::DOUBLE AS {c}" for c, e in (("nx", 0.0), ("ny", 0.0), ("nz", 1.0))) + " FROM (SELECT v.vid, nx, ny, nz, sqrt(nx * nx + ny * ny + nz * nz) AS s FROM mesh_v v LEFT JOIN (SELECT vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT unnest([a, b, c]) AS vid, nx, ny, nz FROM tri) GROUP BY vid) n ON n.vid = v.vid)", **MESH),
}

def drawn(salt: int) -> str:
    return f"((p_partkey::BIGINT * 2654435761 + {salt * 7919}) % 1000003 / 1000003.0::DOUBLE)"


ORACLES |= {
    "spacing_quantile": using(f"SELECT {r('spacing')} FROM (SELECT quantile_cont(d, 0.1) AS spacing FROM near)", points=POINTS, near=NEAR % 7),
    "index_selection": using("SELECT pid, EXISTS (FROM supplier WHERE s_suppkey = pid) AS selected FROM points", points=POINTS),
    "weighted_adjacency": using("SELECT u, v, round(w, 6) AS w FROM arcs WHERE arcs.w >= 0.0513", points=POINTS, pairs=PAIRS % 0.1, arcs=BOTH),
    "largest_groups": using('SELECT component AS "group", n, row_number() OVER (ORDER BY n DESC, component) AS rank FROM (SELECT component, count(*) AS n FROM (SELECT a, min(b) AS component FROM reach GROUP BY a) GROUP BY component) ORDER BY n DESC, component LIMIT 128', True, points=POINTS, pairs=PAIRS % 0.06, arcs=BOTH, reach=REACH),
    "contour_links": using("SELECT a.row, a.col, b.row AS row2, b.col AS col2 FROM edge a JOIN edge b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (b.row, b.col) > (a.row, a.col)", mask=MASK, ring=RING, edge="SELECT row, col FROM ring WHERE p2 + p4 + p6 + p8 < 4"),
    "random_sample": f"SELECT p_partkey AS trial, 4 + floor({drawn(1)} * 21)::BIGINT AS k, 1 + floor({drawn(2)} * 10)::BIGINT AS rounds, round(0.01::DOUBLE + {drawn(3)} * 0.19::DOUBLE, 6) AS sigma, round({drawn(4)} * 0.1::DOUBLE, 6) + 0.0::DOUBLE AS outlier FROM part",
}
ORACLES |= {
    "em_estep": ORACLES["em_estep_all"],
    "gaussian_blur": ORACLES["gaussian_blur_frames"],
    "polyline_prune": ORACLES["polyline_prune_all"],
    "mesh_prune": ORACLES["mesh_prune_points"],
}
