"""Queries of thinned volumes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquilt.operators import graphs, skeletons, voxels
from geoquilt.plans.oracles import using
from geoquilt.sources import views
from geoquilt.storage import stored

ZYX = voxels.ZYX


def solid(s: SparkSession, d: str) -> DataFrame:
    """Voxels of the large cloud that hold more than a 28,000th of its points."""
    p = views.large_points(s, d)
    cells = p.groupBy(F.round("z").cast("long").alias("iz"), F.floor(F.col("y") / 2).cast("long").alias("iy"), F.col("x").cast("long").alias("ix")).agg(F.count("*").alias("n"))
    total = p.agg(F.count("*").alias("total"))
    return cells.join(F.broadcast(total)).where(F.col("n") * 28_000 > F.col("total")).select(*ZYX)  # one row


def simple_voxels(s: SparkSession, d: str) -> DataFrame:
    """Neighbourhood and simplicity of every voxel."""
    return voxels.neighbour_codes(solid(s, d)).select(*ZYX, "code", voxels.is_simple(F.col("code")).alias("simple"))


def thinned_volume(s: SparkSession, d: str) -> DataFrame:
    """The volume's curve skeleton."""
    return voxels.thin(solid(s, d))


def volume_nodes(s: SparkSession, d: str) -> DataFrame:
    """Ends, junctions and lone voxels of the volume as it is."""
    return voxels.skeleton_nodes(solid(s, d))


def volume_parts(s: SparkSession, d: str) -> DataFrame:
    """The volume's components, by the least packed voxel, found in its skeleton: thinning joins none and loses none."""
    whole = stored(solid(s, d), "volume")
    thin = stored(voxels.thin(whole), "volume-thin")
    vid = voxels.packed(*[F.col(c) for c in ZYX]).alias("vid")
    parts = lambda v: graphs.label_components(v.select(vid), voxels.voxel_edges(v))
    all_parts = stored(parts(whole), "volume-parts")
    seen = parts(thin).join(all_parts.withColumnsRenamed({"vid": "w", "component": "part"}), F.col("vid") == F.col("w"))
    lines = seen.groupBy("part").agg(F.countDistinct("component").alias("lines"))
    sizes = all_parts.groupBy(F.col("component").alias("p")).agg(F.count("*").alias("n"))
    return sizes.join(lines, F.col("p") == F.col("part"), "left").select(*voxels.unpacked(F.col("p")), "n", F.coalesce("lines", F.lit(0)).alias("lines"))


def volume_polylines(s: SparkSession, d: str) -> DataFrame:
    """Polylines of the volume's skeleton, in order, in world units."""
    line = skeletons.traced(voxels.voxel_edges(voxels.thin(solid(s, d))))
    return voxels.to_world(line.select(F.col("start.a").alias("a"), F.col("start.b").alias("b"), "seq", *voxels.unpacked(F.col("vid"))), 2.0)


_SOLID = """SELECT iz, iy, ix FROM (SELECT round(l_discount * 100)::BIGINT AS iz, floor(l_extendedprice / 1000 / 2)::BIGINT AS iy, l_quantity::BIGINT AS ix, count(*) AS n FROM lineitem GROUP BY ALL)
  WHERE n * 28000 > (SELECT count(*) FROM lineitem)"""
_STEPS = "SELECT z, y, x, (1 << CASE WHEN k > 13 THEN k - 1 ELSE k END)::BIGINT AS bit FROM (SELECT k, k // 9 - 1 AS z, k // 3 % 3 - 1 AS y, k % 3 - 1 AS x FROM range(27) r(k)) WHERE k <> 13"
_CODES = "SELECT v.iz, v.iy, v.ix, coalesce(sum(bit) FILTER (w.iz IS NOT NULL), 0)::BIGINT AS code FROM solid v CROSS JOIN steps s LEFT JOIN solid w ON w.iz = v.iz + s.z AND w.iy = v.iy + s.y AND w.ix = v.ix + s.x GROUP BY ALL"


def _spread(mask: str, touching: tuple[int, ...]) -> str:
    return "(" + " | ".join([mask, *(f"CASE WHEN {mask} & {1 << n} <> 0 THEN {t} ELSE 0 END" for n, t in enumerate(touching))]) + ")"


_BEHIND, _FACES = f"({voxels.EIGHTEEN} & ~code)", f"({voxels.FACES} & ~code)"
_PARTS = """SELECT (iz + 1048576) * 4398046511104 + (iy + 1048576) * 2097152 + ix + 1048576 AS vid, iz, iy, ix FROM solid"""
QUERIES = {f.__name__: f for f in (simple_voxels, thinned_volume, volume_nodes, volume_parts, volume_polylines)}
ORACLES = {
    "simple_voxels": using(
        f"""SELECT iz, iy, ix, code, code > 0 AND {_FACES} > 0 AND EXISTS (FROM fore f WHERE f.code = c.code AND f.g = c.code)
          AND EXISTS (FROM back b WHERE b.code = c.code AND b.g & {_FACES.replace("code", "c.code")} = {_FACES.replace("code", "c.code")}) AS simple FROM codes c""", True,
        solid=_SOLID, steps=_STEPS, codes=_CODES, kinds="SELECT DISTINCT code FROM codes",
        fore=f"SELECT code, code & -code AS g FROM kinds UNION SELECT code, {_spread('g', voxels.TOUCHING)} & code FROM fore",
        back=f"SELECT code, {_FACES} & -{_FACES} AS g FROM kinds UNION SELECT code, {_spread('g', voxels.BESIDE)} & {_BEHIND} FROM back",
    ),
    "volume_nodes": using("SELECT iz, iy, ix, bit_count(code)::BIGINT AS degree FROM codes WHERE bit_count(code) <> 2", solid=_SOLID, steps=_STEPS, codes=_CODES),
    "volume_parts": using(
        "SELECT p.iz, p.iy, p.ix, n, 1::BIGINT AS lines FROM (SELECT label, count(*) AS n FROM reach GROUP BY label) JOIN packed p ON p.vid = label", True,
        solid=_SOLID, packed=_PARTS,
        arcs="SELECT a.vid AS u, b.vid AS v FROM packed a JOIN packed b ON abs(a.iz - b.iz) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.ix - b.ix) <= 1 AND a.vid <> b.vid",
    ).replace(") SELECT p.iz", "), reach(vid, label) USING KEY (vid) AS (SELECT vid, vid FROM packed UNION SELECT e.v, min(r.label) FROM reach r JOIN arcs e ON e.u = r.vid JOIN recurring.reach o ON o.vid = e.v WHERE r.label < o.label GROUP BY e.v) SELECT p.iz"),
}
