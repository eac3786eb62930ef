"""Queries of shortest ways from many sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquilt.functions.linalg import rounded
from geoquilt.operators import geodesic, graphs, spatial
from geoquilt.plans.oracles import ARCS_09, using
from geoquilt.sources import views

REACH = 0.09


def _sources(s: SparkSession, d: str) -> DataFrame:
    """The first point of every cloud."""
    return views.points(s, d).groupBy("cloud").agg(F.min("pid").alias("vid")).select("vid")


def geodesic_owners(s: SparkSession, d: str) -> DataFrame:
    """Distance to and id of the nearest first point of a cloud, along edges between near points."""
    p, sources = views.points(s, d), _sources(s, d)
    firsts = p.join(sources, F.col("pid") == F.col("vid"), "left_semi").select(F.col("pid").alias("i"), *spatial.XYZ)
    near = spatial.radius_join(firsts, p.withColumnRenamed("pid", "j"), REACH).where("i <> j").select(F.col("i").alias("vid")).distinct()
    return graphs.near_ways(p, REACH, near, owners=True).select("vid", rounded(F.col("dist")).alias("dist"), F.col("tag").alias("owner"))


def geodesic_skeleton(s: SparkSession, d: str) -> DataFrame:
    """Edges of the skeleton of all height fields between their landmarks."""
    vertices, triangles = views.height_mesh(s, d)
    nodes, edges = geodesic.geodesic_skeleton(vertices, graphs.mesh_edges(triangles), vertices, 8)
    return edges


QUERIES = {f.__name__: f for f in (geodesic_owners, geodesic_skeleton)}
ORACLES = {
    "geodesic_owners": using(
        "SELECT vid, round(dist, 6) + 0.0::DOUBLE AS dist, owner FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY dist, owner) AS o FROM ways) WHERE o = 1", True, **ARCS_09,
        firsts="SELECT min(pid) AS f FROM points GROUP BY cloud HAVING min(pid) IN (SELECT u FROM arcs)",
        ways="SELECT 0 AS k, f AS vid, f AS owner, 0.0::DOUBLE AS dist FROM firsts UNION ALL SELECT k + 1, v, owner, min(dist + w) FROM ways JOIN arcs ON u = vid WHERE k < 60 GROUP BY 1, 2, 3",
    ),
}
