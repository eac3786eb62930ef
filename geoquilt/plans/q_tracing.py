"""Queries of traced rasters, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquilt.operators import graphs, raster, skeletons
from geoquilt.plans.oracles import MASK, using
from geoquilt.sources import views
from geoquilt.storage import stored


def pixel_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges between neighbouring pixels of the mask's contour."""
    return skeletons.pixel_edges(raster.contour(views.mask(s, d)))


def traced_counts(s: SparkSession, d: str) -> DataFrame:
    """Polylines of the mask's contour, their edges, the pixels within them, and the closed loops."""
    edges = stored(skeletons.pixel_edges(raster.contour(views.mask(s, d))), "contour-edges")
    line = stored(skeletons.traced(edges), "contour-lines")
    each = line.groupBy("start", "end").agg((F.count("*") - 1).alias("edges"))
    total = each.agg(F.count("*").alias("polylines"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"))
    inner = graphs.degrees(edges).where("degree = 2").select(F.col("vid").alias("two"))
    within = line.join(inner, F.col("vid") == F.col("two"), "left_semi").agg(F.countDistinct("vid").alias("within"))
    rings = skeletons.loops(edges).agg(F.count("*").alias("loops"), F.coalesce(F.sum("n"), F.lit(0)).alias("loop_pixels"))
    return total.crossJoin(within).crossJoin(rings)  # one row each


_EDGE = "SELECT row, col FROM mask m WHERE NOT (" + " AND ".join(f"EXISTS (FROM mask n WHERE n.row = m.row + ({a}) AND n.col = m.col + ({b}))" for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))) + ")"
_LINKS = """SELECT (a.row << 32) + a.col AS u, (b.row << 32) + b.col AS v FROM edge a JOIN edge b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (b.row, b.col) > (a.row, a.col)
  WHERE a.row = b.row OR a.col = b.col OR NOT (EXISTS (FROM edge x WHERE x.row = a.row AND x.col = b.col) OR EXISTS (FROM edge y WHERE y.row = b.row AND y.col = a.col))"""
_RASTER = {"mask": MASK, "edge": _EDGE, "links": _LINKS}
QUERIES = {f.__name__: f for f in (pixel_edges, traced_counts)}
ORACLES = {
    "pixel_edges": using("SELECT least(u, v) AS u, greatest(u, v) AS v FROM links", **_RASTER),
    "traced_counts": using(
        """SELECT ((SELECT coalesce(sum(n), 0) FROM degree WHERE n <> 2) // 2 + (SELECT count(*) FROM rings))::BIGINT AS polylines, (SELECT count(*) FROM links) AS edges,
          (SELECT count(*) FROM degree WHERE n = 2) AS within, (SELECT count(*) FROM rings) AS loops, (SELECT coalesce(sum(n), 0) FROM rings)::BIGINT AS loop_pixels""", True,
        **_RASTER, arcs="SELECT u, v FROM links UNION ALL SELECT v, u FROM links", degree="SELECT u AS vid, count(*) AS n FROM arcs GROUP BY u",
        reach="SELECT vid AS a, vid AS b FROM degree UNION SELECT r.a, e.v FROM reach r JOIN arcs e ON e.u = r.b",
        parts="SELECT a AS vid, min(b) AS part FROM reach GROUP BY a",
        rings="SELECT part, count(*) AS n FROM parts JOIN degree USING (vid) GROUP BY part HAVING min(degree.n) = 2 AND max(degree.n) = 2",
    ),
}
