"""Queries of parts and holes of the mask, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoquilt.operators import parts
from geoquilt.plans.oracles import MASK, using
from geoquilt.sources import views


def largest_part(s: SparkSession, d: str) -> DataFrame:
    return parts.largest_part(views.mask(s, d))


def filled_mask(s: SparkSession, d: str) -> DataFrame:
    return parts.fill_holes(views.mask(s, d))


def part_contour(s: SparkSession, d: str) -> DataFrame:
    return parts.part_contour(views.mask(s, d))


def _flood(cells: str) -> dict[str, str]:
    """The cells of the padded box that the outside reaches along sides."""
    grid = f"SELECT r AS row, c AS col FROM (SELECT unnest(range(min(row) - 1, max(row) + 2)) AS r FROM {cells}), (SELECT unnest(range(min(col) - 1, max(col) + 2)) AS c FROM {cells})"
    return {
        "free": f"SELECT row, col FROM ({grid}) g WHERE NOT EXISTS (FROM {cells} m WHERE m.row = g.row AND m.col = g.col)",
        "outside": "SELECT min(row) AS row, min(col) AS col FROM free UNION SELECT f.row, f.col FROM outside o JOIN free f ON abs(f.row - o.row) + abs(f.col - o.col) = 1",
        "filled": f"SELECT row, col FROM {cells} UNION ALL SELECT row, col FROM free WHERE (row, col) NOT IN (SELECT (row, col) FROM outside)",
    }


_PARTS = {
    "mask": MASK,
    "reach": "SELECT row AS r, col AS c, row, col FROM mask UNION SELECT a.r, a.c, m.row, m.col FROM reach a JOIN mask m ON abs(m.row - a.row) <= 1 AND abs(m.col - a.col) <= 1",
    "named": "SELECT r AS row, c AS col, min(row * 1000000 + col) AS part FROM reach GROUP BY r, c",
    "biggest": "SELECT row, col FROM named WHERE part = (SELECT part FROM named GROUP BY part ORDER BY count(*) DESC, part LIMIT 1)",
}
_INNER = " AND ".join(f"EXISTS (FROM filled n WHERE n.row = f.row + ({a}) AND n.col = f.col + ({b}))" for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)))
QUERIES = {f.__name__: f for f in (largest_part, filled_mask, part_contour)}
ORACLES = {
    "largest_part": using("SELECT row, col FROM biggest", True, **_PARTS),
    "filled_mask": using("SELECT row, col FROM filled", True, mask=MASK, **_flood("mask")),
    "part_contour": using(f"SELECT row, col FROM filled f WHERE NOT ({_INNER})", True, **_PARTS, **_flood("biggest")),
}
