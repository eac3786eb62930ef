"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquilt.storage import discard, stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first())


def _stars(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """The larger (or not larger) neighbours of every node hooked onto its least one, and the stored least neighbours.

    Least neighbours are pre-aggregated and joined back, so a node with very
    many edges is one row on one side of a join that Spark can split.
    """
    # rows (u, v) with u > v; a large star looks at all neighbours, a small one at the smaller
    both = edges.union(edges.select(F.col("v"), F.col("u"))) if large else edges
    both = both.toDF("n", "w")
    least = both.groupBy(F.col("n").alias("m_n")).agg(F.least(F.min("w"), F.first("n")).alias("m"))
    least = stored(least, "least")  # else the join shares the sum's exchange, which Spark does not split
    joined = both.join(least, F.col("n") == F.col("m_n"))
    if large:
        hooked = joined.where(F.col("w") > F.col("n")).select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        hooked = joined.select(F.col("w").alias("u"), F.col("m").alias("v")).union(least.select("m_n", "m"))
    return hooked.where(F.col("u") != F.col("v")).distinct(), least


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges(u, v)``; the component is its least node.

    Each round is stored in the shared folder, so that neither lineage nor the
    loss of an executor grows with the rounds; it ends when a round changes
    nothing.  Loops and repeated edges are harmless, nodes may be of any ordered
    type, an empty table gives an empty result.
    """
    u, v = F.col("u"), F.col("v")
    edges = stored(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    mark = _mark(edges)
    for _ in range(max_rounds):
        first, least = _stars(edges, True)
        second, least2 = _stars(first, False)
        before, edges = edges, stored(second, "edges")
        discard(before, least, least2)
        if mark == (mark := _mark(edges)):
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.toDF("node", "component").union(roots.select("node", F.col("node").alias("component")))
