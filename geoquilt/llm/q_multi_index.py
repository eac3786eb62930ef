"""Query op9: near-duplicate links of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoquilt.llm.multi_index import classes
from geoquilt.storage import table


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return classes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
ok AS (
  SELECT vec_id, v FROM e
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM e
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
part AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN part p ON p.a = vec_id LEFT JOIN degree d ON d.a = vec_id
"""
