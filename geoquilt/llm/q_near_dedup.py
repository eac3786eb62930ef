"""Query op5: near-duplicate classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquilt.llm.near_dedup import classes
from geoquilt.storage import table


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_class and kept of every document."""
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_class", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s, count(*) AS c
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0) GROUP BY ALL),
size AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS common
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE common >= 0.8 * (x.n + y.n - common)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN sym l ON l.a = r.b),
class AS (SELECT a AS doc_id, min(b) AS class_id, count(*)::BIGINT AS n_class FROM reach GROUP BY a)
SELECT doc_id, class_id, n_class, doc_id = class_id AS kept FROM class
"""
