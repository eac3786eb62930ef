"""Query op10: every document mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquilt.llm.curriculum import mix
from geoquilt.storage import table


POSITIONS = ("first_position", "second_position", "third_position")


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its up to three training positions, range-sorted by the first (null last)."""
    mixed = mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken",
        *[F.get("placements", F.lit(e))["position"].alias(name) for e, name in enumerate(POSITIONS)],
    )
    keys = (F.col("first_position").asc_nulls_last(), F.col("doc_id"))
    return mixed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns(
        {name: F.round(name, 9) for name in POSITIONS}
    )


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ' ' || md5(coalesce(text, ''))) AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size::DOUBLE * 3 AS cap
  FROM sources),
ordered AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
         row_number() OVER (ORDER BY cap / w, k) AS o
  FROM weighed),
chosen AS (SELECT total, capped, open_w, o FROM ordered WHERE w * (total - capped) / open_w <= cap ORDER BY o LIMIT 1),
targets AS (
  SELECT a.source, a.k, a.source_size,
         CASE WHEN a.o < c.o THEN a.cap WHEN a.total = 0 THEN 0 ELSE a.w * (c.total - c.capped) / c.open_w END AS target
  FROM ordered a CROSS JOIN chosen c),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.k, floor(t.target + 0.5)::BIGINT AS wanted,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS first
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, greatest(least(size, wanted - first), 0) AS t0, greatest(least(size, wanted - first - source_size), 0) AS t1,
         greatest(least(size, wanted - first - 2 * source_size), 0) AS t2,
         CASE k % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS s,
         CASE k % 3 WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS slope,
         first / nullif(wanted, 0)::DOUBLE AS u, (first + source_size) / nullif(wanted, 0)::DOUBLE AS u1, (first + 2 * source_size) / nullif(wanted, 0)::DOUBLE AS u2
  FROM placed)
SELECT doc_id, size, source_size, target, (t0 + t1 + t2)::BIGINT AS taken,
       CASE WHEN t0 > 0 THEN round(2 * u / (s + sqrt(greatest(s * s + 2 * slope * u, 0))), 9) END AS first_position,
       CASE WHEN t1 > 0 THEN round(2 * u1 / (s + sqrt(greatest(s * s + 2 * slope * u1, 0))), 9) END AS second_position,
       CASE WHEN t2 > 0 THEN round(2 * u2 / (s + sqrt(greatest(s * s + 2 * slope * u2, 0))), 9) END AS third_position
FROM cut
"""
