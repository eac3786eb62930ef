"""Query op1: every page written to WARC archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoquilt.storage import shared_dir, table
from geoquilt.llm.warc import read_archives, write_archives


def op1_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as the archives have them."""
    folder = shared_dir(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM p),
e AS (
  SELECT page_id, payload_bytes,
         translate(upper(list_aggregate(list_transform(range(8), lambda i: to_base(('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT, 32, 4)), 'string_agg', '')),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM d),
r AS (
  SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS k,
         max(page_id) OVER (PARTITION BY payload_digest) AS leader
  FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN leader END AS refers_to
FROM r
"""
