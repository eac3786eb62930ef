"""Query op11: all documents in 24 shards of near equal sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquilt.llm.kd_shards import CELLS, CONTENT_DIGITS, kd_shards
from geoquilt.storage import table

SHARDS = 24


def op11_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; the law is ``bytes``."""
    found = kd_shards(table(spark, sf_dir, "documents"), SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _sql(shards: int) -> str:
    """The same tree, level by level, with a running sum over each node."""
    parts = [rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, encode(coalesce(text, '')) AS b FROM documents),
x AS (
  SELECT doc_id, octet_length(b)::BIGINT + 8 AS size, b, hex(encode(lang)) AS lh, hex(encode(source)) AS sh,
         left(md5(concat_ws(chr(31), coalesce(doc_id::VARCHAR, ''), lang, source, md5(b))), {CONTENT_DIGITS}) AS h, row_number() OVER () AS id
  FROM d),
ends AS (SELECT min(lh) AS l0, max(lh) AS l1, min(sh) AS s0, max(sh) AS s1 FROM x),
prefixes AS (
  SELECT (SELECT coalesce(max(i), 0) FROM range(0, 400, 2) r(i) WHERE i <= least(len(l0), len(l1)) AND left(l0, i) = left(l1, i)) AS lp,
         (SELECT coalesce(max(i), 0) FROM range(0, 400, 2) r(i) WHERE i <= least(len(s0), len(s1)) AND left(s0, i) = left(s1, i)) AS sp FROM ends),
places AS (
  SELECT id, doc_id, size, h, ('0x' || rpad(substr(lh, lp + 1, 12), 12, '0'))::BIGINT::DOUBLE AS p0,
         ('0x' || rpad(substr(sh, sp + 1, 12), 12, '0'))::BIGINT::DOUBLE AS p1,
         sqrt(sqrt(size::DOUBLE)) AS p2, coalesce(doc_id::DOUBLE, 0) AS p3
  FROM x CROSS JOIN prefixes),
n0 AS (
  SELECT id, doc_id, size, h, 0 AS first, {shards} AS leaves,
         {", ".join(f"coalesce(least(floor((p{k} - min(p{k}) OVER ()) / nullif(max(p{k}) OVER () - min(p{k}) OVER (), 0) * {CELLS}), {CELLS - 1}), 0)::INT AS c{k}" for k in range(4))}
  FROM places)"""]
    level, largest = 0, shards
    while largest > 1:
        widths = [f"max(c{k}) OVER n - min(c{k}) OVER n" for k in range(4)]
        parts.append(f"""
w{level} AS (
  SELECT *, leaves // 2 AS lefts, sum(size) OVER n AS total, list_position([{", ".join(widths)}], greatest({", ".join(widths)})) AS dim
  FROM n{level} WINDOW n AS (PARTITION BY first)),
r{level} AS (
  SELECT *, sum(size) OVER (PARTITION BY first ORDER BY [c0, c1, c2, c3][dim], h, id ROWS UNBOUNDED PRECEDING) AS upto FROM w{level}),
g{level} AS (SELECT *, leaves = 1 OR leaves * (2 * upto - size) <= 2 * lefts * total AS goes_left FROM r{level}),
n{level + 1} AS (
  SELECT id, doc_id, size, h, CASE WHEN goes_left THEN first ELSE first + lefts END AS first,
         CASE WHEN leaves = 1 THEN 1 WHEN goes_left THEN lefts ELSE leaves - lefts END AS leaves, c0, c1, c2, c3
  FROM g{level})""")
        level, largest = level + 1, largest - largest // 2
    return ",".join(parts) + f""",
slots AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY h, id) - 1 AS slot FROM n{level}),
crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
text_bytes AS (SELECT id, list_transform(regexp_extract_all(hex(b), '..'), lambda p: ('0x' || p)::BIGINT) AS v FROM x),
crcs AS (
  SELECT id, xor(list_reduce(list_prepend(4294967295, v), lambda c, e: xor(c >> 8, t[(xor(c, e) & 255) + 1])), 4294967295) AS text_crc32
  FROM text_bytes CROSS JOIN crc_table)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, first::INT AS shard, slot::BIGINT AS slot, NULL::INT AS grown_shard
FROM slots JOIN crcs USING (id)"""


SQL = _sql(SHARDS)
