"""Query op6: benchmark windows in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquilt.llm.decontam import SLOP, contamination
from geoquilt.storage import table


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    And n_near: the windows of which every word stands within one word of its place.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), slop=SLOP, spans=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "n_near",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT k, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lengths WHERE len(w) >= n)),
hits AS (SELECT k, item_id, i, bw.n AS n FROM dw JOIN bw USING (n, phrase)),
items AS (
  SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY k),
tokens AS (SELECT k, p, w[p] AS t FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
terms AS (
  SELECT phrase, o, string_split(phrase, ' ')[o] AS t, len(string_split(phrase, ' ')) AS n
  FROM (SELECT phrase, unnest(range(1, len(string_split(phrase, ' ')) + 1)) AS o FROM (SELECT DISTINCT phrase FROM bw))),
seen AS (SELECT t, count(*) AS cf FROM tokens GROUP BY t),
anchors AS (SELECT phrase, n, arg_min(t, cf) AS t, arg_min(o, cf) AS o FROM terms JOIN seen USING (t) GROUP BY phrase, n HAVING count(*) = n),
starts AS (
  SELECT DISTINCT k, phrase, n, p - o + s AS a
  FROM tokens JOIN anchors USING (t), (SELECT unnest([-1, 0, 1]) AS s)),
near AS (
  SELECT DISTINCT k, phrase FROM (
    SELECT s.k, s.phrase, s.a, s.n FROM starts s JOIN terms u ON u.phrase = s.phrase
    JOIN (SELECT k, t, p + e AS p FROM tokens, (SELECT unnest([-1, 0, 1]) AS e)) x ON x.k = s.k AND x.t = u.t AND x.p = s.a + u.o
    GROUP BY s.k, s.phrase, s.a, s.n HAVING count(DISTINCT u.o) = s.n)),
nears AS (SELECT k, count(*) AS n_near FROM near GROUP BY k),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hits) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN items USING (k) LEFT JOIN words USING (k) LEFT JOIN nears USING (k)
"""
