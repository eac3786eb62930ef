"""Query op2: every page's URL judged by nested prefix rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoquilt.storage import table
from geoquilt.llm.url_rules import judge, rules_frame

RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark, RULES))


SQL = r"""
WITH rules(action, host, path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k
  FROM rest),
fits AS (
  SELECT k, p.path, u.host || u.path AS rule, action, row_number() OVER (PARTITION BY k ORDER BY length(u.host || u.path) DESC, length(u.host) DESC) AS o
  FROM parts p JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path))
SELECT page_id, host, p.path AS path, rule, coalesce(action, 'allow') AS verdict
FROM parts p LEFT JOIN (SELECT * FROM fits WHERE o = 1) f USING (k)
"""
