"""Query op8: every message without quotes, linked to what it answers, in reply order.

The given messages hold no quotes; ``quoted_replies`` derives, for every message
after the first, a reply that quotes it and the one before, and links those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoquilt.llm.quotes import link_quotes, reply_order
from geoquilt.storage import table


def op8_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, body, n_quoted, max_level, parent, thread, depth and reply_no of every message."""
    return reply_order(link_quotes(table(spark, sf_dir, "conversations")))


def replies(messages: DataFrame) -> DataFrame:
    """A reply to every message that follows another of its conversation, quoting both; half stand in another conversation."""
    one = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("role").alias("role"), F.max(F.coalesce("text", F.lit(""))).alias("text"))
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    quote = lambda text, mark: F.regexp_replace(text, "(?m)^", mark)
    answer = F.concat(quote(F.col("before"), "> > "), F.lit("\n"), quote(F.col("text"), ">"), F.lit("\nreply to "), F.col("turn").cast("string"))
    conv = F.when(F.col("turn") % 2 == 0, F.col("conv_id")).otherwise(F.col("conv_id") + 1_000_000_000)
    return one.withColumn("before", before).where("before IS NOT NULL").select(conv.alias("conv_id"), (F.col("turn") + 1_000_000).alias("turn"), "role", answer.alias("text"))


def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of all messages and their derived replies."""
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    linked = link_quotes(messages.unionByName(replies(messages), allowMissingColumns=True))
    return linked.withColumn("body", F.md5("body"))


def _sql(source: str, body: str) -> str:
    return rf"""
WITH RECURSIVE {source},
m AS (SELECT conv_id, turn, role, row_number() OVER () AS k, string_split(coalesce(text, ''), chr(10)) AS ls FROM messages),
l AS (
  SELECT k, conv_id, turn, i, ls[i] AS line, regexp_extract(ls[i], '^[ \t>]*') AS prefix
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM m)),
p AS (
  SELECT *, length(regexp_replace(prefix, '[^>]', '', 'g')) AS level, substr(line, length(prefix) + 1) AS body FROM l),
b AS (
  SELECT *, CASE WHEN lag(level) OVER (PARTITION BY k ORDER BY i) IS NOT DISTINCT FROM level THEN '' ELSE chr(1) END || body AS piece FROM p),
passages AS (
  SELECT k, conv_id, turn, level, translate(regexp_replace(string_agg(piece, ' ' ORDER BY i), '[ \t\r]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM b GROUP BY ALL),
s AS (
  SELECT conv_id, turn, level, s, in_line FROM (
    SELECT conv_id, turn, level, trim(unnest(regexp_extract_all(t, '[^.!?\x01]+[.!?]*')), ' ') AS s, false AS in_line FROM passages
    UNION ALL SELECT conv_id, turn, level, trim(translate(regexp_replace(body, '[ \t\r]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' '), true FROM p)
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND (length(s) >= 16 OR regexp_matches(s, '[\p{{L}}\p{{N}}]'))),
said AS (SELECT s, conv_id, min(turn) AS turn FROM s WHERE level = 0 GROUP BY s, conv_id),
anywhere AS (SELECT s, min({{'c': conv_id, 't': turn}}) AS there FROM said WHERE length(s) >= 16 GROUP BY s),
quoted AS (
  SELECT conv_id, turn, level, s, count(*) FILTER (NOT in_line) * length(s) AS chars, CASE WHEN count(*) FILTER (NOT in_line) > 0 THEN 0 ELSE length(s) END AS line_chars
  FROM s WHERE level > 0 GROUP BY conv_id, turn, level, s),
origins AS (
  SELECT q.conv_id, q.turn, q.level, q.chars, q.line_chars,
         CASE WHEN d.turn < q.turn THEN {{'c': d.conv_id, 't': d.turn}}
              WHEN a.there < {{'c': q.conv_id, 't': q.turn}} THEN a.there END AS origin
  FROM quoted q LEFT JOIN said d ON d.s = q.s AND d.conv_id = q.conv_id LEFT JOIN anywhere a ON a.s = q.s),
sums AS (SELECT conv_id, turn, level, origin, sum(chars) AS chars, sum(line_chars) AS line_chars FROM origins WHERE origin IS NOT NULL GROUP BY ALL),
parents AS (
  SELECT conv_id, turn, origin.c AS pc, origin.t AS pt
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, chars DESC, line_chars DESC, origin DESC) AS o FROM sums) WHERE o = 1),
up AS (
  SELECT conv_id, turn, pc, pt, 1 AS far FROM parents
  UNION ALL SELECT u.conv_id, u.turn, p.pc, p.pt, u.far + 1 FROM up u JOIN parents p ON p.conv_id = u.pc AND p.turn = u.pt),
roots AS (SELECT conv_id, turn, min({{'c': pc, 't': pt}}) AS root, max(far) AS depth FROM up GROUP BY ALL),
tree AS (
  SELECT conv_id, turn, root, depth FROM roots
  UNION SELECT root.c, root.t, root, 0 FROM roots),
ranks AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, conv_id, turn) - 1 AS reply_no FROM tree),
rows AS (
  SELECT k, string_agg(line, chr(10) ORDER BY i) FILTER (level = 0) AS body, count(*) FILTER (level > 0) AS n_quoted, max(level) AS max_level
  FROM p GROUP BY k)
SELECT m.conv_id, m.turn, m.role, {body} AS body, r.n_quoted::BIGINT AS n_quoted, r.max_level::INT AS max_level,
       pc AS parent_conv, pt AS parent_turn, coalesce(root.c, m.conv_id) AS thread_conv, coalesce(root.t, m.turn) AS thread_turn,
       coalesce(depth, 0)::BIGINT AS depth, coalesce(reply_no, 0)::BIGINT AS reply_no
FROM m JOIN rows r USING (k) LEFT JOIN parents q ON q.conv_id = m.conv_id AND q.turn = m.turn
LEFT JOIN ranks t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""


SQL = _sql("messages AS (SELECT conv_id, turn, role, text FROM conversations)", "coalesce(r.body, '')")
DERIVED_SQL = _sql(
    """one AS (
  SELECT conv_id, turn, max(role) AS role, max(coalesce(text, '')) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
followed AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM one),
messages AS (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT CASE WHEN turn % 2 = 0 THEN conv_id ELSE conv_id + 1000000000 END, turn + 1000000, role,
         '> > ' || replace(before, chr(10), chr(10) || '> > ') || chr(10) || '>' || replace(text, chr(10), chr(10) || '>') || chr(10) || 'reply to ' || turn
  FROM followed WHERE before IS NOT NULL)""",
    "md5(coalesce(r.body, ''))",
)
