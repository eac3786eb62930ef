"""URL filters: a sort-merge range join between URLs and nested prefix rules.

A rule (host, path) covers a prefix in two orders: its host and all subdomains
are an interval of reversed hosts, and the paths that start with its path are an
interval of paths.  Each order is swept once.  First the distinct hosts meet the
distinct rule hosts, which gives every host the stack of rule hosts around it
(at most its number of labels); then each (rule host, path) meets the path
prefixes of that rule host, and the innermost prefix on the stack is the longest
rule of that host.  The longest rule over the stack of hosts decides.

Only DataFrame functions are used.  Both sides of a sweep are dealt into key
ranges; cut points come from a bounded sample of keys chosen by hash, so they
steer the balance and never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoquilt.storage import range_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys per range, ranges at most, sampled keys per range, and bytes of a cut point.
ROWS_PER_RANGE, MAX_RANGES, SAMPLE_PER_RANGE, CUT_BYTES = 256, 16_384, 8, 256


def url_host(url: Column) -> Column:
    """Host of ``url``, A-Z lower-cased: what follows the first ``://`` up to / ? # or the end."""
    return F.translate(_part(url, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """Path of ``url``: what follows its host up to ? # or the end."""
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", group)).otherwise(F.lit(""))


def reversed_host(host: Column) -> Column:
    """Canonical key: labels from the last to the first, each closed by a dot, as bytes."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")).cast("binary")


def prefix_end(key: Column) -> Column:
    """The least key above all that start with ``key``: UTF-8 holds no byte 0xFF."""
    return F.concat(key, F.unhex(F.lit("FF")))


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (action, host, path) as a DataFrame."""
    rows = [F.struct(*[F.lit(v).alias(k) for k, v in zip(("action", "host", "path"), r, strict=True)]) for r in rules]
    if not rows:
        return spark.createDataFrame([], "action string, host string, path string")
    return spark.range(1).select(F.inline(F.array(*rows)))


def _cut_points(points: DataFrame, intervals: DataFrame) -> list[bytes]:
    keys = points.select("key").unionByName(intervals.select(F.col("lo").alias("key"))).where("key IS NOT NULL")
    ranges = min(MAX_RANGES, math.ceil(keys.count() / ROWS_PER_RANGE))
    if ranges <= 1:
        return []
    short = keys.select(F.substring("key", 1, CUT_BYTES).alias("key")).distinct()
    sample = short.orderBy(F.xxhash64("key"), "key").limit(ranges * SAMPLE_PER_RANGE).collect()
    ordered = sorted(bytes(r["key"]) for r in sample)
    return sorted({ordered[i * len(ordered) // ranges] for i in range(1, ranges)})


def sweep(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """``points`` with ``stack``: the ids of the intervals around ``key``, outermost first.

    ``intervals(id, lo, hi)`` are half-open, distinct, and nested or disjoint.
    An interval is copied to each key range that it meets.  Within a range its
    intervals are folded in the order of their start, with a stack of those still
    open, into segments of constant stack; segments and points are then merged in
    key order.  Rows with a null key, and those outside all intervals, get an
    empty stack.
    """
    cuts = _cut_points(points, intervals)
    where = lambda c: range_of(F.col(c), cuts, lambda x: F.lit(bytearray(x)))
    held = intervals.select(
        "id", "lo", "hi", F.explode(F.sequence(where("lo"), where("hi"))).alias("range")
    ).groupBy("range").agg(F.array_sort(
        F.collect_list(F.struct("lo", "hi", "id")),
        lambda a, b: F.when(a["lo"] < b["lo"], -1).when(a["lo"] > b["lo"], 1)
        .when(a["hi"] > b["hi"], -1).when(a["hi"] < b["hi"], 1).otherwise(0),
    ).alias("held"))
    item = held.schema["held"].dataType.simpleString()
    id_type = intervals.schema["id"].dataType.simpleString()
    ids = lambda stack: F.transform(stack, lambda s: s["id"])

    def closed(stack: Column, ending: Column) -> Column:
        """Segments that begin where the intervals of ``ending`` end, innermost first."""
        return F.transform(
            F.reverse(ending),
            lambda e: F.struct(e["hi"].alias("key"), ids(F.filter(stack, lambda s: s["hi"] > e["hi"])).alias("stack")),
        )

    def step(acc: Column, x: Column) -> Column:
        ending = F.filter(acc["stack"], lambda s: s["hi"] <= x["lo"])
        stack = F.concat(F.filter(acc["stack"], lambda s: s["hi"] > x["lo"]), F.array(x))
        opened = F.struct(x["lo"].alias("key"), ids(stack).alias("stack"))
        segments = F.concat(acc["segments"], closed(acc["stack"], ending), F.array(opened))
        return F.struct(stack.alias("stack"), segments.alias("segments"))

    start = F.struct(
        F.array().cast(item).alias("stack"),
        F.array().cast(f"array<struct<key:binary,stack:array<{id_type}>>>").alias("segments"),
    )
    folded = F.aggregate(
        "held", start, step, lambda acc: F.concat(acc["segments"], closed(acc["stack"], acc["stack"]))
    )
    segments = held.select("range", F.posexplode(folded).alias("seq", "segment")).select(
        "range", F.col("segment.key").alias("key"), F.col("segment.stack").alias("open"), "seq", F.lit(False).alias("is_point")
    )
    rows = points.withColumns({"range": where("key"), "is_point": F.lit(True)})
    merged = rows.unionByName(segments, allowMissingColumns=True)
    order = Window.partitionBy("range").orderBy("key", "is_point", "seq")
    stack = F.last("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        merged.withColumn("stack", F.coalesce(stack, F.array().cast(f"array<{id_type}>")))
        .where("is_point")
        .select(*points.columns, "stack")
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Host, path, rule and verdict of every row of ``pages(page_id, url)``.

    Returns page_id, host, path, rule (``host/path`` text of the longest rule that
    fits, else null) and verdict (its action, else ``default``).  A rule fits its
    host and all subdomains if the path starts with the rule's path; rules of
    equal length go by the longer host, and of one rule given with two actions
    the block holds.  Very long urls are keyed whole; only cut points between key
    ranges are shortened.  A null url or one without ``://`` has an empty host and
    path and no rule; rules with a null or empty host never fit, a null rule path
    is the empty prefix.  Every row of ``pages`` is kept, repeated ones too; with
    no rules all get ``default``.
    """
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    known = rules.where("host IS NOT NULL AND host <> ''").select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "action"
    ).groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))
    known = known.withColumn("node", reversed_host(F.col("rule_host")))
    # First order: hosts.  One row per distinct host, however many pages it has.
    nodes = known.select("node").distinct().select(
        F.col("node").alias("id"), F.col("node").alias("lo"), prefix_end(F.col("node")).alias("hi")
    )
    places = parts.where("host <> ''").select("host", "path").distinct()
    hosts = places.select("host").distinct().withColumn("key", reversed_host(F.col("host")))
    around = sweep(hosts, nodes).where(F.size("stack") > 0).select(F.col("host").alias("swept_host"), "stack")
    # Second order: paths below each rule host.
    sep = F.lit("\u0001").cast("binary")
    below = lambda node, path: F.concat(node, sep, path.cast("binary"))
    targets = places.join(around, F.col("host") == F.col("swept_host")).select(
        "host", "path", F.explode("stack").alias("node")
    ).select("host", "path", below(F.col("node"), F.col("path")).alias("key"))
    prefix = below(F.col("node"), F.col("rule_path"))
    text = F.concat("rule_host", "rule_path")
    prefixes = known.select(
        F.struct(F.length(text).alias("n"), F.length("rule_host").alias("n_host"), text.alias("rule"), "action").alias("id"),
        prefix.alias("lo"), prefix_end(prefix).alias("hi"),
    )
    best = (
        sweep(targets, prefixes)
        .where(F.size("stack") > 0)
        .groupBy(F.col("host").alias("best_host"), F.col("path").alias("best_path"))
        .agg(F.max(F.element_at("stack", -1)).alias("best"))
    )
    same = (F.col("host") == F.col("best_host")) & (F.col("path") == F.col("best_path"))
    return parts.join(best, same, "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
