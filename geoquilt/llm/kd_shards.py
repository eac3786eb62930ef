"""Shards as leaves of a k-d tree over document metadata.

Every dimension of the metadata is laid on a grid of ``CELLS`` cells over its whole
extent.  A node that stands for several leaves is cut across the dimension in which
it spans the most cells, where the sizes of its rows reach the share of the leaves
to the left; the rows of the cell in which that place lies are dealt by a hash, so
that a value which very many rows share is cut like any other.

A level costs a few passes over a stored table of some 100 bytes a row (texts are
read once): one groups sizes by node, dimension and cell, which gives the extents and
the weighted medians of all nodes at once; where the cell of a median holds many rows,
further ones group these by the next digits of their hash; the last sorts the few
rows that are left.  No task holds a node, and no node's rows are collected.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquilt.storage import discard, stored

#: Cells of a dimension, digits of the hash by which the rows of a cell are split further, rows that are left to a sort.
CELLS, DIGITS, OPEN_ROWS = 4096, 3, 512
#: Hex digits of the hash of a row's content, then of its number, which only tells equal rows apart.
CONTENT_DIGITS, NUMBER_DIGITS = 24, 12
#: Rows numbered together within a shard; a level has no more nodes than shards, and up to so many are broadcast.
ROWS_PER_BUCKET, BROADCAST_NODES = 1024, 100_000
ROW_BYTES = 8
DIMENSIONS = ("lang", "source", "size", "doc_id")


def _text_hex(value: Column) -> Column:
    return F.hex(F.encode(F.coalesce(value, F.lit("")), "UTF-8"))


def _common_prefix(low: str, high: str) -> int:
    """Number of leading hex digits, in whole bytes, that all strings between the two share."""
    n = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    return n - n % 2


def text_place(value: Column, prefix: int) -> Column:
    """Order-preserving number of a string: its six bytes behind ``prefix`` hex digits; null counts as empty."""
    digits = F.rpad(F.substring(_text_hex(value), prefix + 1, 12), 12, "0")
    return F.conv(digits, 16, 10).cast("double")


def size_place(size: Column) -> Column:
    """Fourth root of a size, so that a few very long texts do not take up the whole extent."""
    return F.sqrt(F.sqrt(size.cast("double")))


def _cell(place: Column, low: float, high: float) -> Column:
    if not high > low:
        return F.lit(0)
    return F.least(F.floor((place - low) / (high - low) * CELLS), F.lit(CELLS - 1)).cast("int")


def metadata_cells(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, size, text_crc32, cells, h) of every row of ``docs(doc_id, text, lang, source)``.

    ``size`` is the UTF-8 bytes of the text plus 8, a null text has none and the checksum
    of no bytes; ``cells`` are the grid cells of DIMENSIONS (null ids stand at 0, other
    nulls count as empty); ``h`` orders rows by their content, equal ones by their number.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    content = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), F.md5(text)))
    rows = docs.select(
        "doc_id", "lang", "source", (F.length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.concat(F.substring(content, 1, CONTENT_DIGITS), F.substring(F.md5(F.monotonically_increasing_id().cast("string")), 1, NUMBER_DIGITS)).alias("h"),
    )
    rows = stored(rows, "kd-rows")
    ends = rows.agg(*[f(c).alias(f"{n}_{k}") for k, c in enumerate((_text_hex(F.col("lang")), _text_hex(F.col("source")))) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    places = {
        name: text_place(F.col(name), _common_prefix(ends[f"lo_{k}"] or "", ends[f"hi_{k}"] or "")) for k, name in enumerate(("lang", "source"))
    } | {"size": size_place(F.col("size")), "doc_id": F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))}
    extents = rows.agg(*[f(places[d]).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    cells = F.array(*[_cell(places[d], extents[f"lo_{d}"] or 0.0, extents[f"hi_{d}"] or 0.0) for d in DIMENSIONS])
    out = stored(rows.select("doc_id", "size", "text_crc32", "h", cells.alias("cells")), "kd-cells")
    discard(rows)
    return out


def _opened(sums: DataFrame, order: str) -> DataFrame:
    """Of each node's ordered ``sums``, the first that reaches past its target, and the size before it.

    A row goes left if half its size or more lies left of the target, so all rows
    before that sum go left, all behind it go right, and only its own are open.
    """
    upto = Window.partitionBy("first").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("upto", F.col("base") + F.sum("bytes").over(upto)).where(F.col("leaves") * F.col("upto") > F.col("left") * F.col("total"))
    at = F.min(F.struct(order, "upto", "bytes", "n")).alias("at")
    keep = [c for c in ("first", "leaves", "left", "total", "dim", "cell", "prefix") if c in sums.columns and c != order]
    return run.groupBy(*keep).agg(at).select(
        *keep, F.col(f"at.{order}").alias(order), (F.col("at.upto") - F.col("at.bytes")).alias("base"), F.col("at.n").alias("open_rows")
    )


def _medians(rows: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """Cut of every node of ``rows(first, leaves, size, cells, h)`` with several leaves, and the stored plan it reads.

    A cut is (first, left, dim, cell, cut): rows of lesser ``cell`` in dimension
    ``dim`` go left, and those of that cell with ``h`` up to ``cut``.  ``few``
    says that the nodes may be broadcast.
    """
    inner = rows.where("leaves > 1")
    by_cell = inner.select("first", "leaves", "size", F.posexplode("cells").alias("dim", "cell"))
    by_cell = stored(by_cell.groupBy("first", "leaves", "dim", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "kd-histogram")
    spans = by_cell.groupBy("first", "leaves", "dim").agg((F.max("cell") - F.min("cell")).alias("span"), F.sum("bytes").alias("total"))
    widest = spans.groupBy("first").agg(F.max_by(F.struct("dim", "total"), F.struct("span", -F.col("dim"))).alias("w"))
    widest = widest.select(F.col("first").alias("w_first"), F.col("w.dim").alias("w_dim"), F.col("w.total").alias("total"))
    sums = by_cell.join(widest, (F.col("first") == F.col("w_first")) & (F.col("dim") == F.col("w_dim"))).select(
        "first", "leaves", F.floor(F.col("leaves") / 2).cast("int").alias("left"), "total", "dim", "cell", F.lit(0).cast("long").alias("base"), "bytes", "n"
    )
    plan = stored(_opened(sums, "cell").withColumn("prefix", F.lit("")), "kd-plan")
    discard(by_cell)
    digits = 0

    def open_rows() -> DataFrame:
        p = plan.withColumnsRenamed({"first": "p_first", "leaves": "p_leaves"})
        p = F.broadcast(p) if few else p
        here = (F.col("first") == F.col("p_first")) & (F.get("cells", F.col("dim")) == F.col("cell")) & F.startswith("h", F.col("prefix"))
        return inner.join(p, here).drop("p_first", "p_leaves")

    while digits < CONTENT_DIGITS + NUMBER_DIGITS and (plan.agg(F.max("open_rows")).first()[0] or 0) > OPEN_ROWS:
        digits += DIGITS
        deeper = open_rows().withColumn("prefix", F.substring("h", 1, digits))
        sums = deeper.groupBy("first", "leaves", "left", "total", "dim", "cell", "base", "prefix").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        before, plan = plan, stored(_opened(sums, "prefix"), "kd-plan")
        discard(before)
    upto = Window.partitionBy("first").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    ranked = open_rows().withColumn("upto", F.col("base") + F.sum("size").over(upto))
    goes_left = F.col("leaves") * (2 * F.col("upto") - F.col("size")) <= 2 * F.col("left") * F.col("total")
    last = F.coalesce(F.max(F.when(goes_left, F.col("h"))), F.first("prefix")).alias("cut")  # lesser prefixes go left in any case
    return ranked.groupBy("first", "left", "dim", "cell").agg(last), plan


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs(doc_id, text, lang, source)``.

    ``shards`` is the number of leaves, or follows from ``target_bytes``.  Leaves are
    numbered from left to right.  Sizes of shards differ by about the size of a row at
    each level, whatever values, copies or null columns many rows share; rows equal in
    all columns are interchangeable.  Slots count from 0 within a shard, in the order
    of a hash.  With fewer rows than shards some stay empty; an empty table gives an
    empty result.  Texts of any length count whole, other columns are not carried.
    """
    rows = metadata_cells(docs)
    if shards is None:
        if not target_bytes:
            raise ValueError("give the number of shards or their bytes")
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    rows = rows.withColumns({"first": F.lit(0), "leaves": F.lit(shards)})
    largest = shards
    while largest > 1:
        cuts, plan = _medians(rows, shards <= BROADCAST_NODES)
        at = cuts.withColumnRenamed("first", "c_first")
        at = F.broadcast(at) if shards <= BROADCAST_NODES else at
        cell = F.get("cells", F.col("dim"))
        goes_left = (cell < F.col("c.cell")) | ((cell == F.col("c.cell")) & (F.col("h") <= F.col("cut")))
        moved = rows.join(at.alias("c"), F.col("first") == F.col("c_first"), "left").select(
            "doc_id", "size", "text_crc32", "h", "cells",
            F.when(F.col("c_first").isNull() | goes_left, F.col("first")).otherwise(F.col("first") + F.col("left")).alias("first"),
            F.when(F.col("c_first").isNull(), F.col("leaves")).when(goes_left, F.col("left")).otherwise(F.col("leaves") - F.col("left")).alias("leaves"),
        )
        before, rows = rows, stored(moved, "kd-nodes")
        discard(plan, before)
        largest -= largest // 2
    return _slots(rows.withColumnRenamed("first", "shard"))


def _slots(rows: DataFrame) -> DataFrame:
    """Numbers from 0 within each shard, in the order of ``h``: bucket counts are summed up, rows numbered in their bucket."""
    buckets = max(1, -(-rows.count() // ROWS_PER_BUCKET))
    prefix = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    dealt = rows.withColumn("bucket", F.floor(prefix * buckets / F.lit(1 << 32)).cast("long"))
    before = Window.partitionBy("b_shard").orderBy("b_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(F.col("shard").alias("b_shard"), F.col("bucket").alias("b_bucket")).agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h")) - 1
    joined = dealt.withColumn("inside", inside).join(starts, (F.col("shard") == F.col("b_shard")) & (F.col("bucket") == F.col("b_bucket")))
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"))
