"""Mixing sources to target weights with a time-varying curriculum.

Every source has a target (its weight's share of all words, capped by the number
of allowed epochs) and a weight schedule over training time.  The integral of
the schedule is the source's cumulative demand for words; inverting it at a
document's cumulative offset within its source gives the training position of
that document, and a range sort by position is the training order.

Cumulative offsets are needed for every document, also of a source that holds a
third of all rows, so the prefix sum has two levels: documents are dealt by hash
into buckets, the sums of (source, bucket) are accumulated in a small table, and
a window runs only inside one (source, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquilt.storage import stored

#: A word, which holds anything but ASCII white space, and the white space before it.
WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: For each weight the multipliers at the start and the end of training; their mean is 1.
TILTS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
MAX_EPOCHS = 3
#: Rows per bucket, and buckets at most.
ROWS_PER_BUCKET, MAX_BUCKETS = 512, 1 << 20


def word_count(text: Column) -> Column:
    """Number of words of ``text``; null has none.

    A word put last lets every match end in a word, and one character per word
    is kept, so a text of any length needs no list of its words.
    """
    words = F.length(F.regexp_replace(F.concat(text, F.lit(" x")), WORD, "x")) - 1
    return F.coalesce(words, F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """One row per source of ``sizes(source, source_size)``: rank, weight, target.

    Sources are ranked by code point with null last and take ``weights`` in turn.
    Targets share the sum of all sizes by weight, but none exceeds ``max_epochs``
    times its source's size; what is cut off is shared among the others by
    weight.  That fixpoint is found in one pass: sources reach their cap in the
    order of cap per weight, so the number of capped sources is the first at
    which the next one stays below its cap.  An empty or all-empty input has
    targets of 0.  The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    ranked = sizes.withColumn("source_rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % n + 1).cast("int"))
    )
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    everything = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    levelled = (
        ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        # the share of this source's weight if all before it, and only those, are capped
        .withColumn("share", F.col("weight") * (F.col("total") - F.col("capped")) / F.col("open_weight"))
        .withColumn("order", F.row_number().over(by_cap))
        .withColumn("fits", F.col("share") <= F.col("cap"))
    )
    first = F.min(F.when(F.col("fits"), F.struct("order", "total", "capped", "open_weight"))).over(everything)
    return levelled.withColumn("first", first).select(
        "source",
        "source_rank",
        "weight",
        "source_size",
        F.when(F.col("order") < F.col("first.order"), F.col("cap"))
        .when(F.col("total") == 0, F.lit(0.0))
        .otherwise(F.col("weight") * (F.col("first.total") - F.col("first.capped")) / F.col("first.open_weight"))
        .alias("target"),
    )


def demand_position(fraction: Column, start: Column, end: Column) -> Column:
    """Training time in [0, 1] at which a source has asked for ``fraction`` of its target.

    The schedule falls or rises in a line from ``start`` to ``end`` with mean 1, so
    cumulative demand is ``start*t + (end-start)*t*t/2``; this is its inverse, in
    the form that also holds for a constant schedule.
    """
    slope = end - start
    return 2 * fraction / (start + F.sqrt(F.greatest(start * start + 2 * slope * fraction, F.lit(0.0))))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    tilts: Sequence[tuple[float, float]] = TILTS,
    max_epochs: int = MAX_EPOCHS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Size, target and placements of every row of ``docs(doc_id, text, source)``.

    Returns doc_id, source, size, source_size, target, taken and placements, an
    array of (epoch, position, words) in training order; no other column of
    ``docs`` is carried.  Each source runs through its documents in the order of
    a hash of id and text as often as its target asks for; the last run stops inside a
    document, of which only the first words are taken, so a source's taken words
    are its target rounded to a whole number.  Documents that are never reached,
    or have no words, have taken 0 and no placements.  Null texts have size 0, a
    null source is a source of its own, rows with equal or null doc_id are kept
    apart (rows equal in id and text are interchangeable) and dealt by their text,
    so that no id fills a bucket.  Texts of any length are counted whole.  Reruns agree.

    Texts are read once: id, source, size and hash of every row are stored, and
    both the bucket sums and the windows start from them.
    """
    sized = docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.md5(F.coalesce("text", F.lit(""))))).alias("h"),
    )
    sized = stored(sized, "mix-sizes")
    buckets = min(MAX_BUCKETS, max(16, -(-sized.count() // rows_per_bucket)))
    # order-preserving: the first 8 hex digits of the hash, scaled
    prefix = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    sized = sized.withColumn("bucket", F.floor(prefix * buckets / F.lit(1 << 32)).cast("int"))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    starts = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(starts), F.lit(0)))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    plan = sums.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("plan_source"), F.col("s.bucket").alias("plan_bucket"),
        "bucket_start", "source_rank", "source_size", "target",
    )
    inside = Window.partitionBy("source", "bucket").orderBy("h")
    running = sized.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = running.join(
        plan, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("bucket") == F.col("plan_bucket"))
    )
    first = F.col("bucket_start") + F.col("upto") - F.col("size")  # words of the source before this document
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    k = (F.col("source_rank") % len(tilts) + 1).cast("int")
    start = F.element_at(F.array(*[F.lit(float(a)) for a, _ in tilts]), k)
    end = F.element_at(F.array(*[F.lit(float(b)) for _, b in tilts]), k)

    def placement(epoch: Column) -> Column:
        offset = F.col("first") + epoch * F.col("source_size")
        words = F.greatest(F.least(F.col("size"), F.col("wanted") - offset), F.lit(0)).cast("long")
        position = demand_position(offset / F.col("wanted"), F.col("start"), F.col("end"))
        return F.struct(epoch.cast("int").alias("epoch"), position.alias("position"), words.alias("words"))

    epochs = F.array(*[placement(F.lit(e)) for e in range(max_epochs)])
    out = placed.withColumns({"first": first, "wanted": wanted, "start": start, "end": end}).withColumn(
        "placements", F.when(F.col("wanted") > 0, F.filter(epochs, lambda p: p["words"] > 0))
    )
    return out.select(
        "doc_id",
        "source",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        F.coalesce(F.aggregate("placements", F.lit(0).cast("long"), lambda a, p: a + p["words"]), F.lit(0)).cast("long").alias("taken"),
        F.coalesce("placements", F.array().cast("array<struct<epoch:int,position:double,words:bigint>>")).alias("placements"),
    )


def training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """The placements of ``mix`` one per row, range-sorted by training position."""
    rows = mixed.select("doc_id", "source", F.inline("placements"))
    keys = ("position", "source", "doc_id", "epoch")
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)
