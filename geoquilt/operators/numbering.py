"""Dense numbers in the order of a column, without a window over all rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoquilt.storage import range_of, stored

ROWS_PER_RANGE, MAX_RANGES = 4096, 1024


def numbered(df: DataFrame, key: str, name: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the order of the numeric column ``key``.

    Rows are dealt into ranges by approximate quantiles, counted per range, and
    numbered inside their range from the count of those before.  Rows with equal
    keys are numbered in any order, null keys come first.
    """
    ranges = min(MAX_RANGES, math.ceil(df.count() / rows_per_range))
    cuts = []
    if ranges > 1:
        cuts = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    place = F.when(F.col(key).isNull(), 0).otherwise(range_of(F.col(key), sorted(set(cuts))))
    ranged = df.withColumn("__range", place)
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = ranged.groupBy(F.col("__range").alias("__r")).agg(F.count("*").alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(F.col(key).asc_nulls_first()))
    joined = ranged.withColumn("__inside", inside).join(F.broadcast(starts.select("__r", "__first")), F.col("__range") == F.col("__r"))  # at most MAX_RANGES rows
    return joined.select(*df.columns, (F.col("__first") + F.col("__inside") - 1).cast("long").alias(name))


def indexed(df: DataFrame, *keys: str, name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the order of ``keys``, of any types; rows with equal keys in any order.

    Rows are range-sorted and stored so; the partitions' counts, one small row
    each, are summed up to their first numbers.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = stored(ranged.withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}), "ranges")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(F.col("__part").alias("__p")).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    starts = counts.select("__p", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    joined = ranged.join(starts, F.col("__part") == F.col("__p"))
    return joined.select(*df.columns, (F.col("__id") + F.col("__shift")).cast("long").alias(name))
