"""Shared folders, stored intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder path under ``spark.checkpoint.dir``.

    The setting is read from the session.  Only a local session without it
    (tests) gets a folder of its own; a cluster without it is an error, since a
    machine-local folder would not be seen by the other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-geoquilt-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it held, not the
    whole chain, because the files are in shared storage.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing will read again; other frames are left alone."""
    for df in tables:
        if path := df.__dict__.pop("stored_path", None):
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths that match a pattern, by the store that Spark reads them from."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(s.getPath().toString() for s in store.globStatus(place) or ())


def broadcast_within(df: DataFrame, row_bytes: int, max_bytes: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit ``max_bytes``.

    ``row_bytes`` is an upper estimate of one row in memory.  Beyond the bound
    the hint is left off and Spark shuffles the join.
    """
    return F.broadcast(df) if df.count() * row_bytes <= max_bytes else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark's reader has to understand."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def range_of(key: Column, cuts: Sequence, literal: Callable[[object], Column] = F.lit) -> Column:
    """Number of sorted cut points up to ``key``, found in two steps of about sqrt(n) comparisons."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    chunks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    row = lambda xs: F.array(*map(literal, xs))
    upto = lambda xs: F.size(F.filter(xs, lambda c: c <= key))
    chunk = upto(row([c[0] for c in chunks]))
    inner = F.element_at(F.array(*map(row, chunks)), F.greatest(chunk, F.lit(1)))
    return F.when(chunk == 0, 0).otherwise((chunk - 1) * step + upto(inner)).cast("int")
