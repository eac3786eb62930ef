"""Training rows: which documents may teach, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquilt.storage import broadcast_within

FOLDS, HELD_OUT = 3, 1
GRAIN = 1_000_000


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def sampled(rows: DataFrame, key: Column, max_rows: int) -> DataFrame:
    """About ``max_rows`` of ``rows``, chosen by a hash of ``key``; all of them if there are fewer."""
    n = rows.count()
    share = min(GRAIN, -(-max_rows * GRAIN // max(n, 1)))
    return rows if share >= GRAIN else rows.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(GRAIN)) < share)


def training_texts(docs: DataFrame, labels: DataFrame, label: str, max_per_class: int) -> DataFrame:
    """(doc_id, text, y) of about ``max_per_class`` labelled rows of each class.

    Held-out ids, null ids, null labels and null texts teach nothing.  An id with
    several labels takes the largest; repeated rows of ``docs`` count once each.
    The ids are few by construction and are broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    classes = [sampled(known.where(F.col("y") == y), F.col("doc_id"), max_per_class) for y in (0, 1)]
    ids = classes[0].unionByName(classes[1])
    return docs.select("doc_id", "text").where("text IS NOT NULL").join(broadcast_within(ids, 64), "doc_id")
