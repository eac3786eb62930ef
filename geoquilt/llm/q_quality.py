"""Query op4: quality of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquilt.llm.labelled import is_held_out
from geoquilt.llm.quality import fit, quality
from geoquilt.storage import table

THRESHOLD = 0.5


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), quality(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
