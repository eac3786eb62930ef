"""Query op3: toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquilt.llm.labelled import is_held_out
from geoquilt.storage import table
from geoquilt.llm.toxicity import fit, toxicity

THRESHOLD = 0.7


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity(F.col("text"), model).alias("found"))
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("found.score").alias("score"),
        (F.col("found.score") >= THRESHOLD).cast("int").alias("predicted"), "found.hits", "found.fuzzy", "found.quoted",
    )
