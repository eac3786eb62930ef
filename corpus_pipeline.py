"""From raw documents to a training mixture, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents, whatever other names
they bear, and no stage changes the order or number of ties but by its decision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquilt.llm import curriculum, decontam, near_dedup, secrets, toxicity
from geoquilt.llm.q_curriculum import POSITIONS
from geoquilt.llm.q_toxicity import THRESHOLD
from geoquilt.storage import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; null and empty texts stay, repeated rows share their fate."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    judged = docs.withColumn("__toxicity", toxicity.toxicity(F.col("text"), model))
    return judged.where(F.col("__toxicity.score") < THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least id; all documents without words stay."""
    return near_dedup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; null and empty texts hold none."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), spans=False)
    return found.where(~F.col("contaminated")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced; null texts stay null, texts of any length are read whole."""
    return secrets.redact(docs, secrets.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken and training positions of every document, in training order.

    Documents without words, or not taken, have no position and come last.
    """
    mixed = curriculum.mix(docs).select(
        "doc_id", "source", "size", "source_size", "target", "taken",
        *[F.get("placements", F.lit(e))["position"].alias(name) for e, name in enumerate(POSITIONS)],
    )
    keys = (F.col("first_position").asc_nulls_last(), F.col("doc_id"))
    return mixed.repartitionByRange(*keys).sortWithinPartitions(*keys)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]
#: Learnt scores have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
