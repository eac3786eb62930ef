"""Query op13: two tokenizers aligned over every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoquilt.llm.token_align import token_alignment
from geoquilt.storage import table


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    return token_alignment(table(spark, sf_dir, "documents"))
