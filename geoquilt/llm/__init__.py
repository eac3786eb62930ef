"""Operators for preparing training data, and the queries that apply them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoquilt.llm import q_curriculum, q_decontam, q_divergence, q_kd_shards, q_multi_index, q_near_dedup, q_quality, q_quotes, q_secrets, q_token_align, q_toxicity, q_url_rules, q_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_roundtrip": q_warc.op1_warc_roundtrip,
    "op2_url_rules": q_url_rules.op2_url_rules,
    "op3_toxicity": q_toxicity.op3_toxicity,
    "op4_quality": q_quality.op4_quality,
    "op5_near_dedup": q_near_dedup.op5_near_dedup,
    "op6_decontaminate": q_decontam.op6_decontaminate,
    "op7_secret_scan": q_secrets.op7_secret_scan,
    "op8_quote_links": q_quotes.op8_quote_links,
    "quoted_replies": q_quotes.quoted_replies,
    "op9_embedding_dedup": q_multi_index.op9_embedding_dedup,
    "op10_curriculum_mix": q_curriculum.op10_curriculum_mix,
    "op11_kd_shards": q_kd_shards.op11_kd_shards,
    "op12_source_divergence": q_divergence.op12_source_divergence,
    "op13_token_alignment": q_token_align.op13_token_alignment,
}
ORACLES: dict[str, str] = {
    "op1_warc_roundtrip": q_warc.SQL,
    "op2_url_rules": q_url_rules.SQL,
    "op5_near_dedup": q_near_dedup.SQL,
    "op6_decontaminate": q_decontam.SQL,
    "op8_quote_links": q_quotes.SQL,
    "quoted_replies": q_quotes.DERIVED_SQL,
    "op9_embedding_dedup": q_multi_index.SQL,
    "op10_curriculum_mix": q_curriculum.SQL,
    "op11_kd_shards": q_kd_shards.SQL,
    "op12_source_divergence": q_divergence.SQL,
}
