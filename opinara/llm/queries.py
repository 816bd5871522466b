"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opinara.llm import byte_bpe, compression, decontaminate, filter_audit, jaccard, language, line_dedup, merkle, pii, preference, quality, secret_scan, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_attention_quality": quality.op1_attention_quality,
    "op2_language_id": language.op2_language_id,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_compression_bands": compression.op5_compression_bands,
    "op6_weak_pii": pii.op6_weak_pii,
    "op7_nearest_toxicity": toxicity.op7_nearest_toxicity,
    "op8_latent_decontamination": decontaminate.op8_latent_decontamination,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_preference_pairs": preference.op10_preference_pairs,
    "op11_filter_interaction": filter_audit.op11_filter_interaction,
    "op12_secret_grammars": secret_scan.op12_secret_grammars,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLES: dict[str, str] = {"op10_preference_pairs": preference.OP10_SQL, "op11_filter_interaction": filter_audit.OP11_SQL, "op13_merkle_manifest": merkle.OP13_SQL}
