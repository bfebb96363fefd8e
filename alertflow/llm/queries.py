"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from alertflow.llm import (chat_format, exact_dedup, hard_negatives, language_id, minhash_forest, mixing, quality, ranked_search,
                           secret_scan, sentencepiece_scan, suffix_dedup, toxicity, url_filter)

QUERIES = {
    "op1_sentencepiece": sentencepiece_scan.op1_sentencepiece,
    "op2_minhash_dedup": minhash_forest.op2_minhash_dedup,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_language_id": language_id.op5_language_id,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_url_filters": url_filter.op8_url_filters,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_secret_scan": secret_scan.op13_secret_scan,
}

ORACLES = {
    "op4_mixing": mixing.ORACLE,
    "op8_url_filters": url_filter.ORACLE,
    "op9_chat_format": chat_format.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_ranked_search": ranked_search.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
