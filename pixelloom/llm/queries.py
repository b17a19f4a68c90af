"""The queries of this package and their SQL."""

from __future__ import annotations

from pixelloom.llm import alignment, decontamination, line_dedup, maxent, merkle, pieces, quality, sharding, simhash, token_counts, toxicity, url_filter, vector_search

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_sharding": sharding.op5_sharding,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_lm_scoring": maxent.op8_lm_scoring,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_exact_top_k": vector_search.op12_exact_top_k,
    "op13_cross_tokenizer_alignment": alignment.op13_cross_tokenizer_alignment,
}

ORACLES = {
    "op6_decontamination": decontamination.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_exact_top_k": vector_search.SQL,
}
