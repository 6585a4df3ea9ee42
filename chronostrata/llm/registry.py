"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from chronostrata.llm import byte_bpe, jaccard_join, lm_scoring, mixing, quality_classifier, quality_rules, secrets, sharding, topk, toxicity

QUERIES = {
    "op1_topk_search": topk.query,
    "op2_quality_rules": quality_rules.query,
    "op3_byte_bpe": byte_bpe.query,
    "op4_toxicity": toxicity.query,
    "op5_source_mixing": mixing.query,
    "op6_quality_classifier": quality_classifier.query,
    "op7_secret_scans": secrets.query,
    "op8_ngram_jaccard_join": jaccard_join.query,
    "op9_lm_scoring": lm_scoring.query,
    "op9_lm_scoring_trigrams": lm_scoring.trigram_query,
    "op10_sharding": sharding.query,
}

ORACLES = {
    "op1_topk_search": topk.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE,
    "op5_source_mixing": mixing.ORACLE,
    "op9_lm_scoring": lm_scoring.ORACLE,
    "op9_lm_scoring_trigrams": lm_scoring.TRIGRAM_ORACLE,
    "op10_sharding": sharding.ORACLE,
}
