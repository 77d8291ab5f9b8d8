"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, decontamination, language, language_model, lexical_search, line_dedup, mixing, near_dedup, preferences, quality, sharding, tokens, toxicity

QUERIES = {
    "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_hilbert_sharding": sharding.op3_hilbert_sharding,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_token_store": tokens.op5_token_store,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_preferences": preferences.op9_preferences,
    "op10_language_id": language.op10_language_id,
    "op11_ranked_search": lexical_search.op11_ranked_search,
    "op12_alignment": alignment.op12_alignment,
    "op13_lm_scoring": language_model.op13_lm_scoring,
}
ORACLES = {
    "op1_minhash_near_dedup": near_dedup.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op9_preferences": preferences.ORACLE,
    "op11_ranked_search": lexical_search.ORACLE,
}
