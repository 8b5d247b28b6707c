"""The queries of this subpackage and their SQL, for the registry at the repository top."""

from __future__ import annotations

from . import chat, decontaminate, fingerprint, hard_negatives, jaccard_join, lm_score, merkle, mixing, quality, sharding, suffix_dedup, toxicity, url_rules

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_sharding": sharding.op2_sharding,
    "op3_url_rules": url_rules.op3_url_rules,
    "op4_chat_format": chat.op4_chat_format,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_mixing": mixing.op6_mixing,
    "op7_lm_score": lm_score.op7_lm_score,
    "op8_quality": quality.op8_quality,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_fingerprint": fingerprint.op13_fingerprint,
}

ORACLES = {
    "op3_url_rules": url_rules.ORACLE,
    "op4_chat_format": chat.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
    "op10_suffix_dedup": suffix_dedup.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
