"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from tessera.llm import decontam, langid, lm_score, media, packing, quality, sharding, simhash, substring, tokens

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_simhash": simhash.op2_simhash,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_lm_score": lm_score.op4_lm_score,
    "op5_language": langid.op5_language,
    "op6_substring": substring.op6_substring,
    "op7_quality": quality.op7_quality,
    "op8_packing": packing.op8_packing,
    "op9_media": media.op9_media,
    "op10_tokens": tokens.op10_tokens,
}
ORACLES = {"op1_sharding": sharding.ORACLE, "op3_decontamination": decontam.ORACLE}
