"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, language_id, ngram_join, packing, pii, quality, secrets, toxicity

QUERIES = {
    "op3_chat_format": chat.op3_chat_format,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op2_toxicity": toxicity.op2_toxicity,
    "op9_personal_data": pii.op9_personal_data,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op1_language_id": language_id.op1_language_id,
    "op5_ngram_jaccard_join": ngram_join.op5_ngram_jaccard_join,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_packing": packing.op7_packing,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLES = {
    "op3_chat_format": chat.ORACLE,
    "op5_ngram_jaccard_join": ngram_join.ORACLE,
    "op6_decontamination": decontaminate.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
