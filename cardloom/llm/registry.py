"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from cardloom.llm import align, chat, decontaminate, divergence, html_extract, langid, neardup, pieces, pii, quality, rules, secrets, shards

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_token_shards": shards.op3_token_shards,
    "op4_quality_rules": rules.op4_quality_rules,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_pii": pii.op6_pii,
    "op7_language_id": langid.op7_language_id,
    "op8_chat_format": chat.op8_chat_format,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_minhash_neardup": neardup.op10_minhash_neardup,
    "op11_token_alignment": align.op11_token_alignment,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_secret_scans": secrets.op13_secret_scans,
}
ORACLES = {
    "op4_quality_rules": rules.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op8_chat_format": chat.ORACLE,
    "op10_minhash_neardup": neardup.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
}
