"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from finsift.llm import align, chat, jaccard, langid, linededup, packing, pieces, pitmanyor, quality, repair, topk, toxicity, urlfilter

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_url_filter": urlfilter.op3_url_filter,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_language_id": langid.op6_language_id,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op8_exact_topk": topk.op8_exact_topk,
    "op9_packing": packing.op9_packing,
    "op10_chat_format": chat.op10_chat_format,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_lm_scoring": pitmanyor.op12_lm_scoring,
    "op13_token_alignment": align.op13_token_alignment,
}

ORACLES = {
    "op1_quality_rules": quality.oracle(),
    "op2_ngram_jaccard": jaccard.oracle(),
    "op3_url_filter": urlfilter.oracle(),
    "op7_line_dedup": linededup.oracle(),
    "op8_exact_topk": topk.oracle(),
    "op10_chat_format": chat.oracle(),
    "op11_conversation_repair": repair.oracle(),
}
