"""The queries of the numbered operators and the SQL that says the same."""

from __future__ import annotations

from quarry.llm import bpe, chat_format, exact_dedup, hard_negatives, html_extract, mixing, near_dedup, quality_classifier, quality_rules, source_divergence, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_mixing": mixing.op7_mixing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_bpe": bpe.op10_bpe,
    "op11_source_divergence": source_divergence.op11_source_divergence,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
}

ORACLES = {
    "op4_chat_format": chat_format.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op11_source_divergence": source_divergence.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
}
