"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from caretrail.llm import chat, decontamination, html_extraction, language_model, line_dedup, mixing, prefix_trie, quality_classifier, quality_rules, secrets, simhash, spelling, suffix_dedup

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_lm_scoring": language_model.op4_lm_scoring,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op5_layouts": chat.op5_layouts,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_benchmark_decontamination": decontamination.op10_benchmark_decontamination,
    "op11_html_extraction": html_extraction.op11_html_extraction,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

SQL = {
    "op5_chat_formatting": chat.OP5_SQL,
    "op5_layouts": chat.OP5_LAYOUTS_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op10_benchmark_decontamination": decontamination.OP10_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
