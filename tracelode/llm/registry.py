"""The queries of this package and, where SQL can express them, their SQL."""

from . import ball_tree, byte_bpe, chat_format, html_text, lm_score, max_tree, quality_rules, simhash_dedup, source_mix, suffix_dedup, token_files, toxicity, va_search

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_simhash_dedup": simhash_dedup.op4_simhash_dedup,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_html_text": html_text.op6_html_text,
    "op7_token_files": token_files.op7_token_files,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_va_search": va_search.op9_va_search,
    "op10_source_mix": source_mix.op10_source_mix,
    "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
    "op12_ball_tree": ball_tree.op12_ball_tree,
    "op13_max_tree": max_tree.op13_max_tree,
}
ORACLES = {
    "op2_chat_format": chat_format.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op9_va_search": va_search.ORACLE,
    "op11_suffix_dedup": suffix_dedup.ORACLE,
    "op12_ball_tree": ball_tree.ORACLE,
    "op13_max_tree": max_tree.ORACLE,
}
