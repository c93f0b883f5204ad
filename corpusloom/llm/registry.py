"""The queries of this subpackage and their DuckDB equivalents, where SQL can express them."""

from __future__ import annotations

from corpusloom.llm import chat, html_text, infilling, jaccard_join, langid, media, mixing, packing, pii, resampling, sql, suffix_dedup, token_count, topk

QUERIES = {
    "op1_media_columns": media.op1_media_columns,
    "op2_ngram_jaccard_join": jaccard_join.op2_ngram_jaccard_join,
    "op3_html_main_text": html_text.op3_html_main_text,
    "op4_chat_format": chat.op4_chat_format,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_language_id": langid.op7_language_id,
    "op8_exact_top_k": topk.op8_exact_top_k,
    "op9_personal_data": pii.op9_personal_data,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_fill_in_middle": infilling.op12_fill_in_middle,
    "op13_token_counts": token_count.op13_token_counts,
}
ORACLE_SQL = {"op5_mix_sources": sql.MIX, "op8_exact_top_k": sql.TOP_K, "op9_personal_data": sql.PERSONAL, "op12_fill_in_middle": infilling.SQL}
