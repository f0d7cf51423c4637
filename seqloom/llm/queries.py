"""The registered query of each operator, with production parameters."""

from __future__ import annotations

from . import bpe, decontamination, divergence, html_extraction, importance, jaccard_join, language_id, lm_scoring, mixing, quality_rules, sharding, token_files, url_filter


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_language_id": language_id.op2_language_id,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_token_files": token_files.op5_token_files,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_jaccard_join": jaccard_join.op7_jaccard_join,
        "op8_source_mixing": mixing.op8_source_mixing,
        "op9_lm_scoring": lm_scoring.op9_lm_scoring,
        "op10_html_extraction": html_extraction.op10_html_extraction,
        "op11_bpe": bpe.op11_bpe,
        "op12_importance": importance.op12_importance,
        "op13_divergence": divergence.op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    """Only what SQL can express; the rest is held against brute force in tests/llm."""
    return {"op7_jaccard_join": jaccard_join.OP7_SQL, "op8_source_mixing": mixing.OP8_SQL, "op12_importance": importance.OP12_SQL, "op13_divergence": divergence.OP13_SQL}
