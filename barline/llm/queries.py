"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import chat_format, fill_in_middle, filtering_lloyd, language_id, line_dedup, matroska, ngram_join, packing, piecewise_hash, pii, quality_rules, secrets, source_mix


def queries() -> dict:
    return {
        "op1_chat_format": chat_format.op1_chat_format,
        "op2_language_id": language_id.op2_language_id,
        "op3_pii": pii.op3_pii,
        "op4_secrets": secrets.op4_secrets,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_matroska": matroska.op7_matroska,
        "op8_ngram_join": ngram_join.op8_ngram_join,
        "op9_source_mix": source_mix.op9_source_mix,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_piecewise_hash": piecewise_hash.op11_piecewise_hash,
        "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
        "op13_vector_codes": filtering_lloyd.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": quality_rules.OP5_SQL, "op12_fill_in_middle": fill_in_middle.OP12_SQL, "op13_vector_codes": filtering_lloyd.OP13_SQL}
