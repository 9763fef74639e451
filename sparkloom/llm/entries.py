"""The opN_ queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from sparkloom.llm import alignment, embedding_dedup, html_extraction, importance, language, line_dedup, mixing, packing, phrase_dedup, quality, secrets, simhash, suffix_dedup


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_lines": line_dedup.op2_lines,
        "op3_html": html_extraction.op3_html,
        "op4_packing": packing.op4_packing,
        "op5_secrets": secrets.op5_secrets,
        "op6_quality": quality.op6_quality,
        "op7_suffixes": suffix_dedup.op7_suffixes,
        "op8_mixing": mixing.op8_mixing,
        "op9_embeddings": embedding_dedup.op9_embeddings,
        "op10_language": language.op10_language,
        "op11_phrases": phrase_dedup.op11_phrases,
        "op12_importance": importance.op12_importance,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_lines": line_dedup.dedup_sql(),
        "op5_secrets": secrets.scan_sql(),
        "op8_mixing": mixing.mix_sql(),
        "op12_importance": importance.resample_sql(),
    }
