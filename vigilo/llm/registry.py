"""Queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from vigilo.llm import (bpe, decontaminate, html_text, importance, langid, licenses, lm_score, oracle, pii, quality, simhash,
                        spelling, suffix_dedup, token_file)

QUERIES = {
    "op1_lm": lm_score.op1,
    "op2_quality": quality.op2,
    "op3_simhash": simhash.op3,
    "op4_suffix_dedup": suffix_dedup.op4,
    "op5_langid": langid.op5,
    "op6_bpe": bpe.op6,
    "op7_pii": pii.op7,
    "op8_decontaminate": decontaminate.op8,
    "op9_html": html_text.op9,
    "op10_token_file": token_file.op10,
    "op11_spelling": spelling.op11,
    "op12_importance": importance.op12,
    "op13_licenses": licenses.op13,
}

#: The others learn, hash or tokenize in ways that SQL has no words for.
ORACLE_SQL: dict[str, str] = {
    "op2_quality": oracle.QUALITY,
    "op4_suffix_dedup": oracle.REPEATS,
    "op8_decontaminate": oracle.CONTAMINATION,
    "op11_spelling": oracle.SPELLING,
    "op12_importance": oracle.IMPORTANCE,
    "op13_licenses": oracle.LICENSES,
}
