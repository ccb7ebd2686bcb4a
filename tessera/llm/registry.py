"""The corpus queries by name, with their DuckDB twins where SQL can express them."""

from __future__ import annotations

from tessera.llm import collocations, decontamination, exact_dedup, html_text, katz, licenses, near_dup, packing, pieces, preferences, resampling, toxicity, whitening

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_katz": katz.op3_katz,
    "op4_html_text": html_text.op4_html_text,
    "op5_near_dup": near_dup.op5_near_dup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_licenses": licenses.op8_licenses,
    "op9_resampling": resampling.op9_resampling,
    "op10_preferences": preferences.op10_preferences,
    "op11_whitening": whitening.op11_whitening,
    "op12_collocations": collocations.op12_collocations,
    "op13_packing": packing.op13_packing,
}
ORACLES = {"op6_exact_dedup": exact_dedup.OP6_SQL, "op10_preferences": preferences.OP10_SQL, "op12_collocations": collocations.OP12_SQL}
