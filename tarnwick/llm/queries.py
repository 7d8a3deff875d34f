"""The subpackage's registered queries and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, embedding_dedup, exact_dedup, html_extraction, language_id, lexical_search, lm_scoring, mixing, quality, secrets, simhash, spelling, toxicity

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_bpe": bpe.op2_bpe,
    "op3_html_extraction": html_extraction.op3_html_extraction,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_quality": quality.op7_quality,
    "op8_simhash": simhash.op8_simhash,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op9_secrets": secrets.op9_secrets,
    "op10_mixing": mixing.op10_mixing,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_spelling": spelling.op12_spelling,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLE = {
    "op1_language_id": language_id.ORACLE,
    "op5_embedding_dedup": embedding_dedup.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op6_lm_scoring": lm_scoring.ORACLE,
    "op9_secrets": secrets.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op12_spelling": spelling.ORACLE,
}
