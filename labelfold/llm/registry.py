"""Queries of the training-data operators: name -> callable, and DuckDB SQL where it can express them."""

from __future__ import annotations

from . import (alignment, decontaminate, html_text, language_model, mixing, ngram_join, packing, quality, ranked_search, secret_scan,
               toxicity, url_filter, vector_dedup)

QUERIES = {
    "op1_ngram_join": ngram_join.query,
    "op2_vector_dedup": vector_dedup.query,
    "op3_quality": quality.query,
    "op4_html_text": html_text.query,
    "op5_mixing": mixing.query,
    "op6_decontaminate": decontaminate.query,
    "op7_language_model": language_model.query,
    "op8_toxicity": toxicity.query,
    "op9_url_filter": url_filter.query,
    "op10_secret_scan": secret_scan.query,
    "op11_packing": packing.query,
    "op12_alignment": alignment.query,
    "op13_ranked_search": ranked_search.query,
}
SQL = {"op2_vector_dedup": vector_dedup.ORACLE_SQL, "op9_url_filter": url_filter.oracle_sql(),
       "op13_ranked_search": ranked_search.ORACLE_SQL}
