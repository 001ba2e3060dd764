"""Queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

import corpus_pipeline

from . import align, decontaminate, language, mixing, pii, quality, simhash, substring_bytes, substring_words, token_binary, url_filter, whiten, winnow

QUERIES = {
    "op1_winnowing": winnow.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_source_mixing": mixing.query,
    "op4_substring_dedup": substring_words.query,
    "op5_token_binary": token_binary.query,
    "op6_quality_classifier": quality.query,
    "op7_benchmark_decontamination": decontaminate.query,
    "op8_personal_data": pii.query,
    "op9_suffix_array_dedup": substring_bytes.query,
    "op10_url_filter": url_filter.query,
    "op11_tokenizer_alignment": align.query,
    "op12_language_mixture": language.query,
    "op13_embedding_whitening": whiten.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op3_source_mixing": mixing.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
}
