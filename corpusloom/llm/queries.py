"""The queries of this subpackage and, where SQL can express one, the same in DuckDB's SQL."""

from __future__ import annotations

from corpusloom.llm import chat_format, decontaminate, katz_lm, line_dedup, media_columns, ngram_jaccard, quality, shard_packing, source_mix, token_parquet

QUERIES = {
    "op1_token_parquet": token_parquet.query,
    "op2_source_mix": source_mix.query,
    "op3_ngram_jaccard": ngram_jaccard.query,
    "op4_quality_classifier": quality.query,
    "op5_katz_lm": katz_lm.query,
    "op6_chat_format": chat_format.query,
    "op7_decontaminate": decontaminate.query,
    "op8_shard_packing": shard_packing.query,
    "op9_media_columns": media_columns.query,
    "op10_line_dedup": line_dedup.query,
}

ORACLES = {
    "op3_ngram_jaccard": ngram_jaccard.ORACLE,
    "op6_chat_format": chat_format.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
}
