"""The production queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_chunks, decontaminate, id_files, importance, language_id, license_scan, near_dup, pii_crf, quality_rules, substring_dedup, suffix_dedup, url_filter, vector_codes
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    docs = lambda s, d: table(s, d, "documents")
    return {
        "op10_near_dup": lambda s, d: near_dup.query(docs(s, d)),
        "pipeline": corpus_pipeline.run,
        "op9_license_scan": lambda s, d: license_scan.query(docs(s, d)),
        "op1_language_id": lambda s, d: language_id.query(docs(s, d)),
        "op2_decontaminate": lambda s, d: decontaminate.query(docs(s, d), table(s, d, "benchmark")),
        "op3_substring_dedup": lambda s, d: substring_dedup.query(docs(s, d)),
        "op4_bpe_chunks": lambda s, d: bpe_chunks.query(docs(s, d)),
        "op5_pii_crf": lambda s, d: pii_crf.query(docs(s, d)),
        "op6_suffix_dedup": lambda s, d: suffix_dedup.query(docs(s, d)),
        "op7_url_filter": lambda s, d: url_filter.query(table(s, d, "pages")),
        "op8_quality_rules": lambda s, d: quality_rules.query(docs(s, d)),
        "op11_importance": lambda s, d: importance.query(docs(s, d), table(s, d, "benchmark")),
        "op12_vector_codes": lambda s, d: vector_codes.query(table(s, d, "embeddings")),
        "op13_id_files": lambda s, d: id_files.query(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_quality_rules": quality_rules.sql(),
        "op9_license_scan": license_scan.sql(),
        "op12_vector_codes": vector_codes.sql(),
    }
