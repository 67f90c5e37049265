"""All queries of the engine, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus_queries, layer_queries, monitoring_queries, page_queries, retrieval_queries, run_queries, section_queries

GROUPS = [run_queries.QUERIES, retrieval_queries.QUERIES, corpus_queries.QUERIES, monitoring_queries.QUERIES, section_queries.QUERIES, layer_queries.QUERIES, page_queries.QUERIES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q[0] for group in GROUPS for name, q in group.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for group in GROUPS for name, q in group.items() if q[1]}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["bm25_top5"](spark, sf_dir)
