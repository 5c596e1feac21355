"""Registered queries and their DuckDB oracles, by theme."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casemill.plans import case_queries, relational_queries, retrieval_queries, text_queries

MODULES = (retrieval_queries, text_queries, relational_queries, case_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch top-k with same-label filter, score list and pivoted suggestions."""
    return retrieval_queries.suggestion_pivot(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
