"""Queries on source files that do not parse (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataq.llm import syntax
from strataq.sources.tables import table


def _files(spark: SparkSession, d: str) -> DataFrame:
    return syntax.with_language(table(spark, d, "extracts", "extract_id", "file_id", "scope_id", "path", "content"), table(spark, d, "nodes", "id", "kind", "language"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.faults(_files(spark, d)).select("extract_id")


def p2_faults(spark: SparkSession, d: str) -> DataFrame:
    """Where each file fails, or that it was cut off."""
    return syntax.faults(_files(spark, d))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(_files(spark, d))


QUERIES = {q.__name__: q for q in (p2_found, p2_faults, p2_rates)}

SQL: dict[str, str] = {}
