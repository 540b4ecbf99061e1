"""Queries on leaked evaluation texts (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import leaks
from strataq.sources.tables import table


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("item_id", "doc_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the number of texts it leaked into."""
    n = _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return table(spark, d, "eval_items", "item_id", "suite", "split").join(n, "item_id", "left").na.fill(0, ["n_documents"])


QUERIES = {q.__name__: q for q in (p7_found, p7_items)}

SQL: dict[str, str] = {}
