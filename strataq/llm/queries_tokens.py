"""Queries on encoding (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataq.llm import tokens
from strataq.sources.tables import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents", "doc_id", "text"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: every text comes back from its ids (null as empty)."""
    return tokens.decode(p6_ids(spark, d))


def p6_words(spark: SparkSession, d: str) -> DataFrame:
    """The distinct words, how often each occurs and how many ids it has."""
    return tokens.word_table(table(spark, d, "documents", "doc_id", "text")).selectExpr("word", "n", "size(ids) AS n_ids")


QUERIES = {q.__name__: q for q in (p6_ids, p6_decoded, p6_words)}

SQL = {"p6_decoded": "SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents"}
