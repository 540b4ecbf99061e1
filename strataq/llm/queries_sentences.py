"""Queries on sentences (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import sentences
from strataq.sources.tables import table


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id is unique and no text has a place twice, so the rows are distinct as they come."""
    return sentences.sentences(table(spark, d, "documents", "doc_id", "text"))


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Sentences and their mean length per language tag, as spelt in the data."""
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    found = sentences.sentences(docs)
    per = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("chars"))
    return docs.select("doc_id", "lang").join(per, "doc_id").groupBy("lang").agg(F.sum("n").alias("n_sentences"), (F.sum("chars") / F.sum("n")).alias("mean_chars"))


QUERIES = {q.__name__: q for q in (p8_found, p8_lengths)}

SQL: dict[str, str] = {}
