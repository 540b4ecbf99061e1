"""Queries on credentials (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import credentials
from strataq.sources.tables import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return credentials.texts_of(
        table(spark, d, "appsettings", "setting_id", "rel_path", "stripe", "connectionstrings"), table(spark, d, "src", "src_id", "rel_path", "secret")
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.found(_texts(spark, d)).select("field", "row_id", "start_pos", "end_pos")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its credentials masked and nothing else changed."""
    return credentials.redacted(_texts(spark, d))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Texts and credentials per field."""
    return credentials.redacted(_texts(spark, d)).groupBy("field").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n_masked").alias("n_credentials"), F.count_if(F.col("n_masked") > 0).alias("n_with"))


def p1_model(spark: SparkSession, d: str) -> DataFrame:
    """What the model was fitted on and how it did on held-out candidates (measure, value)."""
    report = credentials.fit(_texts(spark, d)).report
    return spark.createDataFrame([(k, float(v)) for k, v in report.items()], "measure string, value double")


def p1_unlabelled(spark: SparkSession, d: str) -> DataFrame:
    """Per field and kind of place: the credentials found, and how many of them no labelling pattern knows."""
    return credentials.decided(_texts(spark, d)).groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n_found"), F.count_if(F.col("label") < 0).alias("n_without_label"), F.count_if(F.col("label") == 0).alias("n_against_label"))


QUERIES = {q.__name__: q for q in (p1_found, p1_redacted, p1_counts, p1_model, p1_unlabelled)}

SQL: dict[str, str] = {}
