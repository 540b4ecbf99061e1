"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Read ``folder/name.parquet``; with ``columns`` only these reach the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def merged(df: DataFrame, *key: str) -> DataFrame:
    """One row per key of a table with repeated deliveries (rows that differ in ``loaded_at`` alone).

    Rows with equal keys count as deliveries of one row; null keys form one key. Which copy stays is of no
    account, as they differ in ``loaded_at`` only, which is dropped.
    """
    return df.drop("loaded_at").dropDuplicates(list(key))
