"""Changes of files as a stream: quiet batches and incremental plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def change_batches(events: DataFrame, quiet: str = "250 milliseconds", late: str = "10 seconds") -> DataFrame:
    """started, ended, paths of each burst of change events (ts, path, scope_id): a pause of ``quiet`` ends a burst.

    Works on streams and tables alike; on a stream events later than ``late`` are dropped and a burst comes out once.
    """
    windowed = events.withWatermark("ts", late) if events.isStreaming else events
    return windowed.groupBy(F.session_window("ts", quiet).alias("w"), "scope_id").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count(F.lit(1)).alias("n_events")).select("scope_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "paths", "n_events")


def watch(spark: SparkSession, folder: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each new part of a folder of change events to ``handle``; parts never overlap.

    What arrives while one is handled comes with the next. The checkpoint folder must be shared by the cluster.
    """
    events = spark.readStream.schema(schema).json(folder)
    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
