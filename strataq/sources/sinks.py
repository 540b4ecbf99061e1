"""Snapshots and caches on disk: a snapshot becomes current by one small pointer file, so a reader never sees half of one."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataq.operators.history import last_wins


_POINTER = "snapshot_id string, nodes string, edges string"


def write_snapshot(nodes: DataFrame, edges: DataFrame, folder: str, snapshot_id: str) -> None:
    """Write both tables under a new id, by kind, then name it as the current one by a pointer of its own.

    Pointers are only ever added, each in a folder with a greater number, and one counts once it is wholly written; so a reader
    sees the old snapshot or the new one at every moment, and a broken write leaves the old one current.
    """
    nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/{snapshot_id}/nodes")
    edges.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/{snapshot_id}/edges")
    numbers = _pointers(nodes.sparkSession, folder)
    following = max(numbers, default=0) + 1
    schemas = (nodes.schema.json(), edges.schema.json())  # an empty table leaves no file that would tell
    nodes.sparkSession.createDataFrame([(snapshot_id, *schemas)], _POINTER).coalesce(1).write.mode("error").json(f"{folder}/current/{following:012d}")


def _pointers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the pointers that are wholly written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/current")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    done = [p.getPath() for p in files.listStatus(path) if p.isDirectory() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS"))]
    return [int(p.getName()) for p in done if p.getName().isdigit()]


def read_snapshot(spark: SparkSession, folder: str, snapshot_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a snapshot, the current one by default; a filter on kind reads only its folders."""
    pointers = [f"{folder}/current/{n:012d}" for n in sorted(_pointers(spark, folder))]
    every = spark.read.schema(_POINTER).json(pointers[-1:] if snapshot_id is None else pointers)
    row = (every if snapshot_id is None else every.filter(F.col("snapshot_id") == snapshot_id)).first()
    read = lambda name: spark.read.schema(StructType.fromJson(json.loads(row[name]))).parquet(f"{folder}/{row.snapshot_id}/{name}")
    return read("nodes"), read("edges")


def export_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables as lines of JSON with a field ``table``."""
    row = lambda df, name: df.select(F.to_json(F.struct(F.lit(name).alias("table"), *df.columns)).alias("value"))
    row(nodes, "nodes").unionByName(row(edges, "edges")).write.mode("overwrite").text(path)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of both, of each key the last by ``order``; write the result to another place than ``old`` is read from."""
    return last_wins(old.unionByName(new, allowMissingColumns=True), key, order)


def pruned(old: DataFrame, new: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """A cache after a run: new rows, and old ones that are still wanted and not replaced."""
    return old.join(keep.select(key).distinct(), key, "left_semi").join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def truncate(spark: SparkSession, folder: str, snapshot_id: str) -> None:
    """Empty a cache: an empty snapshot of the current columns becomes the current one; readers keep what they opened."""
    nodes, edges = read_snapshot(spark, folder)
    write_snapshot(nodes.limit(0), edges.limit(0), folder, snapshot_id)


def lookup(cache: DataFrame, keys: list[str], key: str = "path") -> DataFrame:
    """The rows of a cache for some keys; the filter reaches the scan, so payloads of others are not read."""
    return cache.filter(F.col(key).isin(keys)) if keys else cache.limit(0)


def index_of(cache: DataFrame, *columns: str) -> DataFrame:
    """The small columns of a cache alone: its payload is not among what the scan reads."""
    return cache.select(*columns)
