"""Helpers that keep plans safe at scale: lineage cuts, size-checked broadcasts, salted joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size, in bytes, of a join side that is sent to every executor.
BROADCAST_BYTES = 16 << 20
#: A key is hot when it holds more than one in so many rows; so there are fewer hot keys than this.
HOT_SHARE = 200
#: Rows of one key that a task may get before the key is spread over several.
TASK_ROWS = 1_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: the cluster's ``spark.checkpoint.dir``, else, in local runs alone, one of our own that is
    removed when Python ends. A cluster without such a folder is refused: its machines share no other."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="strataq-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` now, keep it in the checkpoint folder, and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured(df: DataFrame, *keys: str) -> tuple[int, int]:
    """Rows and estimated bytes of ``df``, counted over all rows; meant for a ``cut`` result."""
    width: Column = F.lit(16)
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind in ("array<string>", "array<int>", "array<bigint>", "array<double>"):
            width = width + F.greatest(F.size(F.col(f"`{name}`")), F.lit(0)) * 48
        elif kind.startswith(("array", "map", "struct", "binary", "variant")):
            # nested values by their text, which holds every part of them
            text = F.col(f"`{name}`") if kind == "binary" else F.to_json(F.struct(F.col(f"`{name}`")))
            width = width + F.coalesce(F.octet_length(text), F.lit(0)) * 2
        else:
            width = width + 8
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return int(rows), int(size)


def hot_keys(left: DataFrame, key: str, share: int = HOT_SHARE, task_rows: int = TASK_ROWS) -> DataFrame:
    """The keys of ``left`` that are more than one task should get, with a number of salts each.

    A key is one if it has more than one in ``share`` of the rows, or more than ``task_rows``. The salts are the rows over
    ``task_rows``, or over that share if this is less, so no task gets more than ``task_rows`` rows of a key. There are
    fewer than ``share`` plus rows over ``task_rows`` such keys: a table of one row for each task's worth of rows.
    """
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    unit = F.least(F.lit(task_rows), F.greatest(F.ceil(F.col("__total") / share), F.lit(1)))
    return (
        counts.crossJoin(F.broadcast(total))  # one row
        .filter(F.col("__n") > unit)
        .filter((F.col("__n") * share > F.col("__total")) | (F.col("__n") > task_rows))
        .select(key, F.ceil(F.col("__n") / unit).cast("int").alias("__salts"))
    )


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: int = HOT_SHARE, task_rows: int = TASK_ROWS) -> DataFrame:
    """Equi-join on ``key`` in which no hot key of ``left`` ends in one task.

    ``right`` must have one row per key. Rows of hot keys are spread over salts by a hash of the row, so a task that runs
    again salts them as before, and the row of ``right`` is repeated for each salt of its key; other keys have the one salt 0.
    Rows that are equal in all columns get one salt; they are rare beside the rows of a key.
    """
    hot = cut(hot_keys(left, key, share, task_rows))
    _, size = measured(hot)
    marked = lambda df: df.join(F.broadcast(hot) if size <= BROADCAST_BYTES else hot, key, "left")
    spread = marked(left).withColumn("__salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in left.columns if not dict(left.dtypes)[c].startswith(("map", "variant")))), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    copies = marked(right).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))).drop("__salts")
    return spread.join(copies, [key, "__salt"], how).drop("__salt")


def sized_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a side that is already computed (``cut``): broadcast if it measures under ``limit``, else salted."""
    _, size = measured(right)
    if size <= limit:
        return left.join(F.broadcast(right), key, how)
    return salted_join(left, right, key, how)


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose rows are dear to work on, over all cores if its files make far fewer partitions than there are.

    Only an input that is small for the cluster is moved; one that fills the cores stays where it is read.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() * 4 <= cores else scan
