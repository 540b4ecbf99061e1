"""Comparison of snapshots, caches and repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def snapshot(rows: DataFrame, at: Column, since: str = "recorded_at", until: str = "removed_at") -> DataFrame:
    """The rows that exist at a time: seen by then and not taken out by then."""
    return rows.filter((F.col(since) <= at) & (F.col(until).isNull() | (F.col(until) > at)))


def diff(prev: DataFrame, following: DataFrame, key: str = "id", content: str = "hash") -> DataFrame:
    """key, kind, change (added, removed, changed) of two snapshots, by one full outer join; equal rows drop out.

    A null content equals a null content. Keys must be unique in each snapshot.
    """
    a = prev.select(F.col(key).alias("__k"), F.col("kind").alias("__ka"), F.col(content).alias("__ca"), F.lit(True).alias("__a"))
    b = following.select(F.col(key).alias("__k"), F.col("kind").alias("__kb"), F.col(content).alias("__cb"), F.lit(True).alias("__b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__ca").eqNullSafe(F.col("__cb")), "changed")
    return a.join(b, "__k", "full_outer").select(F.col("__k").alias(key), F.coalesce("__kb", "__ka").alias("kind"), change.alias("change")).filter(F.col("change").isNotNull())


def stale_docs(prev: DataFrame, following: DataFrame) -> DataFrame:
    """id, stale: documented nodes whose documentation is as before; stale if the body changed meanwhile or they were stale before.

    ``prev`` may have a column docs_stale; a node stays stale until its documentation changes. A body that is null on either
    side has not changed.
    """
    was = F.coalesce(F.col("docs_stale"), F.lit(False)) if "docs_stale" in prev.columns else F.lit(False)
    a = prev.select("id", F.col("doc_hash").alias("d0"), F.col("body_hash").alias("b0"), was.alias("s0"))
    now = following.filter((F.col("summary_source") == "docs") & F.col("doc_hash").isNotNull()).select("id", "doc_hash", "body_hash")
    same = now.join(a, "id").filter(F.col("d0") == F.col("doc_hash"))
    return same.select("id", (F.coalesce(F.col("b0") != F.col("body_hash"), F.lit(False)) | F.col("s0")).alias("stale"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last by ``order``, which must be unique within a key."""
    w = W.partitionBy(key).orderBy(F.desc_nulls_last(order))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """``name`` with ~2, ~3, ... on the second, third, ... row that has it, by ``order``.

    A numbered name that some row has of its own gets another ~, as often as it takes (``a~2`` becomes ``a~~2``).
    """
    w = W.partitionBy(name).orderBy(order)
    ranked = rows.withColumn("__n", F.row_number().over(w))
    # names that look numbered say how many ~ must not be used with what stands before them
    taken = (
        rows.select(F.regexp_extract(F.col(name), r"^(.*?)(~+)\d+$", 1).alias(name), F.length(F.regexp_extract(F.col(name), r"^(.*?)(~+)\d+$", 2)).alias("__l"))
        .filter("__l > 0").groupBy(name).agg(F.max("__l").alias("__l"))
    )
    mark = F.repeat(F.lit("~"), F.coalesce("__l", F.lit(0)) + 1)
    return ranked.join(taken, name, "left").withColumn("unique_name", F.when(F.col("__n") > 1, F.concat(F.col(name), mark, F.col("__n").cast("string"))).otherwise(F.col(name))).drop("__n", "__l")


def cache_plan(current: DataFrame, cached: DataFrame, uses: DataFrame) -> DataFrame:
    """path, state of each path: reuse, changed, new, gone, or importer (unchanged, but uses a path that is not reused).

    ``current`` and ``cached`` have path and hash, ``uses`` has src and dst. Importers are one step away, as they were.
    """
    a = current.select("path", F.col("hash").alias("h1"), F.lit(1).alias("__now"))
    b = cached.select("path", F.col("hash").alias("h0"), F.lit(1).alias("__old"))
    state = F.when(F.col("__old").isNull(), "new").when(F.col("__now").isNull(), "gone").when(~F.col("h0").eqNullSafe(F.col("h1")), "changed").otherwise("reuse")
    plan = a.join(b, "path", "full_outer").select("path", state.alias("state"))
    touched = uses.join(plan.filter("state <> 'reuse'").select(F.col("path").alias("dst")), "dst", "left_semi").select(F.col("src").alias("path"), F.lit(1).alias("__t")).distinct()
    return plan.join(touched, "path", "left").select("path", F.when((F.col("state") == "reuse") & F.col("__t").isNotNull(), "importer").otherwise(F.col("state")).alias("state"))


def quiet_batches(events: DataFrame, key: str, at: str, quiet: str) -> DataFrame:
    """key, started, ended, n: events of a key in batches that a pause of ``quiet`` ends."""
    return events.groupBy(key, F.session_window(at, quiet).alias("__w")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("started"), F.max(at).alias("ended")).select(key, "started", "ended", "n")
