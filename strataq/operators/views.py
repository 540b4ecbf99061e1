"""Views over the graph that a reader asks for: filtered levels, flows between cards, door counts, callers of a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of doors by what kind of program has them.
DOOR_CLASSES = {"network": ["http-route", "webhook", "realtime", "server-action", "rpc"], "screen": ["screen", "page"], "declared-cli": ["cli", "bin"], "runnable": ["main", "script"], "scheduled": ["cron", "job"]}


def read_limit(value, fallback: int = 60, most: int = 500) -> int:
    """A caller's limit as a whole number from 1 to ``most``; what is none gives the fallback."""
    try:
        n = float(value)
    except (TypeError, ValueError):
        return fallback
    return max(1, min(most, int(n))) if n == n and abs(n) != float("inf") else fallback


def filter_level(nodes: DataFrame, edges: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes (id, zone) and edges (from_id, to_id) of a level without those in hidden zones, and how many nodes each zone hides."""
    gone = F.coalesce(F.col("zone").isin(hidden), F.lit(False)) if hidden else F.lit(False)
    kept, out = nodes.filter(~gone), nodes.filter(gone)
    ids = out.filter(F.col("id").isNotNull()).select("id").distinct()
    seen = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return kept, seen, out.groupBy("zone").agg(F.count(F.lit(1)).alias("n_hidden"))


def flows(rows: DataFrame, left: str, right: str, weight: str, expected: DataFrame | None = None) -> DataFrame:
    """left, right, weight: summed weights between two groupings, with weight 1 for ``expected`` pairs that have none."""
    summed = rows.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(left, right).agg(F.sum(weight).alias(weight))
    if expected is None:
        return summed
    return summed.unionByName(expected.select(left, right).distinct().join(summed, [left, right], "left_anti").withColumn(weight, F.lit(1).cast(summed.schema[weight].dataType)))


def rls_rank(enabled: Column, n_policies: Column) -> Column:
    """How urgent a table's row protection is to read: 0 off, 1 on without a policy, 2 unknown, 3 on with policies."""
    return F.when(enabled.isNull(), 2).when(~enabled, 0).when(F.coalesce(n_policies, F.lit(0)) == 0, 1).otherwise(3)


def door_classes(doors: DataFrame) -> DataFrame:
    """class, n_doors of doors (endpoint_kind); kinds of no class count as other."""
    named = F.coalesce(*(F.when(F.col("endpoint_kind").isin(kinds), name) for name, kinds in DOOR_CLASSES.items()), F.lit("other"))
    return doors.groupBy(named.alias("class")).agg(F.count(F.lit(1)).alias("n_doors"))


def languages_by_tier(files: DataFrame, coarse: list[str]) -> DataFrame:
    """tier, languages: the distinct languages (in lower case) of files that are read coarsely, and of the others."""
    tier = F.when(F.lower("language").isin(coarse), "coarse").otherwise("full")
    return files.filter(F.col("language").isNotNull()).groupBy(tier.alias("tier")).agg(F.array_join(F.array_sort(F.collect_set(F.lower("language"))), ",").alias("languages"))


def callers(nodes: DataFrame, edges: DataFrame, asked: str, limit: int = 60) -> DataFrame:
    """target_id, from_id, kind, name, weight, n_targets: who refers to what is asked for, by id, else by name, in any case.

    Of several nodes of a name each is a candidate with callers of its own; ``n_targets`` says how many there are. The
    heaviest come first, at most ``limit``.
    """
    by_id = nodes.filter(F.col("id") == asked).select("id")
    by_name = nodes.filter((F.lower("name") == asked.strip().lower()) & (F.lit(asked.strip()) != "")).select("id")
    any_id = by_id.agg((F.count(F.lit(1)) > 0).alias("__by_id"))  # one row
    targets = by_id.unionByName(by_name.crossJoin(F.broadcast(any_id)).filter(~F.col("__by_id")).select("id")).distinct()
    n = targets.agg(F.count(F.lit(1)).alias("n_targets"))  # one row
    calls = edges.filter((F.col("kind") == "references") & F.col("from_id").isNotNull()).join(targets.withColumnRenamed("id", "to_id"), "to_id").groupBy("to_id", "from_id").agg(F.sum("weight").alias("weight"))
    named = calls.join(nodes.select(F.col("id").alias("from_id"), "kind", "name"), "from_id").crossJoin(F.broadcast(n))
    return named.select(F.col("to_id").alias("target_id"), "from_id", "kind", "name", "weight", "n_targets").orderBy(F.desc("weight"), "from_id", "target_id").limit(read_limit(limit))
