"""References to records that do not exist (orphans), in the present and at the time of the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.operators.scale import cut, sized_join

#: Columns of a table of references.
REFERENCE = ["ref_table", "ref_key", "ref_field", "target", "at"]


def references(df: DataFrame, name: str, key: str, fields: list[str], at: str) -> DataFrame:
    """The non-null references of a table, one row per row and field, from a single scan.

    Null references are no references and are left out; a null key or time stays null.
    """
    one: list[Column] = [F.struct(F.lit(f).alias("ref_field"), F.col(f).cast("string").alias("target")) for f in fields]
    return (
        df.select(F.col(key).alias("ref_key"), F.col(at).alias("at"), F.explode(F.array(*one)).alias("r"))
        .filter(F.col("r.target").isNotNull())
        .select(F.lit(name).alias("ref_table"), "ref_key", "r.ref_field", "r.target", "at")
    )


def parents(*tables: DataFrame, key: str = "id", since: str = "recorded_at", until: str = "removed_at") -> DataFrame:
    """One row per parent key with the time it exists from and until.

    Repeated rows agree; should they not, the key exists from the earliest time until the latest, and without
    end if any row has none.
    """
    both = None
    for df in tables:
        part = df.select(F.col(key).alias("target"), F.col(since).alias("since"), F.col(until).alias("until"))
        both = part if both is None else both.unionByName(part)
    return (
        both.filter(F.col("target").isNotNull())
        .groupBy("target")
        .agg(F.min("since").alias("since"), F.max("until").alias("until"), F.count_if(F.col("until").isNull()).alias("open"))
        .select("target", "since", F.when(F.col("open") == 0, F.col("until")).alias("until"))
    )


def orphans(refs: DataFrame, parent: DataFrame) -> DataFrame:
    """The references whose target is missing, or was not there at the reference's time.

    The distinct non-null targets, with the first and last time each is referred to (combined before they are
    shuffled, so a target with a third of all references is one row per task), are joined against the parent
    keys. What the anti-join leaves over is missing; keys whose life does not cover all their references are
    suspects. Only these few keys are joined back to the references, where each is judged by its own time.

    ``refs`` has the columns REFERENCE, ``parent`` those of ``parents``. Result: the columns REFERENCE and
    ``reason`` (missing, later, removed), distinct. A reference without a time is judged by existence alone; a
    parent without ``since`` exists from the beginning. Empty inputs give an empty result; with no parents all
    references are orphans.
    """
    wanted = refs.groupBy("target").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    known = parent.select("target", "since", "until")
    judged = wanted.join(known, "target", "left_anti").select(
        "target", F.lit(True).alias("missing"), F.lit(None).cast(known.schema["since"].dataType).alias("since"),
        F.lit(None).cast(known.schema["until"].dataType).alias("until"),
    ).unionByName(
        wanted.join(known, "target", "inner")
        .filter((F.col("since") > F.col("first")) | (F.col("until") <= F.col("last")))
        .select("target", F.lit(False).alias("missing"), "since", "until")
    )
    suspects = cut(judged)
    reason = (
        F.when(F.col("missing"), F.lit("missing"))
        .when(F.col("since") > F.col("at"), F.lit("later"))
        .when(F.col("until") <= F.col("at"), F.lit("removed"))
    )
    return (
        sized_join(refs, suspects, "target")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select(*REFERENCE, "reason")
        .distinct()
    )


def orphan_report(refs: DataFrame, parent: DataFrame) -> DataFrame:
    """Counts per table, field, month and reason: orphans and the references they are a share of.

    Repeated deliveries count once: references are counted by distinct key. Months without orphans have no row.
    References without a time fall into the null month.
    """
    month = F.date_format("at", "yyyy-MM").alias("month")
    found = orphans(refs, parent).groupBy("ref_table", "ref_field", month, "reason").agg(F.count(F.lit(1)).alias("orphans"))
    total = refs.groupBy("ref_table", "ref_field", month).agg(F.countDistinct("ref_key").alias("n_references"))
    return found.join(total, (found.ref_table == total.ref_table) & (found.ref_field == total.ref_field) & found.month.eqNullSafe(total.month)).select(
        found.ref_table, found.ref_field, found.month, "reason", "orphans", "n_references"
    )
