"""Queries on broken references and hierarchies (problems 3 and 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.operators import hierarchy as H
from strataq.operators import references as R
from strataq.sources.tables import table


def _refs(spark: SparkSession, d: str) -> DataFrame:
    e = R.references(table(spark, d, "edges", "id", "from_id", "to_id", "recorded_at"), "edges", "id", ["from_id", "to_id"], "recorded_at")
    x = R.references(table(spark, d, "explanations", "cache_key", "node_id", "created_at"), "explanations", "cache_key", ["node_id"], "created_at")
    return e.unionByName(x)


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return R.parents(*(table(spark, d, t, "id", "recorded_at", "removed_at") for t in ("nodes", "shared_nodes")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return R.orphans(_refs(spark, d), _parents(spark, d)).select("ref_table", "ref_key", "ref_field")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_report(_refs(spark, d), _parents(spark, d))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    a, b = (table(spark, d, t, "id", "parent_id") for t in ("nodes", "shared_nodes"))
    return a.unionByName(b)


def folder() -> Column:
    """Place of a node in the forest: the first three folders of the path in its id."""
    return F.substring_index(F.regexp_replace("id", r"^[a-z]+:|#.*$", ""), "/", 3)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    endless = F.col("depth") == -1
    return H.forest(_nodes(spark, d), locality=folder()).filter(endless | (F.col("depth") >= 12)).select(
        "node_id", F.when(endless, F.lit("cycle")).otherwise(F.col("root_id")).alias("root_id"), "depth"
    )


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    p = H.paths(_nodes(spark, d), locality=folder())
    n = H.descendant_counts(p).withColumnRenamed("ancestor_id", "node_id")
    return p.join(n, "node_id", "left").select(
        "node_id", "root_id", "depth", F.array_join("path", " > ").alias("path"),
        F.when(F.col("root_id").isNotNull(), F.coalesce("n_descendants", F.lit(0))).cast("bigint").alias("n_descendants"),
    )


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.paths(_nodes(spark, d), locality=folder())).select("ancestor_id", "node_id", F.col("distance").cast("bigint").alias("distance"))


QUERIES = {q.__name__: q for q in (p3_found, p3_report, p4_found, p4_hierarchy, p4_descendants)}

_ORPHANS = """
WITH p AS (SELECT id, min(recorded_at) AS since, CASE WHEN count(*) = count(removed_at) THEN max(removed_at) END AS until
           FROM (SELECT id, recorded_at, removed_at FROM nodes UNION ALL SELECT id, recorded_at, removed_at FROM shared_nodes) GROUP BY id),
r AS (SELECT DISTINCT 'edges' AS ref_table, id AS ref_key, 'from_id' AS ref_field, from_id AS target, recorded_at AS ts FROM edges WHERE from_id IS NOT NULL
      UNION SELECT 'edges', id, 'to_id', to_id, recorded_at FROM edges WHERE to_id IS NOT NULL
      UNION SELECT 'explanations', cache_key, 'node_id', node_id, created_at FROM explanations WHERE node_id IS NOT NULL),
f AS (SELECT r.*, CASE WHEN p.id IS NULL THEN 'missing' WHEN p.since > r.ts THEN 'later' WHEN p.until <= r.ts THEN 'removed' END AS reason
      FROM r LEFT JOIN p ON r.target = p.id)
"""

_FOREST = """
WITH RECURSIVE n AS (SELECT id, min(parent_id) AS parent_id FROM (SELECT id, parent_id FROM nodes UNION ALL SELECT id, parent_id FROM shared_nodes)
                     WHERE id IS NOT NULL GROUP BY id),
t AS (SELECT id AS node_id, id AS root_id, 0 AS depth, [id] AS path FROM n WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM n)
      UNION ALL SELECT n.id, t.root_id, t.depth + 1, list_append(t.path, n.id) FROM n JOIN t ON n.parent_id = t.node_id),
a AS (SELECT node_id, root_id, depth, path FROM t
      UNION ALL SELECT id, NULL, -1, NULL FROM n WHERE id NOT IN (SELECT node_id FROM t)),
c AS (SELECT path[i] AS ancestor_id, node_id, depth - i + 1 AS distance FROM (SELECT node_id, depth, path, unnest(range(1, len(path))) AS i FROM t))
"""

SQL = {
    "p3_found": _ORPHANS + "SELECT ref_table, ref_key, ref_field FROM f WHERE reason IS NOT NULL",
    "p3_report": _ORPHANS + """SELECT ref_table, ref_field, strftime(ts, '%Y-%m') AS month, reason, count(*) AS orphans, any_value(n) AS n_references
        FROM f JOIN (SELECT ref_table AS rt, ref_field AS rf, strftime(ts, '%Y-%m') AS m, count(*) AS n FROM f GROUP BY ALL)
        ON ref_table = rt AND ref_field = rf AND strftime(ts, '%Y-%m') IS NOT DISTINCT FROM m
        WHERE reason IS NOT NULL GROUP BY ref_table, ref_field, strftime(ts, '%Y-%m'), reason""",
    "p4_found": _FOREST + "SELECT node_id, coalesce(root_id, 'cycle') AS root_id, depth FROM a WHERE depth >= 12 OR depth = -1",
    "p4_hierarchy": _FOREST + """SELECT a.node_id, root_id, depth, array_to_string(path, ' > ') AS path,
        CASE WHEN root_id IS NOT NULL THEN coalesce(k, 0) END AS n_descendants
        FROM a LEFT JOIN (SELECT ancestor_id, count(*) AS k FROM c GROUP BY 1) d ON a.node_id = d.ancestor_id""",
    "p4_descendants": _FOREST + "SELECT ancestor_id, node_id, distance FROM c",
}
