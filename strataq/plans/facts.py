"""Queries of the property graph over the tables nodes, shared_nodes, edges and explanations, and over the star and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataq.functions import classes as K
from strataq.functions import scalars as S
from strataq.operators import graph as G
from strataq.operators import hierarchy as H
from strataq.operators import history as T
from strataq.plans.integrity import folder
from strataq.sources.tables import merged, table

_NODE = ["id", "kind", "name", "parent_id", "language", "path", "zone", "summary", "summary_source", "doc_hash", "body_hash", "hash", "ordinal", "scope_id", "meta", "recorded_at", "removed_at", "start_line", "end_line"]


def _nodes(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Nodes of both tables; deliveries differ in loaded_at alone, so distinct rows merge them."""
    cols = columns or tuple(_NODE)
    return table(s, d, "nodes", *cols).unionByName(table(s, d, "shared_nodes", *cols)).dropDuplicates(["id"])


def _edges(s: SparkSession, d: str) -> DataFrame:
    return merged(table(s, d, "edges", "id", "kind", "from_id", "to_id", "weight", "confidence", "ordinal", "meta", "loaded_at"), "id").withColumn("symbols", F.col("meta.symbols"))


def _paths(s: SparkSession, d: str) -> DataFrame:
    return H.paths(_nodes(s, d, "id", "parent_id"), locality=folder())


def nodes_of_kind(s, d):
    return _nodes(s, d, "id", "kind", "name").filter("kind = 'endpoint'").select("id", "name").orderBy("id")


def children_count(s, d):
    return _nodes(s, d, "id", "parent_id").filter("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_children"))


def zone_counts(s, d):
    return _nodes(s, d, "id", "kind", "zone").filter("kind = 'file'").groupBy("zone").agg(F.count(F.lit(1)).alias("n_files"))


def stats_rollup(s, d):
    n = _nodes(s, d, "id", "kind", "language", "summary_source", "meta")
    e = _edges(s, d)
    kinds = ("app", "module", "file", "type", "function", "endpoint", "service", "store")
    a = n.agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in kinds), F.count_if(F.col("summary_source") == "docs").alias("n_documented"), F.sum("meta.loc").alias("lines"), F.countDistinct(F.lower("language")).alias("n_languages"))
    b = e.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("confidence") == "likely").alias("n_likely"), F.sum("weight").alias("total_weight"))
    return a.crossJoin(F.broadcast(b))  # one row each


def dangling_edges(s, d):
    e = _edges(s, d).filter("from_id IS NOT NULL AND to_id IS NOT NULL").select("id", "kind", "from_id", "to_id")
    live = G.live_edges(e, _nodes(s, d, "id")).select("id")
    return e.join(live, "id", "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("n_dangling"))


def edge_merge(s, d):
    return G.merge_edges(_edges(s, d)).withColumn("symbols", F.array_join("symbols", ","))


def level_rollup(s, d):
    return G.level_rollup(_paths(s, d), _edges(s, d), "app:harbor-api")


def outside_flows(s, d):
    return G.outside_flows(_paths(s, d), _edges(s, d), "app:harbor-api")


def breadcrumb(s, d):
    p = _paths(s, d).filter("path IS NOT NULL")
    return p.select("node_id", F.array_join("path", " / ").alias("crumbs"))


def nearest_kind(s, d):
    return G.nearest_of_kind(_paths(s, d), _nodes(s, d, "id", "kind"), "module")


def dominant_zone(s, d):
    files = _nodes(s, d, "id", "kind", "zone", "parent_id").filter("kind = 'file' AND parent_id IS NOT NULL")
    return G.dominant(files.withColumnRenamed("parent_id", "module_id"), "module_id", "zone", ["test", "config"])


def search_ranked(s, d):
    return G.ranked_search(_nodes(s, d, "id", "kind", "name", "path"), " Ledger ")


def neighbours_topk(s, d):
    return G.neighbours(_edges(s, d), 10)


def types_used(s, d):
    t = _nodes(s, d, "id", "kind").filter("kind = 'type'").select(F.col("id").alias("to_id"))
    use = _edges(s, d).filter("kind = 'references' AND from_id IS NOT NULL").join(t, "to_id", "left_semi").groupBy("from_id", "to_id").agg(F.sum("weight").alias("weight"))
    w = W.partitionBy("from_id").orderBy(F.desc("weight"), "to_id")
    return use.withColumn("place", F.row_number().over(w)).filter("place <= 12")


def type_usage(s, d):
    t = _nodes(s, d, "id", "kind").filter("kind = 'type'").select(F.col("id").alias("to_id"))
    return _edges(s, d).filter("kind = 'references' AND from_id <> to_id").join(t, "to_id", "left_semi").groupBy("to_id").agg(F.sum("weight").alias("usage"))


def connection_weight(s, d):
    e = _edges(s, d).filter("kind <> 'contains'")
    return e.select(F.explode(F.array("from_id", "to_id")).alias("id"), "weight").filter("id IS NOT NULL").groupBy("id").agg(F.sum("weight").alias("connections"))


def display_order(s, d):
    order = F.array_position(F.array(*map(F.lit, G.KIND_ORDER)), F.col("kind"))
    w = W.partitionBy("parent_id").orderBy(order, "name", "id")
    return _nodes(s, d, "id", "parent_id", "kind", "name").filter("parent_id IS NOT NULL").withColumn("place", F.row_number().over(w)).select("parent_id", "place", "name")


def what_calls(s, d):
    n = _nodes(s, d, "id", "kind", "name").select(F.col("id").alias("from_id"), "kind", "name")
    hot = _edges(s, d).filter("kind = 'references'").groupBy("to_id").agg(F.count(F.lit(1)).alias("c")).filter("to_id IS NOT NULL").orderBy(F.desc("c"), "to_id").limit(1)
    e = _edges(s, d).filter("kind = 'references'").join(F.broadcast(hot), "to_id", "left_semi")  # one row
    return e.select("from_id", "weight").join(n, "from_id").orderBy(F.desc("weight"), "from_id").limit(60)


def trace(s, d):
    starts = _nodes(s, d, "id", "kind").filter("kind = 'endpoint'").select("id")
    e = _edges(s, d).withColumn("kind", F.when(F.col("kind").isin("references", "exposed-by"), "step").otherwise(F.col("kind")))
    return G.reach(e, starts, 3, "step").select("start_id", "node_id", "hops")


def unimported(s, d):
    n = _nodes(s, d, "id", "kind", "path", "zone", "meta").filter("kind = 'file' AND zone NOT IN ('test', 'config')")
    uses = _edges(s, d).filter("kind = 'imports'").select(F.col("to_id").alias("id"))
    c = n.select("id", F.col("meta.loc").alias("loc"))
    return G.unused(c, uses, [F.desc_nulls_last("loc"), F.col("id")])


def where_to_look_first(s, d):
    """The ten files that most of the code comes back to: PageRank over imports, reversed as in reading order."""
    n = _nodes(s, d, "id", "kind", "zone", "path", "summary", "meta").filter("kind = 'file' AND zone <> 'test'").filter(K.retirement(F.col("path"), F.col("zone"), F.col("summary")).isNull())
    imports = _edges(s, d).filter("kind = 'imports' AND from_id IS NOT NULL AND to_id IS NOT NULL")
    links = imports.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    holds = n.filter("meta.function_count + meta.type_count > 0").select("id")
    return G.rank(n, links).join(holds, "id", "left_semi").join(imports.select(F.col("from_id").alias("id")).distinct(), "id", "left_semi").orderBy(F.desc(F.round("score", 12)), "id").limit(10).select("id", F.round("score", 9).alias("score"))


def group_links(s, d):
    """Imports between the top folders of files."""
    n = _nodes(s, d, "id", "kind", "path").filter("kind = 'file'").select("id", F.substring_index("path", "/", 3).alias("g"))
    e = _edges(s, d).filter("kind IN ('imports', 'references')")
    a = e.join(n.select(F.col("id").alias("from_id"), F.col("g").alias("from_group")), "from_id").join(n.select(F.col("id").alias("to_id"), F.col("g").alias("to_group")), "to_id")
    return a.filter("from_group <> to_group").groupBy("from_group", "to_group").agg(F.sum("weight").alias("weight"))


def longest_prefix(s, d):
    n = _nodes(s, d, "id", "kind", "path").filter("path IS NOT NULL")
    folders = n.filter("kind = 'module'").select(F.col("path").alias("folder"))
    return G.longest_prefix(n.filter("kind = 'file'").select("path"), folders)


def interval_containment(s, d):
    """The type that each function stands in, by lines."""
    n = _nodes(s, d, "id", "kind", "path", "start_line", "end_line").filter("path IS NOT NULL AND start_line IS NOT NULL")
    spans = n.filter("kind = 'type'").select(F.col("path").alias("file"), F.col("start_line").alias("first"), F.col("end_line").alias("last"), F.col("id").alias("span"))
    points = n.filter("kind = 'function'").select("id", F.col("path").alias("file"), F.col("start_line").alias("at"))
    return G.contained(points, spans).select("id", "span")


def _at(day: str):
    return F.lit(day).cast("timestamp_ntz")


def snapshot_diff(s, d):
    n = _nodes(s, d, "id", "kind", "hash", "recorded_at", "removed_at")
    return T.diff(T.snapshot(n, _at("2025-04-01")), T.snapshot(n, _at("2025-06-01"))).groupBy("kind", "change").agg(F.count(F.lit(1)).alias("n"))


def stale_docs(s, d):
    """The later snapshot has other bodies for every seventh node, by ordinal."""
    n = _nodes(s, d, "id", "ordinal", "summary_source", "doc_hash", "body_hash")
    later = n.withColumn("body_hash", F.when(F.col("ordinal") % 7 == 0, F.concat(F.col("body_hash"), F.lit("x"))).otherwise(F.col("body_hash")))
    return T.stale_docs(n, later)


def last_delivery(s, d):
    return T.last_wins(table(s, d, "explanations", "cache_key", "tier", "loaded_at"), "cache_key", "loaded_at").select("cache_key", "tier", F.col("loaded_at").cast("string").substr(1, 19).alias("loaded"))


def unique_suffix(s, d):
    return T.unique_names(_nodes(s, d, "id", "kind", "name").filter("kind = 'module'"), "name", "id").select("id", "unique_name")


def explanation_queue(s, d):
    """Documented work that no cached text answers: nodes without an explanation of their hash."""
    n = _nodes(s, d, "id", "kind", "hash").filter("kind IN ('file', 'function', 'type')")
    x = table(s, d, "explanations", "hash").filter("hash IS NOT NULL").distinct()
    return n.join(x, "hash", "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("n_waiting"))


def cache_plan(s, d):
    files = _nodes(s, d, "id", "kind", "hash", "ordinal").filter("kind = 'file'").select(F.col("id").alias("path"), "hash", "ordinal")
    cached = files.filter("ordinal % 11 <> 0").withColumn("hash", F.when(F.col("ordinal") % 5 == 0, "old").otherwise(F.col("hash")))
    uses = _edges(s, d).filter("kind = 'imports'").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return T.cache_plan(files.filter("ordinal % 13 <> 0"), cached, uses)


def quiet_batches(s, d):
    e = table(s, d, "events", "user_id", "ts")
    return T.quiet_batches(e, "user_id", "ts", "30 minutes").select("user_id", F.col("started").cast("string").substr(1, 19).alias("started"), "n")


def content_hashes(s, d):
    docs = table(s, d, "documents", "doc_id", "text", "source")
    return docs.select("doc_id", S.content_hash(F.col("text")).alias("content_hash"), S.parts_hash(F.col("source"), F.col("text")).alias("parts_hash"))


def path_functions(s, d):
    p = F.col("path")
    return table(s, d, "extracts", "extract_id", "path").dropDuplicates(["extract_id"]).select("extract_id", S.folder_of(p).alias("folder"), S.base_name(p).alias("base"), S.extension_of(p).alias("ext"), S.module_of(p).alias("module"))


def hosts(s, d):
    u = table(s, d, "appsettings", "setting_id", "base_url").dropDuplicates(["setting_id"])
    h = S.host_of(F.col("base_url"))
    return u.select("setting_id", h.alias("host"), S.is_internal(h).alias("internal"), S.path_pattern(F.regexp_replace("base_url", "^[a-z]+://[^/]*", "")).alias("pattern"))


def first_sentences(s, d):
    n = _nodes(s, d, "id", "summary").filter("summary IS NOT NULL")
    return n.select("id", S.first_sentence(F.col("summary")).alias("first"), S.clip(F.col("summary"), 48).alias("clipped"))


def event_endpoints(s, d):
    """Events as endpoints of their type: sites counted, any expensive, the first and last."""
    e = table(s, d, "events", "event_id", "event_type", "value", "user_id")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_sites"), F.bool_or(F.col("value") > 90).alias("writes"), F.countDistinct("user_id").alias("n_users"), F.min("event_id").alias("first_id"))


_ALL = (
    nodes_of_kind, children_count, zone_counts, stats_rollup, dangling_edges, edge_merge, level_rollup, outside_flows, breadcrumb, nearest_kind, dominant_zone, search_ranked, neighbours_topk, types_used, type_usage,
    connection_weight, display_order, what_calls, trace, unimported, where_to_look_first, group_links, longest_prefix, interval_containment, snapshot_diff, stale_docs, last_delivery, unique_suffix, explanation_queue,
    cache_plan, quiet_batches, content_hashes, path_functions, hosts, first_sentences, event_endpoints,
)
QUERIES = {q.__name__: q for q in _ALL}

_N = "n AS (SELECT DISTINCT ON (id) * FROM (SELECT * FROM nodes UNION ALL SELECT * FROM shared_nodes) ORDER BY id)"
_E = "e AS (SELECT DISTINCT ON (id) * FROM edges ORDER BY id)"
_P = f"""{_N}, par AS (SELECT id, CASE WHEN parent_id IN (SELECT id FROM n) THEN parent_id END AS parent_id FROM n),
 p AS (SELECT id AS node_id, [id] AS path FROM par WHERE parent_id IS NULL UNION ALL SELECT par.id, list_append(p.path, par.id) FROM par JOIN p ON par.parent_id = p.node_id)"""
_C = "c AS (SELECT node_id, path[list_position(path, 'app:harbor-api') + 1] AS child FROM p WHERE list_position(path, 'app:harbor-api') > 0 AND list_position(path, 'app:harbor-api') < len(path))"
_KIND = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(G.KIND_ORDER, 1)) + " ELSE 0 END"
_FLAT = "trim(regexp_replace(summary, '\\s+', ' ', 'g'))"

SQL = {
    "nodes_of_kind": f"WITH {_N} SELECT id, name FROM n WHERE kind = 'endpoint'",
    "children_count": f"WITH {_N} SELECT parent_id, count(*) AS n_children FROM n WHERE parent_id IS NOT NULL GROUP BY 1",
    "zone_counts": f"WITH {_N} SELECT zone, count(*) AS n_files FROM n WHERE kind = 'file' GROUP BY 1",
    "stats_rollup": f"WITH {_N}, {_E} SELECT * FROM (SELECT " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}s" for k in ("app", "module", "file", "type", "function", "endpoint", "service", "store"))
    + ", count(*) FILTER (summary_source = 'docs') AS n_documented, sum(meta.loc)::BIGINT AS lines, count(DISTINCT lower(language)) AS n_languages FROM n), (SELECT count(*) AS n_edges, count(*) FILTER (confidence = 'likely') AS n_likely, sum(weight)::BIGINT AS total_weight FROM e)",
    "dangling_edges": f"WITH {_N}, {_E} SELECT kind, count(*) AS n_dangling FROM e WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND (from_id NOT IN (SELECT id FROM n) OR to_id NOT IN (SELECT id FROM n)) GROUP BY 1",
    "edge_merge": f"""WITH {_E} SELECT kind, from_id, to_id, sum(weight)::BIGINT AS weight, arg_min(confidence, ordinal) AS confidence,
        coalesce(array_to_string(list_sort(list_distinct(flatten(list(coalesce(meta.symbols, []::VARCHAR[]))))), ','), '') AS symbols FROM e GROUP BY ALL""",
    "level_rollup": f"""WITH RECURSIVE {_P}, {_E}, {_C} SELECT a.child AS from_id, b.child AS to_id, sum(weight)::BIGINT AS weight, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds
        FROM e JOIN c a ON e.from_id = a.node_id JOIN c b ON e.to_id = b.node_id WHERE kind <> 'contains' AND a.child <> b.child GROUP BY 1, 2""",
    "outside_flows": f"""WITH RECURSIVE {_P}, {_E}, {_C}, j AS (SELECT a.child AS cf, b.child AS ct, weight FROM e LEFT JOIN c a ON e.from_id = a.node_id LEFT JOIN c b ON e.to_id = b.node_id WHERE kind <> 'contains' AND from_id IS NOT NULL AND to_id IS NOT NULL)
        SELECT cf AS child, 'out' AS direction, sum(weight)::BIGINT AS weight FROM j WHERE cf IS NOT NULL AND ct IS NULL GROUP BY 1 UNION ALL SELECT ct, 'in', sum(weight)::BIGINT FROM j WHERE ct IS NOT NULL AND cf IS NULL GROUP BY 1""",
    "breadcrumb": f"WITH RECURSIVE {_P} SELECT node_id, array_to_string(path, ' / ') AS crumbs FROM p",
    "nearest_kind": f"""WITH RECURSIVE {_P}, u AS (SELECT node_id, unnest(path) AS a, unnest(range(1, len(path) + 1)) AS i FROM p)
        SELECT node_id, arg_max(a, i) AS nearest_id FROM u JOIN n ON u.a = n.id WHERE n.kind = 'module' GROUP BY 1""",
    "dominant_zone": f"""WITH {_N}, k AS (SELECT parent_id AS module_id, zone, count(*) AS n FROM n WHERE kind = 'file' AND parent_id IS NOT NULL GROUP BY 1, 2)
        SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY module_id ORDER BY zone NOT IN ('test', 'config') DESC, n DESC, zone) = 1""",
    "search_ranked": f"""WITH {_N} SELECT id, name, kind, (b + CASE kind WHEN 'module' THEN 8 WHEN 'file' THEN 6 WHEN 'type' THEN 4 ELSE 0 END)::INT AS score FROM (SELECT *, CASE WHEN lower(name) = 'ledger' THEN 100 WHEN starts_with(lower(name), 'ledger') THEN 80
        WHEN contains(lower(name), 'ledger') THEN 60 WHEN contains(lower(path), 'ledger') THEN 30 END AS b FROM n) WHERE b IS NOT NULL ORDER BY score DESC, length(name), id LIMIT 30""",
    "neighbours_topk": f"""WITH {_E}, b AS (SELECT from_id AS node_id, 'out' AS direction, to_id AS other_id, kind, weight FROM e WHERE kind <> 'contains' AND from_id IS NOT NULL AND to_id IS NOT NULL
        UNION ALL SELECT to_id, 'in', from_id, kind, weight FROM e WHERE kind <> 'contains' AND from_id IS NOT NULL AND to_id IS NOT NULL)
        SELECT *, row_number() OVER (PARTITION BY node_id, direction ORDER BY weight DESC, other_id, kind)::INT AS place, count(*) OVER (PARTITION BY node_id, direction) AS total FROM b QUALIFY place <= 10""",
    "types_used": f"""WITH {_N}, {_E} SELECT from_id, to_id, sum(weight)::BIGINT AS weight, row_number() OVER (PARTITION BY from_id ORDER BY sum(weight) DESC, to_id)::INT AS place FROM e
        WHERE kind = 'references' AND from_id IS NOT NULL AND to_id IN (SELECT id FROM n WHERE kind = 'type') GROUP BY 1, 2 QUALIFY place <= 12""",
    "type_usage": f"WITH {_N}, {_E} SELECT to_id, sum(weight)::BIGINT AS usage FROM e WHERE kind = 'references' AND from_id <> to_id AND to_id IN (SELECT id FROM n WHERE kind = 'type') GROUP BY 1",
    "connection_weight": f"WITH {_E}, b AS (SELECT from_id AS id, weight FROM e WHERE kind <> 'contains' UNION ALL SELECT to_id, weight FROM e WHERE kind <> 'contains') SELECT id, sum(weight)::BIGINT AS connections FROM b WHERE id IS NOT NULL GROUP BY 1",
    "display_order": f"WITH {_N} SELECT parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY {_KIND}, name, id)::INT AS place, name FROM n WHERE parent_id IS NOT NULL",
    "what_calls": f"""WITH {_N}, {_E}, hot AS (SELECT to_id FROM e WHERE kind = 'references' AND to_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, to_id LIMIT 1)
        SELECT from_id, weight, n.kind, n.name FROM e JOIN hot USING (to_id) JOIN n ON n.id = from_id WHERE e.kind = 'references' ORDER BY weight DESC, from_id LIMIT 60""",
    "trace": f"""WITH RECURSIVE {_N}, {_E}, st AS (SELECT DISTINCT from_id, to_id FROM e WHERE kind IN ('references', 'exposed-by') AND from_id IS NOT NULL AND to_id IS NOT NULL),
        r AS (SELECT id AS start_id, id AS node_id, 0 AS hops FROM n WHERE kind = 'endpoint' UNION SELECT start_id, to_id, hops + 1 FROM r JOIN st ON from_id = node_id WHERE hops < 3)
        SELECT start_id, node_id, min(hops)::INT AS hops FROM r GROUP BY 1, 2 HAVING min(hops) > 0""",
    "unimported": f"WITH {_N}, {_E} SELECT id, meta.loc AS loc FROM n WHERE kind = 'file' AND zone NOT IN ('test', 'config') AND id NOT IN (SELECT to_id FROM e WHERE kind = 'imports' AND to_id IS NOT NULL)",
    "group_links": f"""WITH {_N}, {_E}, g AS (SELECT id, array_to_string(string_split(path, '/')[1:3], '/') AS g FROM n WHERE kind = 'file') SELECT a.g AS from_group, b.g AS to_group, sum(weight)::BIGINT AS weight FROM e JOIN g a ON a.id = from_id JOIN g b ON b.id = to_id
        WHERE e.kind IN ('imports', 'references') AND a.g <> b.g GROUP BY 1, 2""",
    "longest_prefix": f"""WITH {_N}, f AS (SELECT DISTINCT path FROM n WHERE kind = 'file' AND path IS NOT NULL), m AS (SELECT DISTINCT path AS folder FROM n WHERE kind = 'module' AND path IS NOT NULL)
        SELECT path, arg_max(folder, length(folder)) AS folder FROM f LEFT JOIN m ON path = folder OR starts_with(path, folder || '/') GROUP BY 1""",
    "interval_containment": f"""WITH {_N} SELECT f.id, arg_min(t.id, ((t.end_line - t.start_line), t.id)) AS span FROM n f LEFT JOIN n t ON t.kind = 'type' AND t.path = f.path AND t.start_line <= f.start_line AND f.start_line <= t.end_line
        WHERE f.kind = 'function' AND f.path IS NOT NULL AND f.start_line IS NOT NULL GROUP BY 1""",
    "snapshot_diff": f"""WITH {_N}, a AS (SELECT * FROM n WHERE recorded_at <= TIMESTAMP '2025-04-01' AND (removed_at IS NULL OR removed_at > TIMESTAMP '2025-04-01')), b AS (SELECT * FROM n WHERE recorded_at <= TIMESTAMP '2025-06-01' AND (removed_at IS NULL OR removed_at > TIMESTAMP '2025-06-01'))
        SELECT coalesce(b.kind, a.kind) AS kind, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.hash IS DISTINCT FROM b.hash THEN 'changed' END AS change, count(*) AS n FROM a FULL JOIN b ON a.id = b.id GROUP BY 1, 2 HAVING change IS NOT NULL""",
    "stale_docs": f"WITH {_N} SELECT id, coalesce(ordinal % 7 = 0 AND body_hash IS NOT NULL, false) AS stale FROM n WHERE summary_source = 'docs' AND doc_hash IS NOT NULL",
    "last_delivery": "SELECT cache_key, arg_max(tier, loaded_at) AS tier, strftime(max(loaded_at), '%Y-%m-%d %H:%M:%S') AS loaded FROM explanations GROUP BY 1",
    "unique_suffix": f"WITH {_N}, r AS (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM n WHERE kind = 'module') SELECT id, CASE WHEN k > 1 THEN name || '~' || k ELSE name END AS unique_name FROM r",
    "explanation_queue": f"WITH {_N} SELECT kind, count(*) AS n_waiting FROM n WHERE kind IN ('file', 'function', 'type') AND hash NOT IN (SELECT hash FROM explanations WHERE hash IS NOT NULL) GROUP BY 1",
    "cache_plan": f"""WITH {_N}, {_E}, f AS (SELECT id, hash, ordinal FROM n WHERE kind = 'file'), s AS (SELECT id AS path, CASE WHEN ordinal % 11 = 0 THEN 'new' WHEN ordinal % 13 = 0 THEN 'gone' WHEN ordinal % 5 = 0 THEN 'changed' ELSE 'reuse' END AS state
        FROM f WHERE NOT (ordinal % 11 = 0 AND ordinal % 13 = 0)), t AS (SELECT DISTINCT from_id FROM e JOIN s ON to_id = path WHERE kind = 'imports' AND state <> 'reuse')
        SELECT path, CASE WHEN state = 'reuse' AND path IN (SELECT from_id FROM t WHERE from_id IS NOT NULL) THEN 'importer' ELSE state END AS state FROM s""",
    "quiet_batches": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM b GROUP BY user_id, k""",
    "content_hashes": "SELECT doc_id, substr(sha256(regexp_replace(regexp_replace(text, '\\r\\n', chr(10), 'g'), '[ \\t]+(\\n|\\z)', '\\1', 'g')), 1, 16) AS content_hash, substr(sha256(coalesce(source, '') || chr(0) || coalesce(text, '')), 1, 16) AS parts_hash FROM documents",
    "path_functions": """SELECT DISTINCT extract_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '[^/]*$', 0) AS base, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS ext, regexp_replace(regexp_replace(path, '\\.[^./]+$', ''), '(^|/)(index|__init__)$', '') AS module FROM extracts""",
    "hosts": """SELECT DISTINCT setting_id, h AS host, h = 'localhost' OR ends_with(h, '.local') OR ends_with(h, '.internal') OR regexp_full_match(h, '\\d{1,3}(\\.\\d{1,3}){3}') AS internal, lower(regexp_replace(base_url, '^[a-z]+://[^/]*', '')) AS pattern
        FROM (SELECT *, nullif(lower(regexp_extract(base_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS h FROM appsettings)""",
    "first_sentences": f"""WITH {_N} SELECT id, rtrim(substr(CASE WHEN regexp_matches({_FLAT}, '[.!?]( |$)') THEN regexp_extract({_FLAT}, '^(.*?[.!?])(?: |$)', 1) ELSE {_FLAT} END, 1, 160)) AS first,
        CASE WHEN length({_FLAT}) > 48 THEN rtrim(substr({_FLAT}, 1, 47)) || '…' ELSE {_FLAT} END AS clipped FROM n WHERE summary IS NOT NULL""",
    "event_endpoints": "SELECT event_type, count(*) AS n_sites, bool_or(value > 90) AS writes, count(DISTINCT user_id) AS n_users, min(event_id) AS first_id FROM events GROUP BY 1",
}
