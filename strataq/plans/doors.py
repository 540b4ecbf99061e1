"""Queries on doors, zones, columns and groups over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataq.functions import classes as K
from strataq.operators import doors as D
from strataq.operators import graph as G
from strataq.operators import groups as P
from strataq.operators import history as T
from strataq.operators import views as V
from strataq.plans.doors_sql import sql
from strataq.plans.facts import _edges, _nodes, _paths
from strataq.sources.tables import table


def _doors(s, d):
    """Endpoints with what their id and name say (``endpoint:KIND:METHOD ROUTE``) and how many edges stand before and behind."""
    n = _nodes(s, d, "id", "kind", "name", "path", "recorded_at", "removed_at").filter("kind = 'endpoint'").drop("kind")
    e = _edges(s, d).filter("from_id IS NOT NULL AND to_id IS NOT NULL")
    counts = e.filter("kind IN ('protected-by', 'exposed-by')").groupBy(F.col("from_id").alias("id")).agg(
        F.count_if(F.col("kind") == "protected-by").alias("n_guards"), F.count_if((F.col("kind") == "protected-by") & (F.col("confidence") == "certain")).alias("n_certain"), F.count_if(F.col("kind") == "exposed-by").alias("n_handlers")
    )
    method, route = F.regexp_extract("name", r"^([A-Z]+) (.*)$", 1), F.regexp_extract("name", r"^([A-Z]+) (.*)$", 2)
    return n.join(counts, "id", "left").na.fill(0, ["n_guards", "n_certain", "n_handlers"]).select(
        "*", F.regexp_extract("id", "^endpoint:([^:]+):", 1).alias("endpoint_kind"), method.alias("method"), route.alias("route"), (~method.isin("GET", "HEAD", "PAGE")).alias("writes"), F.lit(False).alias("verified")
    )


def _stores(s, d):
    return _nodes(s, d, "id", "kind").filter("kind = 'store'").select("id")


def node_by_id(s, d):
    return _nodes(s, d, "id", "kind", "name", "parent_id").filter("id = 'store:cache-kv'")


def children_of(s, d):
    return _nodes(s, d, "id", "parent_id", "kind", "name").filter("parent_id = 'zone:outbound'").select("id", "kind", "name")


def writing_doors(s, d):
    return D.writing_doors(_edges(s, d), _stores(s, d))


def store_doors(s, d):
    """The doors that reach each store or service, one step behind their handlers."""
    targets = _nodes(s, d, "id", "kind").filter("kind IN ('store', 'service')").select("id")
    return D.reaching_doors(_edges(s, d), _doors(s, d), targets, ["reads-from", "writes-to"])


def _verdicts(s, d):
    """A file whose content is missing stands for one that could not be read; a file with an edge to a service for a mount."""
    doors = _doors(s, d).withColumns({"sign_in": F.lit(None).cast("string"), "generated": F.col("path").rlike("(^|/)generated/")})
    files = doors.filter("path IS NOT NULL").select(F.col("id").alias("door_id"), F.concat(F.lit("file:"), "path").alias("file_id"), F.lit(0).alias("place"))
    e = _edges(s, d)
    unread = table(s, d, "extracts", "file_id", "path", "content").filter("content IS NULL").select("file_id", "path").distinct()
    mounts = e.filter("to_id LIKE 'service:%' AND from_id LIKE 'file:%'").groupBy(F.col("from_id").alias("file_id")).agg(F.min("to_id").alias("provider"))
    return doors, D.open_doors(doors, files, e.filter("kind = 'imports'"), unread, mounts, D.writing_doors(e, _stores(s, d)))


def open_doors(s, d):
    return _verdicts(s, d)[1].select("id", "verdict", "because")


def open_door_tally(s, d):
    return open_doors(s, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n_doors"))


def auth_insights(s, d):
    """Every door that a check is expected before, with its protection, in the order of reading."""
    doors, verdicts = _verdicts(s, d)
    protection = F.when(F.col("n_certain") > 0, "certain").when(F.col("n_guards") > 0, "likely").otherwise("none")
    rows = doors.filter(D.is_auth_relevant(F.col("endpoint_kind"))).join(verdicts, "id", "left").withColumn("protection", protection)
    return rows.select("id", K.door_label(F.col("method"), F.col("route"), F.col("name")).alias("label"), "protection", "verdict", D.urgency(F.col("verdict"), F.col("writes"), F.col("protection")).alias("urgency")).orderBy("urgency", "label", "id")


def entry_points(s, d):
    return D.entry_points(_doors(s, d).withColumn("n_sites", F.lit(1)), 5).select("id", "score")


def guard_reach(s, d):
    """Who calls a function that stands before some door, within three steps."""
    e = _edges(s, d)
    guards = D.behind(e, "protected-by").select(F.col("node_id").alias("id")).distinct()
    return D.guard_reach(guards, e.filter("kind = 'references'"), 3).groupBy("guard_id", "hops").agg(F.count(F.lit(1)).alias("n_callers"))


def _snap(rows, day):
    return T.snapshot(rows, F.lit(day).cast("timestamp_ntz"))


def door_diff(s, d):
    """Doors of two days; on the later day those whose name ends in an r have lost their checks."""
    doors = _doors(s, d)
    later = doors.withColumn("n_guards", F.when(F.col("name").endswith("r"), 0).otherwise(F.col("n_guards")))
    return D.door_diff(_snap(doors, "2025-05-01"), _snap(later, "2025-07-01")).select("id", "change", "writes")


def comparable(s, d):
    facts = lambda day: _snap(_nodes(s, d, "id", "recorded_at", "removed_at"), day).agg(F.count(F.lit(1)).alias("nodes")).select(F.lit(3).alias("format"), "nodes")
    return D.comparable(facts("2025-05-01"), facts("2025-05-01"), ["format", "nodes"])


def endpoint_merge(s, d):
    """Events as findings of doors: one per type and user's last digit."""
    e = table(s, d, "events", "event_id", "event_type", "user_id", "value")
    found = e.select(
        F.lit("http-route").alias("endpoint_kind"), F.concat_ws(" ", F.upper("event_type"), F.concat(F.lit("/u/"), (F.col("user_id") % 10).cast("string"))).alias("key"), F.col("event_id").alias("ordinal"), F.concat(F.lit("e"), F.col("event_id")).alias("name"),
        F.upper("event_type").alias("method"), F.concat(F.lit("/u/"), (F.col("user_id") % 10).cast("string")).alias("route"), (F.col("value") > 99).alias("writes"), F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("s"), F.col("event_id"))).alias("schedule"),
        F.concat(F.lit("h"), F.col("user_id") % 7).alias("handler"), F.concat(F.lit("p"), F.col("user_id")).alias("path"), F.col("event_id").alias("line"),
    )
    return D.merge_endpoints(found).select("endpoint_kind", "key", "name", "writes", "schedule", F.array_join("handlers", ",").alias("handlers"), F.size("sites").alias("n_sites"), F.get("sites", F.lit(0))["path"].alias("first_path"))


def _uses(s, d):
    e = _edges(s, d).filter("kind IN ('reads-from', 'writes-to') AND from_id IS NOT NULL")
    return e.withColumns({"operation": F.when(F.col("kind") == "writes-to", "write").otherwise("read"), "of": F.regexp_extract("from_id", "^[a-z]+:([^#]*)", 1)})


def service_merge(s, d):
    u = _uses(s, d).filter("to_id LIKE 'service:%'")
    found = u.select(K.sentence_case(F.lower(F.substring_index("to_id", ":", -1))).alias("name"), F.lit("other").alias("category"), F.get(F.split("of", "/"), F.lit(1)).alias("package"), F.lit(None).cast("string").alias("host"), (F.col("operation") == "write").alias("sends"), "ordinal")
    return D.merge_services(found).select("key", "name", "n_sites", F.array_join("packages", ",").alias("packages"), "sends")


def store_merge(s, d):
    u = _uses(s, d).filter("to_id LIKE 'store:%'")
    return D.merge_stores(u.select(F.substring_index("to_id", ":", -1).alias("store"), F.get(F.split("of", "/"), F.lit(0)).alias("table"), "operation", "ordinal")).select("key", "n_reads", "n_writes", F.array_join("tables", ",").alias("tables"))


def env_inventory(s, d):
    """Environment variables read in the source files of any language, and whether a configuration excerpt names them."""
    import_ = r"(?:process\.env\.|os\.environ\[[\"']|os\.getenv\([\"']|os\.Getenv\(\"|env::var\(\"|GetEnvironmentVariable\(\")([A-Z][A-Z0-9_]+)"
    x = table(s, d, "src", "src_id", "rel_path", "secret").dropDuplicates(["src_id"])
    reads = x.select(F.col("rel_path").alias("path"), F.explode(F.regexp_extract_all("secret", F.lit(import_), F.lit(1))).alias("name")).withColumn("has_default", F.lit(False))
    names = x.select(F.explode(F.regexp_extract_all("secret", F.lit(r"(?m)^([A-Z][A-Z0-9_]+)="), F.lit(1))).alias("name"))
    return D.env_inventory(reads, names)


def flow_edges(s, d):
    """What doors read and write, as edges between doors and stores or services (A door's handler's uses become the door's)."""
    e = _edges(s, d)
    use = e.filter("kind IN ('reads-from', 'writes-to') AND from_id IS NOT NULL").groupBy(F.col("from_id").alias("node_id"), "to_id", "kind").agg(F.sum("weight").alias("weight"))
    return D.behind(e, "exposed-by").join(use, "node_id").groupBy(F.col("door_id").alias("from_id"), "to_id", "kind").agg(F.sum("weight").alias("weight"))


def distinct_guards(s, d):
    e = _edges(s, d).filter("kind = 'protected-by' AND from_id IS NOT NULL")
    n = _nodes(s, d, "id", "name", "path", "start_line").withColumnRenamed("id", "to_id")
    found = e.join(n, "to_id").select(F.lit("all").alias("door_id"), "name", "path", F.col("start_line").alias("line"), "confidence")
    return D.distinct_guards(found)


_MATCHERS = [("/beacon-:n/:path*", None), ("/:a/:b", None), ("/*", "^/flint"), ("/:top/auth/:rest+", None), ("/([", None)]


def matcher_join(s, d):
    m = s.createDataFrame(_MATCHERS, "matcher string, excludes string")
    return D.matched_routes(_doors(s, d).filter("route <> ''"), m)


def boundary_cards(s, d):
    """Doors by scope of their path and method, the three largest of each and one row for the rest."""
    rows = _doors(s, d).filter("path IS NOT NULL").groupBy(F.substring_index("path", "/", 1).alias("family"), F.col("endpoint_kind").alias("card")).agg(F.count(F.lit(1)).alias("paths"))
    return D.residual_top(rows, "family", "card", "paths", 1)


def zone_of_path(s, d):
    return _nodes(s, d, "id", "kind", "path").filter("kind = 'file'").select("id", K.zone_of(F.col("path")).alias("zone_by_path"))


_COLUMNS = (
    "email emailAddress customer_email user-name file_name hostName dob applicant_dob birthDate first_name lastNames phone_no mobileNumber card_number ip client_ip device_id app_email template_name full_name age city postal_address"
    " billing_address account_number wallet_address contact_phone status_name password_hash user_password order_total diagnosis EMAIL e_mail_address _ssn_ group_email owner_city owner_name x"
).split()


def personal_columns(s, d):
    c = s.createDataFrame([(x,) for x in _COLUMNS], "name string")
    return c.select("name", K.personal_column(F.col("name")).alias("p")).select("name", "p.category", "p.strength")


def personal_tables(s, d):
    """Types as tables whose functions are columns: which hold personal data, by direct matches, and which by ambiguous alone."""
    n = _nodes(s, d, "id", "kind", "name", "parent_id")
    fields = n.filter("kind = 'function'").select(F.col("parent_id").alias("table_id"), F.regexp_replace("name", "^[a-z]+(?=[A-Z_])", "").alias("column"))
    judged = fields.withColumn("p", K.personal_column(F.col("column")))
    per = judged.groupBy("table_id").agg(F.count_if(F.col("p.strength") == "direct").alias("n_direct"), F.count_if(F.col("p.strength") == "ambiguous").alias("n_ambiguous"), F.count(F.lit(1)).alias("n_columns"))
    return n.filter("kind = 'type'").select(F.col("id").alias("table_id")).join(per, "table_id").orderBy(F.desc("n_direct"), F.desc("n_columns"), "table_id")


def retired_files(s, d):
    n = _nodes(s, d, "id", "kind", "path", "zone", "summary").filter("kind IN ('file', 'function')")
    return n.select("id", K.retirement(F.col("path"), F.col("zone"), F.col("summary")).alias("r")).filter("r IS NOT NULL").select("id", "r.evidence", "r.says")


def route_of_file(s, d):
    n = _nodes(s, d, "id", "kind", "path").filter("kind = 'file'")
    rest = F.regexp_replace("path", "^[^/]*/", "")
    return n.select("id", K.file_route(rest).alias("folders"), K.file_route(rest, True).alias("whole"))


_SPECIFIERS = ["./x", "../lib/y.ts", "../../z", "@/core/a", "~/b.tsx", "#c", "react", ".././q/../w.mjs"]


def specifier_resolution(s, d):
    x = s.createDataFrame([(i, v) for i, v in enumerate(_SPECIFIERS)], "n int, specifier string")
    return x.select("n", K.resolve_specifier(F.col("specifier"), F.lit("apps/web/src/page.ts")).alias("path"))


def edge_labels(s, d):
    per = _edges(s, d).filter("from_id IS NOT NULL AND to_id IS NOT NULL").groupBy("from_id", "to_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.sum("weight").alias("weight"))
    return per.select("from_id", "to_id", K.edge_label(F.col("kinds"), F.col("weight")).alias("label"))


def catalog_tables(s, d):
    names = s.createDataFrame([(x,) for x in ("orders", "information_schema.tables", "pg_class", '"sys"."objects"', "public.pg_roles", "SQLITE_MASTER", "user_tables", "user_sessions", "a.b.all_users")], "name string")
    return names.select("name", K.catalog_of(F.col("name")).alias("catalog"))


def sends_data(s, d):
    u = _edges(s, d).filter("to_id LIKE 'service:%' AND from_id IS NOT NULL")
    call = F.substring_index("from_id", "#", -1)
    return u.select("id", K.sends_data(call, F.when(F.col("to_id").contains("mail"), "email")).alias("sends"))


def phrases(s, d):
    per = _nodes(s, d, "parent_id", "name", "id", "kind").filter("kind = 'module' AND parent_id IS NOT NULL").groupBy("parent_id").agg(F.array_sort(F.collect_set("name")).alias("names"), F.count(F.lit(1)).alias("n"))
    return per.select("parent_id", K.listed(F.slice("names", 1, 4)).alias("list"), K.count_of(F.col("n"), "folder").alias("count"), K.sentence_case(F.get("names", F.lit(0))).alias("first"), K.thousands(F.col("n") * 1234).alias("big"))


def node_ids(s, d):
    n = _nodes(s, d, "id", "kind", "name", "path").filter("kind IN ('module', 'file', 'service', 'store')")
    return n.select("id", K.node_id(F.col("kind"), F.col("path"), F.substring_index("name", "/", -1)).alias("made"))


def world_flows(s, d):
    return G.world_flows(_paths(s, d), _nodes(s, d, "id", "kind"), _edges(s, d), "app:harbor-api").select("world_id", "child", "direction", "weight", "kinds", "total")


def _files(s, d):
    return _nodes(s, d, "id", "kind", "name", "path", "zone", "scope_id").filter("kind = 'file' AND path IS NOT NULL")


def module_tree(s, d):
    return P.collapse(P.folder_counts(_files(s, d)))


def _cut(s, d):
    counts = P.folder_counts(_files(s, d)).withColumn("id", F.concat_ws(":", "scope_id", "folder")).withColumnRenamed("folder", "path")
    up = F.when(F.col("path") != "", F.concat_ws(":", "scope_id", F.regexp_replace("path", "(^|/)[^/]+$", "")))
    return P.folder_cut(counts.withColumn("parent_id", up))


def group_cut(s, d):
    """The folders that the cut of each scope's tree keeps."""
    return _cut(s, d)


def file_groups(s, d):
    """Per group: its files, its zone, the other zones and the first of its names."""
    files = _files(s, d)
    g = P.assign(files, _cut(s, d).filter("path <> ''")).select("id", "group")
    shaped = P.shape(files.join(g, "id").filter("group IS NOT NULL"))
    return shaped.select("group", "n_files", "zone", F.array_join("other_zones", ",").alias("other_zones"), F.array_join("names", ",").alias("names"))


def cut_links(s, d):
    g = P.assign(_files(s, d), _cut(s, d).filter("path <> ''"))
    return P.links(_edges(s, d).filter("kind = 'imports'"), g)


def unimported_whole(s, d):
    """Exported files that nothing uses: by import, by a reference into them from another file, as a handler, check or door."""
    n = _nodes(s, d, "id", "kind", "path", "zone", "meta")
    of = n.filter("path IS NOT NULL").select(F.col("id").alias("node_id"), F.concat(F.lit("file:"), "path").alias("file_id"))
    e = _edges(s, d).filter("to_id IS NOT NULL").select("kind", "from_id", "to_id")
    to = e.filter("kind IN ('references', 'exposed-by')").groupBy("kind", "from_id", "to_id").agg(F.lit(1).alias("one"))
    inside = to.join(of.select(F.col("node_id").alias("to_id"), F.col("file_id").alias("to_file")), "to_id").join(of.select(F.col("node_id").alias("from_id"), F.col("file_id").alias("from_file")), "from_id", "left")
    used = (
        e.filter("kind IN ('imports', 'protected-by')").select(F.col("to_id").alias("id"))
        .unionByName(inside.filter("kind = 'exposed-by' OR NOT (to_file <=> from_file)").select(F.col("to_file").alias("id")))
        .unionByName(n.filter("kind = 'endpoint' AND path IS NOT NULL").select(F.concat(F.lit("file:"), "path").alias("id")))
    )
    asked = n.filter("kind = 'file' AND path IS NOT NULL AND zone NOT IN ('test', 'config')").filter(~F.col("path").rlike(r"\.d\.ts$|\.(ipynb|prisma|sql)$|(^|/)__[a-z_]+__\.pyi?$"))
    return G.unused(asked.select("id", F.col("meta.loc").alias("loc"), "path"), used, [F.desc_nulls_last("loc"), F.col("path")]).select("id", "loc")


def type_cards(s, d):
    """The sixty types most worth a card, by use, export and zone."""
    n = _nodes(s, d, "id", "kind", "name", "zone", "meta").filter("kind = 'type'")
    use = _edges(s, d).filter("kind = 'references' AND from_id <> to_id").groupBy(F.col("to_id").alias("id")).agg(F.sum("weight").alias("usage"))
    x = n.join(use, "id", "left").na.fill(0, ["usage"]).withColumn("exported", F.coalesce("meta.is_exported", F.lit(False)))
    score = F.col("usage") + F.when(F.col("exported"), 12).otherwise(0) - F.when(F.col("zone") == "test", 40).otherwise(0)
    return x.filter("exported OR usage > 0").select("id", score.cast("bigint").alias("score"), "name").orderBy(F.desc("score"), "name", "id").limit(60).select("id", "score")


def preview_names(s, d):
    order = F.array_position(F.array(*map(F.lit, G.KIND_ORDER)), F.col("kind"))
    n = _nodes(s, d, "id", "parent_id", "kind", "name").filter("parent_id IS NOT NULL")
    top = n.withColumn("place", F.row_number().over(W.partitionBy("parent_id").orderBy(order, "name", "id"))).filter("place <= 5")
    return top.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("p")).select("parent_id", F.array_join(F.transform("p", lambda x: x["name"]), ", ").alias("preview"))


def arrow_budget(s, d):
    """The forty heaviest relations between modules and all that touch the selected one."""
    e = _edges(s, d).filter("kind = 'imports' AND from_id IS NOT NULL AND to_id IS NOT NULL").groupBy("from_id", "to_id").agg(F.sum("weight").alias("weight"))
    heavy = e.orderBy(F.desc("weight"), "from_id", "to_id").limit(40)
    return heavy.unionByName(e.filter("from_id LIKE '%ledger%' AND to_id LIKE '%ledger%'")).distinct()


def label_disambiguation(s, d):
    """Modules by name; those whose name occurs again show the last two segments of their path."""
    n = _nodes(s, d, "id", "kind", "name", "path").filter("kind = 'module'")
    often = n.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return n.join(often, "name", "left").select("id", F.when(F.col("n").isNotNull(), F.substring_index("path", "/", -2)).otherwise(F.col("name")).alias("shown"))


def batches(s, d):
    """Documents in requests of twelve, numbered within each source."""
    docs = table(s, d, "documents", "doc_id", "source")
    n = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    return docs.select("doc_id", "source", F.floor(n / 12).alias("request"), (n % 12).alias("place"))


def level_filter(s, d):
    """The relations of modules that remain when tests and configuration are hidden."""
    n = _nodes(s, d, "id", "kind", "zone").filter("kind = 'file'").select("id", "zone")
    return V.filter_level(n, _edges(s, d).filter("kind = 'imports' AND from_id IS NOT NULL AND to_id IS NOT NULL").select("id", "from_id", "to_id"), ["test", "config"])[1].select("id")


def zone_flows(s, d):
    """Weights between zones of the files and functions that refer to each other."""
    n = _nodes(s, d, "id", "zone")
    e = _edges(s, d).filter("kind IN ('references', 'imports')").groupBy("from_id", "to_id").agg(F.sum("weight").alias("weight"))
    x = e.join(n.select(F.col("id").alias("from_id"), F.col("zone").alias("from_zone")), "from_id").join(n.select(F.col("id").alias("to_id"), F.col("zone").alias("to_zone")), "to_id")
    return V.flows(x, "from_zone", "to_zone", "weight")


def door_classes(s, d):
    return V.door_classes(_doors(s, d))


def language_tiers(s, d):
    return V.languages_by_tier(_nodes(s, d, "id", "kind", "language").filter("kind = 'file'"), ["go", "golang", "rust", "c#", "csharp"])


def callers_by_name(s, d):
    n = _nodes(s, d, "id", "kind", "name")
    return V.callers(n, _edges(s, d), " Savesummary ", 60)


_ALL = (
    level_filter, zone_flows, door_classes, language_tiers, callers_by_name, node_by_id, children_of, writing_doors, store_doors, open_doors, open_door_tally, auth_insights, entry_points, guard_reach, door_diff, comparable, endpoint_merge, service_merge, store_merge, env_inventory, flow_edges,
    distinct_guards, matcher_join, boundary_cards, zone_of_path, personal_columns, personal_tables, retired_files, route_of_file, specifier_resolution, edge_labels, catalog_tables, sends_data, phrases, node_ids, world_flows,
    module_tree, group_cut, file_groups, cut_links, unimported_whole, type_cards, preview_names, arrow_budget, label_disambiguation, batches,
)
QUERIES = {q.__name__: q for q in _ALL}
SQL = sql(_COLUMNS, _SPECIFIERS)
