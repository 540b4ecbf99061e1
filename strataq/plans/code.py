"""Queries on source and configuration files, and on facts in words."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.functions import classes as K
from strataq.operators import reports as R
from strataq.plans import doors as P
from strataq.plans.doors_sql import _SNAP, _V
from strataq.plans.facts import _E, _N, _nodes
from strataq.sources import boundaries as B
from strataq.sources import configs as C
from strataq.sources import declarations as L
from strataq.sources.tables import table


def _code(s, d):
    """Whole source files and the excerpts around names, as files."""
    whole = table(s, d, "extracts", "extract_id", "scope_id", "path", "content").dropDuplicates(["extract_id"])
    parts = table(s, d, "src", "src_id", "scope_id", "rel_path", "secret").dropDuplicates(["src_id"]).select("scope_id", F.col("rel_path").alias("path"), F.col("secret").alias("content"))
    return whole.select("scope_id", "path", "content").unionByName(parts)


def code_findings(s, d):
    """What the lines of all code show of doors, jobs, calls out, stores, checks and variables."""
    return B.findings(_code(s, d)).distinct()


def code_findings_counts(s, d):
    return B.findings(_code(s, d)).groupBy("kind", "framework").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("path").alias("n_files"))


_ROUTE_PATHS = ["app/(shop)/item/[id]/page.tsx", "src/app/api/x/route.ts", "pages/api/a/index.ts", "src/routes/b/[slug]/+page.svelte", "src/routes/+server.ts", "supabase/functions/hook/index.ts", "app/routes/a.$id.tsx", "app/routes/_index.tsx", "lib/x.ts"]


def route_files(s, d):
    return B.file_routes(s.createDataFrame([("s", p) for p in _ROUTE_PATHS], "scope_id string, path string")).select("path", "kind", "framework", "route")


_PORTS = ["8080:80", "127.0.0.1:5432:5432", "${PORT}:3000", '"6379"', "53:53/udp", "[::1]:80:80", "3000-3005:3000-3005", "x", "${A:-1}:2/tcp"]


def compose_port(s, d):
    return s.createDataFrame([(p,) for p in _PORTS], "raw string").select("raw", C.compose_port(F.col("raw")).alias("p")).select("raw", "p.*")


def source_slices(s, d):
    """Each endpoint's lines with one around them."""
    want = _nodes(s, d, "id", "kind", "scope_id", "path", "start_line", "end_line").filter("kind = 'endpoint' AND path IS NOT NULL").select("scope_id", "path", "start_line", "end_line").distinct()
    files = table(s, d, "extracts", "extract_id", "scope_id", "path", "content").dropDuplicates(["extract_id"])
    return C.source_slice(files, want, 1)


def packages(s, d):
    return _nodes(s, d, "id", "kind", "path").filter("kind = 'file'").select("id", C.declares_package(F.col("path")).alias("declares"))


def _door_stats(s, d):
    doors, verdicts = P._verdicts(s, d)
    asked = doors.filter(P.D.is_auth_relevant(F.col("endpoint_kind"))).join(verdicts, "id", "left")
    count = lambda c, n: F.count_if(c).alias(n)
    return asked.agg(
        F.count(F.lit(1)).alias("routes"), count(F.col("verdict") == "worth-a-look", "open"), count(F.col("verdict") == "unreadable", "unreadable"), count(F.col("verdict").isin("page", "auth-mount", "generated"), "public"),
        count((F.col("n_guards") > 0) & (F.col("n_certain") == 0), "likely_only"), F.lit(0).alias("unread_files"),
    )


def door_stats(s, d):
    """The counters of the statistics that concern doors, in one row."""
    return _door_stats(s, d)


def auth_headline(s, d):
    return R.auth_headline(_door_stats(s, d)).select("tone", "headline", F.array_join("caveats", "; ").alias("caveats"))


def change_report(s, d):
    n = _nodes(s, d, "id", "kind", "hash", "recorded_at", "removed_at")
    return R.change_report(P.T.diff(P._snap(n, "2025-05-01"), P._snap(n, "2025-07-01")), P.door_diff(s, d).withColumn("name", F.col("id")), 3)


def markdown_report(s, d):
    """Scopes as sections, their largest files as items."""
    n = _nodes(s, d, "id", "kind", "scope_id", "name", "meta").filter("kind = 'file'")
    w = P.W.partitionBy("scope_id").orderBy(F.desc_nulls_last("meta.loc"), "id")
    top = n.withColumn("place", F.row_number().over(w)).filter("place <= 3")
    return R.markdown(top.select(F.col("scope_id").alias("section"), "place", F.col("scope_id").alias("title"), F.concat_ws(" ", "name", K.count_of(F.coalesce("meta.loc", F.lit(0)), "line")).alias("line")))


def _whole(s, d):
    return table(s, d, "extracts", "extract_id", "scope_id", "path", "content").dropDuplicates(["extract_id"]).select("scope_id", "path", "content")


def code_declarations(s, d):
    """What each source file declares and imports, in six languages."""
    return L.declarations(_whole(s, d))


def import_edges(s, d):
    """Imports as edges between files."""
    files = _whole(s, d)
    return L.resolved_imports(L.declarations(files), files)


def name_links(s, d):
    """The names of imported files that a file uses, per language."""
    files = _whole(s, d)
    facts = L.declarations(files)
    return L.linked_names(files, facts, L.resolved_imports(facts, files)).groupBy("fact").agg(F.count(F.lit(1)).alias("n_links"), F.sum("weight").alias("n_uses"))


def declared_types(s, d):
    return L.merged_types(L.declarations(_whole(s, d))).select("scope_id", "namespace", "name", F.array_join("paths", ",").alias("paths"))


_ALL = (code_declarations, import_edges, name_links, declared_types, code_findings, code_findings_counts, route_files, compose_port, source_slices, packages, door_stats, auth_headline, change_report, markdown_report)
QUERIES = {q.__name__: q for q in _ALL}

_FILES = "files AS (SELECT scope_id, path, content FROM (SELECT DISTINCT ON (extract_id) * FROM extracts) UNION ALL SELECT scope_id, rel_path, secret FROM (SELECT DISTINCT ON (src_id) * FROM src))"
_FOUND = B.findings_sql("files").replace("WITH s AS", f"WITH {_FILES}, s AS", 1)

_WHOLE = "files AS (SELECT scope_id, path, content FROM (SELECT DISTINCT ON (extract_id) * FROM extracts))"
_DECLARED = "SELECT DISTINCT scope_id, path, line, kind AS fact, framework AS language, target AS name FROM (" + B.findings_sql("files", L.RULES).replace("WITH s AS", f"WITH {_WHOLE}, s AS", 1) + ") WHERE target IS NOT NULL AND NOT (kind = 'method' AND target IN (" + ", ".join(f"'{w}'" for w in L.NOT_NAMES) + "))"

SQL = {
    "code_declarations": _DECLARED,
    "declared_types": f"""WITH f AS ({_DECLARED}), sp AS (SELECT scope_id, path, arg_min(name, line) AS namespace FROM f WHERE fact = 'namespace' AND language = 'csharp' GROUP BY 1, 2)
        SELECT scope_id, namespace, name, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths FROM f LEFT JOIN sp USING (scope_id, path) WHERE fact = 'type' AND language = 'csharp' GROUP BY 1, 2, 3""",
    "code_findings": f"SELECT DISTINCT * FROM ({_FOUND})",
    "code_findings_counts": f"SELECT kind, framework, count(*) AS n_lines, count(DISTINCT path) AS n_files FROM ({_FOUND}) GROUP BY 1, 2",
    "route_files": """SELECT * FROM (VALUES ('app/(shop)/item/[id]/page.tsx', 'page', 'next-app', '/item/:id'), ('src/app/api/x/route.ts', 'http-route', 'next-app', '/api/x'), ('pages/api/a/index.ts', 'http-route', 'next-pages', '/api/a'),
        ('src/routes/b/[slug]/+page.svelte', 'page', 'sveltekit', '/b/:slug'), ('src/routes/+server.ts', 'http-route', 'sveltekit', '/'), ('supabase/functions/hook/index.ts', 'edge-function', 'supabase', '/hook'), ('app/routes/a.$id.tsx', 'page', 'remix', '/a/:id'), ('app/routes/_index.tsx', 'page', 'remix', '/'))
        t(path, kind, framework, route)""",
    "compose_port": """SELECT * FROM (VALUES ('8080:80', NULL, '8080', NULL, '80', 'tcp'), ('127.0.0.1:5432:5432', '127.0.0.1', '5432', NULL, '5432', 'tcp'), ('${PORT}:3000', NULL, NULL, 'PORT', '3000', 'tcp'), ('"6379"', NULL, NULL, NULL, '6379', 'tcp'), ('53:53/udp', NULL, '53', NULL, '53', 'udp'),
        ('[::1]:80:80', '[::1]', '80', NULL, '80', 'tcp'), ('3000-3005:3000-3005', NULL, '3000-3005', NULL, '3000-3005', 'tcp'), ('x', NULL, NULL, NULL, NULL, NULL), ('${A:-1}:2/tcp', NULL, NULL, 'A', '2', 'tcp')) t(raw, bind_address, host_port, host_port_var, container_port, protocol)""",
    "source_slices": f"""WITH {_N}, w AS (SELECT DISTINCT scope_id, path, greatest(start_line - 1, 1)::INT AS first, coalesce(end_line, start_line) + 1 AS last FROM n WHERE kind = 'endpoint' AND path IS NOT NULL AND start_line >= 1),
        x AS (SELECT DISTINCT ON (extract_id) scope_id, path, regexp_split_to_array(content, '\\r\\n|\\n|\\r') AS l FROM extracts WHERE content IS NOT NULL) SELECT scope_id, path, first, array_to_string(l[first:last], chr(10)) AS text FROM w JOIN x USING (scope_id, path) WHERE first <= len(l)""",
    "packages": f"WITH {_N} SELECT id, regexp_matches(path, '(^|/)(package\\.json|pyproject\\.toml|setup\\.(py|cfg)|go\\.mod|Cargo\\.toml|[^/]+\\.(cs|fs|vb)proj|composer\\.json|Gemfile|pom\\.xml|build\\.gradle(\\.kts)?)$') AS declares FROM n WHERE kind = 'file'",
    "door_stats": f"""WITH {_V} SELECT count(*) AS routes, count(*) FILTER (verdict = 'worth-a-look') AS open, count(*) FILTER (verdict = 'unreadable') AS unreadable, count(*) FILTER (verdict IN ('page', 'auth-mount', 'generated')) AS public,
        count(*) FILTER (n_guards > 0 AND n_certain = 0) AS likely_only, 0 AS unread_files FROM d LEFT JOIN v USING (id) WHERE endpoint_kind IN ('webhook', 'http-route', 'server-action', 'realtime')""",
    "auth_headline": f"""WITH {_V}, c AS (SELECT count(*) AS r, count(*) FILTER (verdict = 'worth-a-look') AS o, count(*) FILTER (verdict = 'unreadable') AS u, count(*) FILTER (verdict IN ('page', 'auth-mount', 'generated')) AS p
        FROM d LEFT JOIN v USING (id) WHERE endpoint_kind IN ('webhook', 'http-route', 'server-action', 'realtime'))
        SELECT 'warn' AS tone, o || ' of ' || r || ' routes have no auth check that can be seen' AS headline, concat_ws('; ', CASE WHEN u > 0 THEN u || ' more lean on a file that could not be read' END, CASE WHEN p > 0 THEN p || ' more are pages or the door people sign in through, open on purpose' END) AS caveats
        FROM c WHERE o > 0 AND r > 1""",
    "markdown_report": f"""WITH {_N}, t AS (SELECT scope_id, name || ' ' || coalesce(meta.loc, 0) || CASE WHEN coalesce(meta.loc, 0) = 1 THEN ' line' ELSE ' lines' END AS line, row_number() OVER (PARTITION BY scope_id ORDER BY meta.loc DESC NULLS LAST, id) AS k FROM n WHERE kind = 'file' QUALIFY k <= 3),
        l AS (SELECT scope_id, -2 AS k, '## ' || scope_id AS text FROM t GROUP BY 1 UNION ALL SELECT scope_id, -1, '' FROM t GROUP BY 1 UNION ALL SELECT scope_id, k, '- ' || line FROM t UNION ALL SELECT scope_id, 99, '' FROM t GROUP BY 1)
        SELECT row_number() OVER (ORDER BY scope_id, k)::INT AS line_no, text FROM l""",
}
