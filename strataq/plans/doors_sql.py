"""The SQL of the queries on doors, zones, columns and groups."""

from __future__ import annotations

from strataq.functions import classes as K
from strataq.operators.graph import KIND_ORDER
from strataq.plans.facts import _C, _E, _N, _P

_KIND = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KIND_ORDER, 1)) + " ELSE 0 END"
_D = f"""{_N}, {_E}, de AS (SELECT from_id, count(*) FILTER (kind = 'protected-by') AS n_guards, count(*) FILTER (kind = 'protected-by' AND confidence = 'certain') AS n_certain, count(*) FILTER (kind = 'exposed-by') AS n_handlers
    FROM e WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND kind IN ('protected-by', 'exposed-by') GROUP BY 1),
 d AS (SELECT n.id, n.name, n.path, n.recorded_at, n.removed_at, coalesce(n_guards, 0) AS n_guards, coalesce(n_certain, 0) AS n_certain, coalesce(n_handlers, 0) AS n_handlers, regexp_extract(id, '^endpoint:([^:]+):', 1) AS endpoint_kind,
    regexp_extract(name, '^([A-Z]+) (.*)$', 1) AS method, regexp_extract(name, '^([A-Z]+) (.*)$', 2) AS route, regexp_extract(name, '^([A-Z]+) (.*)$', 1) NOT IN ('GET', 'HEAD', 'PAGE') AS writes FROM n LEFT JOIN de ON de.from_id = n.id WHERE kind = 'endpoint')"""
_W = "w AS (SELECT DISTINCT x.from_id AS door_id FROM e x JOIN e y ON y.kind = 'writes-to' AND y.from_id = x.to_id JOIN n ON n.id = y.to_id AND n.kind = 'store' WHERE x.kind = 'exposed-by' AND x.from_id IS NOT NULL)"
_V = f"""{_D}, unread AS (SELECT DISTINCT file_id, path FROM extracts WHERE content IS NULL), f AS (SELECT id AS door_id, 'file:' || path AS file_id FROM d WHERE path IS NOT NULL),
 b AS (SELECT door_id, arg_min(path, (hop, path)) AS blind FROM (SELECT door_id, 0 AS hop, path FROM f JOIN unread USING (file_id) UNION ALL SELECT door_id, 1, u.path FROM f JOIN e ON e.kind = 'imports' AND e.from_id = f.file_id JOIN unread u ON u.file_id = e.to_id) GROUP BY 1),
 m AS (SELECT from_id AS file_id, min(to_id) AS provider FROM e WHERE to_id LIKE 'service:%' AND from_id LIKE 'file:%' GROUP BY 1),
 v AS (SELECT d.id, CASE WHEN blind IS NOT NULL THEN 'unreadable' WHEN contains(route, '*') AND provider IS NOT NULL THEN 'auth-mount' WHEN regexp_matches(d.path, '(^|/)generated/') THEN 'generated' WHEN method = 'PAGE' AND NOT writes THEN 'page' ELSE 'worth-a-look' END AS verdict,
    CASE WHEN blind IS NOT NULL THEN 'imports ' || blind || ', which could not be read' WHEN contains(route, '*') AND provider IS NOT NULL THEN provider || ' is mounted here' END AS because
    FROM d LEFT JOIN b ON b.door_id = d.id LEFT JOIN m ON m.file_id = 'file:' || d.path WHERE endpoint_kind IN ('webhook', 'http-route', 'server-action', 'realtime') AND n_guards = 0)"""
_USES = "u AS (SELECT *, CASE WHEN kind = 'writes-to' THEN 'write' ELSE 'read' END AS operation, regexp_extract(from_id, '^[a-z]+:([^#]*)', 1) AS of FROM e WHERE kind IN ('reads-from', 'writes-to') AND from_id IS NOT NULL)"
_SNAP = lambda day: f"recorded_at <= TIMESTAMP '{day}' AND (removed_at IS NULL OR removed_at > TIMESTAMP '{day}')"
_PERSONAL_CTE = f"""s AS (SELECT name, k, list_reduce(p[k + 1:], lambda x, y: x || '_' || y) AS tail, len(p) - k AS words, p[k + 1] AS head FROM (SELECT name, string_split(t, '_') AS p, unnest(range(0, len(string_split(t, '_')))) AS k FROM
    (SELECT name, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[\\s.\\-]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')) AS t FROM names) WHERE t <> '')),
 j AS (SELECT name, k, CASE {" ".join(f"WHEN regexp_full_match(tail, '{p.replace(chr(39), chr(39) * 2)}') THEN 'direct {c}'" for c, p in K.DIRECT)} WHEN words > 1 AND head IN ({", ".join(f"'{w}'" for w in K.NOT_A_PERSON)}) THEN 'none '
    {" ".join(f"WHEN regexp_full_match(tail, '{p}') THEN CASE WHEN k = 0 THEN 'ambiguous {c}' ELSE 'none ' END" for c, p in K.AMBIGUOUS)} END AS v FROM s),
 r AS (SELECT name, arg_min(v, k) AS v FROM j WHERE v IS NOT NULL GROUP BY 1),
 personal AS (SELECT names.name, CASE WHEN v LIKE 'direct %' OR v LIKE 'ambiguous %' THEN split_part(v, ' ', 2) END AS category, CASE WHEN v LIKE 'direct %' OR v LIKE 'ambiguous %' THEN split_part(v, ' ', 1) END AS strength FROM names LEFT JOIN r USING (name))"""
_COUNTS = """files AS (SELECT id, scope_id, path, zone, name FROM n WHERE kind = 'file' AND path IS NOT NULL), parts AS (SELECT scope_id, path, string_split(path, '/') AS p FROM files),
 up AS (SELECT scope_id, unnest(range(0, len(p))) AS i, p FROM parts), folders AS (SELECT scope_id, coalesce(array_to_string(p[1:i], '/'), '') AS folder, count(*) FILTER (i = len(p) - 1) AS own, count(*) AS below FROM up GROUP BY 1, 2)"""


def _values(items) -> str:
    return ", ".join("('" + x.replace("'", "''") + "')" for x in items)


def sql(columns: list[str], specifiers: list[str]) -> dict[str, str]:
    """Query name to SQL; ``columns`` are the names that personal_columns judges."""
    return {
        "level_filter": f"WITH {_N}, {_E}, h AS (SELECT id FROM n WHERE kind = 'file' AND zone IN ('test', 'config')) SELECT id FROM e WHERE kind = 'imports' AND from_id IS NOT NULL AND to_id IS NOT NULL AND from_id NOT IN (SELECT id FROM h) AND to_id NOT IN (SELECT id FROM h)",
        "zone_flows": f"WITH {_N}, {_E} SELECT a.zone AS from_zone, b.zone AS to_zone, sum(weight)::BIGINT AS weight FROM e JOIN n a ON a.id = from_id JOIN n b ON b.id = to_id WHERE e.kind IN ('references', 'imports') AND a.zone IS NOT NULL AND b.zone IS NOT NULL GROUP BY 1, 2",
        "door_classes": f"""WITH {_D} SELECT CASE WHEN endpoint_kind IN ('http-route', 'webhook', 'realtime', 'server-action', 'rpc') THEN 'network' WHEN endpoint_kind IN ('screen', 'page') THEN 'screen' WHEN endpoint_kind IN ('cli', 'bin') THEN 'declared-cli' WHEN endpoint_kind IN ('main', 'script') THEN 'runnable'
            WHEN endpoint_kind IN ('cron', 'job') THEN 'scheduled' ELSE 'other' END AS class, count(*) AS n_doors FROM d GROUP BY 1""",
        "language_tiers": f"WITH {_N} SELECT CASE WHEN lower(language) IN ('go', 'golang', 'rust', 'c#', 'csharp') THEN 'coarse' ELSE 'full' END AS tier, array_to_string(list_sort(list(DISTINCT lower(language))), ',') AS languages FROM n WHERE kind = 'file' AND language IS NOT NULL GROUP BY 1",
        "callers_by_name": f"""WITH {_N}, {_E}, t AS (SELECT DISTINCT id FROM n WHERE lower(name) = 'savesummary'), c AS (SELECT to_id, from_id, sum(weight)::BIGINT AS weight FROM e JOIN t ON t.id = to_id WHERE kind = 'references' AND from_id IS NOT NULL GROUP BY 1, 2)
            SELECT to_id AS target_id, from_id, n.kind, n.name, weight, (SELECT count(*) FROM t) AS n_targets FROM c JOIN n ON n.id = from_id ORDER BY weight DESC, from_id, target_id LIMIT 60""",
        "node_by_id": f"WITH {_N} SELECT id, kind, name, parent_id FROM n WHERE id = 'store:cache-kv'",
        "children_of": f"WITH {_N} SELECT id, kind, name FROM n WHERE parent_id = 'zone:outbound'",
        "writing_doors": f"WITH {_N}, {_E}, {_W} SELECT door_id FROM w",
        "store_doors": f"""WITH {_N}, {_E} SELECT DISTINCT y.to_id AS target_id, x.from_id AS door_id FROM e x JOIN e y ON y.from_id = x.to_id AND y.kind IN ('reads-from', 'writes-to') JOIN n t ON t.id = y.to_id AND t.kind IN ('store', 'service')
            JOIN n p ON p.id = x.from_id AND p.kind = 'endpoint' WHERE x.kind = 'exposed-by' AND regexp_extract(x.from_id, '^endpoint:([^:]+):', 1) NOT IN ('export', 'file-read')""",
        "open_doors": f"WITH {_V} SELECT * FROM v",
        "open_door_tally": f"WITH {_V} SELECT verdict, count(*) AS n_doors FROM v GROUP BY 1",
        "auth_insights": f"""WITH {_V} SELECT d.id, CASE WHEN route <> '' THEN trim(method || ' ' || route) ELSE name END AS label, CASE WHEN n_certain > 0 THEN 'certain' WHEN n_guards > 0 THEN 'likely' ELSE 'none' END AS protection, verdict,
            CASE WHEN verdict = 'worth-a-look' THEN CASE WHEN writes THEN 0 ELSE 1 END WHEN verdict = 'unreadable' THEN 2 WHEN verdict IN ('page', 'auth-mount') THEN 4 WHEN n_certain = 0 AND n_guards > 0 THEN 3 ELSE 5 END AS urgency
            FROM d LEFT JOIN v USING (id) WHERE endpoint_kind IN ('webhook', 'http-route', 'server-action', 'realtime')""",
        "entry_points": f"""WITH {_D} SELECT id, score FROM (SELECT id, name, endpoint_kind, (n_handlers * 3 + CASE WHEN writes THEN 6 ELSE 0 END + CASE endpoint_kind WHEN 'webhook' THEN 4 WHEN 'server-action' THEN 2 ELSE 0 END - CASE WHEN method = 'PAGE' THEN 3 ELSE 0 END + 1)::BIGINT AS score
            FROM d WHERE endpoint_kind NOT IN ('env', 'file-read')) WHERE score > 0 ORDER BY endpoint_kind = 'screen', score DESC, name, id LIMIT 5""",
        "guard_reach": f"""WITH RECURSIVE {_E}, g AS (SELECT DISTINCT to_id AS id FROM e WHERE kind = 'protected-by' AND from_id IS NOT NULL AND to_id IS NOT NULL), c AS (SELECT DISTINCT from_id, to_id FROM e WHERE kind = 'references' AND from_id IS NOT NULL AND to_id IS NOT NULL),
            r AS (SELECT id AS guard_id, id AS node_id, 0 AS hops FROM g UNION SELECT guard_id, from_id, hops + 1 FROM r JOIN c ON to_id = node_id WHERE hops < 3), m AS (SELECT guard_id, node_id, min(hops) AS hops FROM r GROUP BY 1, 2)
            SELECT guard_id, hops::INT AS hops, count(*) AS n_callers FROM m WHERE hops > 0 GROUP BY 1, 2""",
        "door_diff": f"""WITH {_D}, k AS (SELECT *, endpoint_kind IN ('webhook', 'http-route', 'server-action', 'realtime') AS asked FROM d), a AS (SELECT * FROM k WHERE {_SNAP("2025-05-01")}), b AS (SELECT * REPLACE (CASE WHEN ends_with(name, 'r') THEN 0 ELSE n_guards END AS n_guards) FROM k WHERE {_SNAP("2025-07-01")})
            SELECT coalesce(b.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'removed' ELSE 'lost-check' END AS change, coalesce(b.writes, a.writes) AS writes FROM a FULL JOIN b ON a.id = b.id
            WHERE coalesce(b.asked, a.asked) AND (a.id IS NULL OR b.id IS NULL OR (a.n_guards > 0 AND b.n_guards = 0))""",
        "comparable": "SELECT NULL::VARCHAR AS because",
        "endpoint_merge": """WITH x AS (SELECT upper(event_type) || ' /u/' || (user_id % 10) AS key, * FROM events) SELECT 'http-route' AS endpoint_kind, key, 'e' || min(event_id) AS name, bool_or(value > 99) AS writes, 's' || min(event_id) FILTER (event_id % 97 = 0) AS schedule,
            array_to_string(list_sort(list(DISTINCT 'h' || (user_id % 7))), ',') AS handlers, count(*)::INT AS n_sites, 'p' || arg_min(user_id, event_id) AS first_path FROM x GROUP BY key""",
        "service_merge": f"""WITH {_E}, {_USES} SELECT lower(split_part(to_id, ':', 2)) AS key, arg_min(upper(split_part(to_id, ':', 2)[1]) || lower(split_part(to_id, ':', 2)[2:]), ordinal) AS name, count(*) AS n_sites,
            coalesce(array_to_string(list_sort(list(DISTINCT nullif(string_split(of, '/')[2], '')) FILTER (string_split(of, '/')[2] IS NOT NULL)), ','), '') AS packages, bool_or(operation = 'write') AS sends FROM u WHERE to_id LIKE 'service:%' GROUP BY 1""",
        "store_merge": f"""WITH {_E}, {_USES} SELECT lower(split_part(to_id, ':', 2)) AS key, count(*) FILTER (operation = 'read') AS n_reads, count(*) FILTER (operation = 'write') AS n_writes, array_to_string(list_sort(list(DISTINCT string_split(of, '/')[1])), ',') AS tables
            FROM u WHERE to_id LIKE 'store:%' GROUP BY 1""",
        "flow_edges": f"""WITH {_E}, x AS (SELECT DISTINCT from_id AS door, to_id AS node FROM e WHERE kind = 'exposed-by' AND from_id IS NOT NULL AND to_id IS NOT NULL) SELECT door AS from_id, to_id, kind, sum(weight)::BIGINT AS weight FROM x JOIN e ON e.from_id = node
            WHERE kind IN ('reads-from', 'writes-to') GROUP BY ALL""",
        "distinct_guards": f"""WITH {_N}, {_E}, g AS (SELECT n.name, n.path, n.start_line AS line, confidence FROM e JOIN n ON n.id = e.to_id WHERE e.kind = 'protected-by' AND from_id IS NOT NULL),
            a AS (SELECT name, path, min(line) AS line, CASE WHEN bool_or(confidence = 'certain') THEN 'certain' ELSE min(confidence) END AS confidence FROM g GROUP BY 1, 2)
            SELECT 'all' AS door_id, min(name) AS name, path, line, CASE WHEN bool_or(confidence = 'certain') THEN 'certain' ELSE min(confidence) END AS confidence FROM a GROUP BY path, line""",
        "matcher_join": f"""WITH {_D}, m(matcher, re, ex) AS (VALUES ('/beacon-:n/:path*', '/beacon-[^/]+(?:/.*)?', NULL), ('/:a/:b', '/[^/]+/[^/]+', NULL), ('/*', '/.*', '^/flint'), ('/:top/auth/:rest+', '/[^/]+/auth/.*', NULL))
            SELECT id AS door_id, matcher, coalesce(regexp_matches(route, ex), false) AS excluded FROM d JOIN m ON regexp_full_match(route, re) WHERE route <> ''""",
        "boundary_cards": f"""WITH {_D}, c AS (SELECT split_part(path, '/', 1) AS family, endpoint_kind AS card, count(*) AS paths FROM d WHERE path IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY paths DESC, card)::INT AS place FROM c)
            SELECT * FROM k WHERE place <= 1 UNION ALL SELECT family, count(*) || ' more', sum(paths)::BIGINT, 2 FROM k WHERE place > 1 GROUP BY 1""",
        "zone_of_path": f"WITH {_N} SELECT id, {K.zone_sql('path')} AS zone_by_path FROM n WHERE kind = 'file'",
        "personal_columns": f"WITH names(name) AS (VALUES {_values(columns)}), {_PERSONAL_CTE} SELECT * FROM personal",
        "personal_tables": f"""WITH {_N}, fields AS (SELECT parent_id AS table_id, regexp_replace(name, '^[a-z]+([A-Z_])', '\\1') AS name FROM n WHERE kind = 'function'), names AS (SELECT DISTINCT name FROM fields WHERE name IS NOT NULL), {_PERSONAL_CTE}
            SELECT table_id, count(*) FILTER (strength = 'direct') AS n_direct, count(*) FILTER (strength = 'ambiguous') AS n_ambiguous, count(*) AS n_columns FROM fields LEFT JOIN personal USING (name) WHERE table_id IN (SELECT id FROM n WHERE kind = 'type') GROUP BY 1""",
        "retired_files": f"""WITH {_N}, q AS (SELECT id, zone, summary, list_filter(string_split(path, '/'), lambda s: regexp_full_match(lower(s), '_archived?|_old|_deprecated|_legacy|_unused|_bak|_backup|_graveyard|_parked|_attic|parked|graveyard|attic|deprecated'))[1] AS seg,
            trim(regexp_replace(regexp_extract(summary, '(?m)^[ \\t]*(\\S.*?)\\r?$', 1), '^[\\s*#/\\-]+', '')) AS opening FROM n WHERE kind IN ('file', 'function'))
            SELECT id, CASE WHEN seg IS NOT NULL THEN 'path' ELSE 'docstring' END AS evidence, CASE WHEN seg IS NOT NULL THEN seg WHEN regexp_matches(lower(opening), '^(deprecated|obsolete|retired|superseded|do not use)\\b') THEN substr(opening, 1, 160) ELSE '@deprecated' END AS says
            FROM q WHERE coalesce(zone, '') <> 'test' AND (seg IS NOT NULL OR regexp_matches(lower(opening), '^(deprecated|obsolete|retired|superseded|do not use)\\b') OR regexp_matches(lower(summary), '(^|\\s)@deprecated\\b'))""",
        "route_of_file": f"""WITH {_N}, r AS (SELECT id, regexp_replace(path, '^[^/]*/', '') AS rest FROM n WHERE kind = 'file') SELECT id, '/' || coalesce(regexp_replace(rest, '(^|/)[^/]*$', ''), '') AS folders,
            '/' || regexp_replace(regexp_replace(rest, '\\.[cm]?[jt]sx?$', ''), '(^|/)index$', '') AS whole FROM r""",
        "specifier_resolution": "SELECT * FROM (VALUES (0, 'apps/web/src/x'), (1, 'apps/web/lib/y'), (2, 'apps/z'), (3, 'core/a'), (4, 'b'), (5, 'c'), (6, NULL), (7, 'apps/web/w')) t(n, path)",
        "edge_labels": f"""WITH {_E}, p AS (SELECT from_id, to_id, list_sort(list(DISTINCT kind)) AS k, sum(weight)::BIGINT AS w FROM e WHERE from_id IS NOT NULL AND to_id IS NOT NULL GROUP BY 1, 2)
            SELECT from_id, to_id, w || ' ' || CASE WHEN list_contains(k, 'reads-from') AND list_contains(k, 'writes-to') THEN CASE WHEN w = 1 THEN 'query' ELSE 'queries' END WHEN list_contains(k, 'reads-from') THEN CASE WHEN w = 1 THEN 'read' ELSE 'reads' END
            WHEN list_contains(k, 'writes-to') THEN CASE WHEN w = 1 THEN 'write' ELSE 'writes' END WHEN k = ['imports'] THEN CASE WHEN w = 1 THEN 'import' ELSE 'imports' END ELSE CASE WHEN w = 1 THEN 'use' ELSE 'uses' END END AS label FROM p""",
        "catalog_tables": """SELECT * FROM (VALUES ('orders', NULL), ('information_schema.tables', 'information_schema'), ('pg_class', 'pg_catalog'), ('"sys"."objects"', 'sys'), ('public.pg_roles', 'pg_catalog'), ('SQLITE_MASTER', 'sqlite'), ('user_tables', 'oracle dictionary'), ('user_sessions', NULL),
            ('a.b.all_users', 'oracle dictionary')) t(name, catalog)""",
        "sends_data": f"""WITH {_E} SELECT id, regexp_matches(lower(regexp_extract(regexp_extract(from_id, '[^#]*$', 0), '[^.]*$', 0)), '^(send|create|post|upload|track|capture|identify|charge|publish|emit|log)') OR contains(to_id, 'mail') AS sends
            FROM e WHERE to_id LIKE 'service:%' AND from_id IS NOT NULL""",
        "phrases": f"""WITH {_N}, p AS (SELECT parent_id, list_sort(list(DISTINCT name)) AS names, count(*) AS n FROM n WHERE kind = 'module' AND parent_id IS NOT NULL GROUP BY 1)
            SELECT parent_id, CASE WHEN len(names) = 1 THEN names[1] ELSE array_to_string(names[1:least(len(names), 4) - 1], ', ') || ' and ' || names[least(len(names), 4)] END AS list, n || CASE WHEN n = 1 THEN ' folder' ELSE ' folders' END AS count,
            upper(names[1][1]) || names[1][2:] AS first, format('{{:,}}', n * 1234) AS big FROM p""",
        "node_ids": f"""WITH {_N} SELECT id, CASE WHEN kind IN ('module', 'file') THEN kind || ':' || path ELSE kind || ':' || lower(regexp_extract(name, '[^/]*$', 0)) END AS made FROM n WHERE kind IN ('module', 'file', 'service', 'store')""",
        "world_flows": f"""WITH RECURSIVE {_P}, {_E}, {_C}, u AS (SELECT node_id, unnest(path) AS a, unnest(range(1, len(path) + 1)) AS i FROM p), w AS (SELECT node_id, arg_max(a, i) AS world FROM u JOIN n ON n.id = a WHERE n.kind IN ('store', 'service', 'endpoint') GROUP BY 1),
            x AS (SELECT e.kind, weight, a.child AS cf, b.child AS ct, from_id, to_id FROM e LEFT JOIN c a ON e.from_id = a.node_id LEFT JOIN c b ON e.to_id = b.node_id WHERE e.kind <> 'contains' AND from_id IS NOT NULL AND to_id IS NOT NULL),
            f AS (SELECT world AS world_id, coalesce(cf, ct) AS child, CASE WHEN cf IS NOT NULL THEN 'out' ELSE 'in' END AS direction, sum(weight)::BIGINT AS weight, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM x JOIN w ON w.node_id = CASE WHEN cf IS NOT NULL THEN to_id ELSE from_id END
                WHERE (cf IS NULL) <> (ct IS NULL) AND world <> 'app:harbor-api' AND world NOT IN (SELECT child FROM c) GROUP BY 1, 2, 3), t AS (SELECT world_id, sum(weight)::BIGINT AS total FROM f GROUP BY 1 ORDER BY total DESC, world_id LIMIT 8)
            SELECT world_id, child, direction, weight, kinds, total FROM f JOIN t USING (world_id)""",
        "module_tree": f"""WITH {_N}, {_COUNTS}, kids AS (SELECT scope_id, regexp_replace(folder, '(^|/)[^/]+$', '') AS folder, count(*) AS k FROM folders WHERE folder <> '' GROUP BY 1, 2)
            SELECT scope_id, folder, own, below, folder = '' OR NOT (own = 0 AND coalesce(k, 0) = 1) AS shown FROM folders LEFT JOIN kids USING (scope_id, folder)""",
        "unimported_whole": f"""WITH {_N}, {_E}, o AS (SELECT id, 'file:' || path AS f FROM n WHERE path IS NOT NULL), used AS (SELECT to_id AS id FROM e WHERE kind IN ('imports', 'protected-by') AND to_id IS NOT NULL
            UNION SELECT t.f FROM e JOIN o t ON t.id = to_id LEFT JOIN o s ON s.id = from_id WHERE e.kind = 'exposed-by' OR (e.kind = 'references' AND s.f IS DISTINCT FROM t.f) UNION SELECT 'file:' || path FROM n WHERE kind = 'endpoint' AND path IS NOT NULL)
            SELECT id, meta.loc AS loc FROM n WHERE kind = 'file' AND path IS NOT NULL AND zone NOT IN ('test', 'config') AND NOT regexp_matches(path, '\\.d\\.ts$|\\.(ipynb|prisma|sql)$|(^|/)__[a-z_]+__\\.pyi?$') AND id NOT IN (SELECT id FROM used WHERE id IS NOT NULL)""",
        "type_cards": f"""WITH {_N}, {_E}, u AS (SELECT to_id AS id, sum(weight) AS usage FROM e WHERE kind = 'references' AND from_id <> to_id GROUP BY 1), x AS (SELECT n.id, name, coalesce(usage, 0) AS usage, coalesce(meta.is_exported, false) AS ex, zone FROM n LEFT JOIN u USING (id) WHERE kind = 'type')
            SELECT id, (usage + CASE WHEN ex THEN 12 ELSE 0 END - CASE WHEN zone = 'test' THEN 40 ELSE 0 END)::BIGINT AS score FROM x WHERE ex OR usage > 0 ORDER BY score DESC, name, id LIMIT 60""",
        "preview_names": f"WITH {_N}, p AS (SELECT parent_id, name, row_number() OVER (PARTITION BY parent_id ORDER BY {_KIND}, name, id) AS k FROM n WHERE parent_id IS NOT NULL QUALIFY k <= 5) SELECT parent_id, string_agg(name, ', ' ORDER BY k) AS preview FROM p GROUP BY 1",
        "arrow_budget": f"""WITH {_E}, p AS (SELECT from_id, to_id, sum(weight)::BIGINT AS weight FROM e WHERE kind = 'imports' AND from_id IS NOT NULL AND to_id IS NOT NULL GROUP BY 1, 2)
            (SELECT * FROM p ORDER BY weight DESC, from_id, to_id LIMIT 40) UNION SELECT * FROM p WHERE from_id LIKE '%ledger%' AND to_id LIKE '%ledger%'""",
        "label_disambiguation": f"""WITH {_N}, m AS (SELECT id, name, path, count(*) OVER (PARTITION BY name) AS k FROM n WHERE kind = 'module') SELECT id, CASE WHEN k > 1 THEN array_to_string(string_split(path, '/')[-2:], '/') ELSE name END AS shown FROM m""",
        "batches": "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents) SELECT doc_id, source, k // 12 AS request, (k % 12)::INT AS place FROM r",
    }
