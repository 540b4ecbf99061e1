"""Where code touches the world outside: doors, jobs, calls out, stores, checks and variables, by stated rules over lines.

A rule names the files it is for and one expression for a line; all rules are tried on a line within one projection, so a
file is read and split once whatever their number, and nothing leaves the JVM. The same rules make the SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.functions import classes as K


@dataclass(frozen=True)
class Rule:
    """``pattern`` has the groups method, target and handler by number; 0 is none, a text is a constant."""

    kind: str
    framework: str
    files: str
    pattern: str
    method: int | str = 0
    target: int | str = 0
    handler: int | str = 0


_TS, _PY, _GO, _CS, _RS = r"\.[cm]?[jt]sx?$", r"\.pyi?$", r"\.go$", r"\.cs$", r"\.rs$"
_Q = "[\"'`]"
# What each framework writes, as far as one line shows it.
RULES = [
    Rule("http-route", "express", _TS, rf"\b(?:app|router|server|fastify|api|routes)\.(get|post|put|patch|delete|all|head|options)\(\s*{_Q}(/[^\"'`]*){_Q}(?:\s*,\s*([\w.]+))?", 1, 2, 3),
    Rule("http-route", "nest", _TS, rf"@(Get|Post|Put|Patch|Delete|All)\(\s*(?:{_Q}([^\"'`]*){_Q})?\s*\)", 1, 2),
    Rule("router", "nest", _TS, rf"@Controller\(\s*{_Q}([^\"'`]*){_Q}", 0, 1),
    Rule("procedure", "trpc", _TS, r"(\w+):\s*\w*[pP]rocedure\b.*\.(query|mutation|subscription)\(", 2, 1),
    Rule("router", "mount", _TS, rf"\b(?:app|router|server)\.use\(\s*{_Q}(/[^\"'`]*){_Q}\s*,\s*([\w.]+)", 0, 1, 2),
    Rule("server-action", "next", _TS, r"^\s*[\"']use server[\"']", 0, 0),
    Rule("job", "cron", _TS, rf"\b(?:cron\.schedule|new CronJob|@Cron)\(?\s*\(?{_Q}([^\"'`]+){_Q}", 0, 1),
    Rule("outbound", "fetch", _TS, rf"\b(?:fetch|axios(?:\.\w+)?|got|ky)\(\s*{_Q}(https?://[^\"'`]+)", 0, 1),
    Rule("store", "prisma", _TS, r"\bprisma\.(\w+)\.(find\w*|create\w*|update\w*|upsert|delete\w*|count|aggregate|groupBy)\(", 2, 1),
    Rule("store", "query-builder", _TS, rf"\.from\(\s*{_Q}(\w+){_Q}\s*\)", 0, 1),
    Rule("env", "node", _TS, r"(?:process|import\.meta)\.env\.([A-Z][A-Z0-9_]*)", 0, 1),
    Rule("env", "node", _TS, r"process\.env\[[\"']([A-Z][A-Z0-9_]*)", 0, 1),
    Rule("guard", "session", _TS, r"\b(getServerSession|currentUser|requireAuth|requireUser|getSession|verifyToken|withAuth)\(", 0, 1),
    Rule("guard", "nest", _TS, r"@UseGuards\(\s*(\w+)", 0, 1),
    Rule("refusal", "status", _TS, r"(?:status\(|error\(|status:\s*)(401|403)\b", 0, 1),
    Rule("http-route", "flask-fastapi", _PY, r"^\s*@(\w+)\.(get|post|put|patch|delete|route|websocket)\(\s*[rf]?[\"'](/?[^\"']*)[\"']", 2, 3, 1),
    Rule("http-route", "django", _PY, r"\b(?:path|re_path|url)\(\s*r?[\"']([^\"']*)[\"']\s*,\s*([\w.]+)", 0, 1, 2),
    Rule("router", "include", _PY, r"\.(?:include_router|register_blueprint)\(\s*([\w.]+)(?:.*?(?:url_)?prefix\s*=\s*[\"']([^\"']*))?", 0, 2, 1),
    Rule("job", "celery", _PY, r"^\s*@(?:\w+\.)?(task|shared_task|periodic_task)\b", 0, 1),
    Rule("outbound", "requests", _PY, r"\b(?:requests|httpx|session|client)\.(get|post|put|patch|delete)\(\s*f?[\"'](https?://[^\"']+)", 1, 2),
    Rule("env", "python", _PY, r"os\.(?:environ(?:\.get\(|\[)|getenv\()\s*[\"'](\w+)", 0, 1),
    Rule("guard", "depends", _PY, r"\b(?:Depends|Security)\(\s*([\w.]+)", 0, 1),
    Rule("guard", "decorator", _PY, r"^\s*@(login_required|permission_required|requires_auth|jwt_required)\b", 0, 1),
    Rule("refusal", "status", _PY, r"(?:status_code\s*=\s*|abort\(\s*|HTTPException\(\s*)(401|403)\b", 0, 1),
    Rule("store", "sql", _PY, r"\.execute\(\s*[\"']+\s*(SELECT|INSERT|UPDATE|DELETE)\b", 1, 0),
    Rule("http-route", "mux", _GO, r"\.(HandleFunc|Handle|GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete)\(\s*\"([^\"]*/[^\"]*)\"(?:\s*,\s*([\w.]+))?", 1, 2, 3),
    Rule("env", "go", _GO, r"os\.(?:Getenv|LookupEnv)\(\"(\w+)\"", 0, 1),
    Rule("outbound", "net/http", _GO, r"http\.(Get|Post|Head)\(\s*\"(https?://[^\"]+)\"", 1, 2),
    Rule("store", "database/sql", _GO, r"\.(Query|QueryRow|Exec)(?:Context)?\(", 1, 0),
    Rule("refusal", "status", _GO, r"(http\.StatusUnauthorized|http\.StatusForbidden|\b401\b|\b403\b)", 0, 1),
    Rule("http-route", "aspnet", _CS, r"\[Http(Get|Post|Put|Patch|Delete)(?:\(\"([^\"]*)\"\))?\]", 1, 2),
    Rule("http-route", "minimal-api", _CS, r"\.Map(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]*)\"(?:\s*,\s*([\w.]+))?", 1, 2, 3),
    Rule("router", "aspnet", _CS, r"\[Route\(\"([^\"]*)\"\)\]", 0, 1),
    Rule("guard", "aspnet", _CS, r"\[(Authorize)\b", 0, 1),
    Rule("env", "dotnet", _CS, r"Environment\.GetEnvironmentVariable\(\"(\w+)\"", 0, 1),
    Rule("store", "ef", _CS, r"\bDbSet<(\w+)>\s+(\w+)", 0, 1, 2),
    Rule("http-route", "axum", _RS, r"\.route\(\s*\"([^\"]*)\"\s*,\s*(?:\w+::)*(get|post|put|patch|delete)\(\s*([\w:]+)", 2, 1, 3),
    Rule("http-route", "attribute", _RS, r"#\[(get|post|put|patch|delete)\(\"([^\"]*)\"", 1, 2),
    Rule("command", "tauri", _RS, r"#\[(tauri::command)\b", 0, 1),
    Rule("env", "rust", _RS, r"env::var(?:_os)?\(\"(\w+)\"", 0, 1),
    Rule("outbound", "reqwest", _RS, r"reqwest::(?:\w+::)*get\(\s*\"(https?://[^\"]+)\"", 0, 1),
]
COMMENT = r"^\s*(?://|\*|/\*|#\s|#$|--)"


def findings(files: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """scope_id, path, line, kind, framework, method, target, handler: what the lines of ``files`` (scope_id, path, content) show.

    Lines count from 1 and end in LF, CRLF or CR; comment lines show nothing; of several matches of a rule on a line the
    first counts. A call over several lines shows on the line of its first argument or not at all. Null paths and contents
    show nothing; repeated rows repeat their findings.
    """
    line = F.col("text")

    def part(rule: Rule, what: int | str):
        if isinstance(what, str):
            return F.lit(what)
        return F.nullif(F.regexp_extract(line, rule.pattern, what), F.lit("")) if what else F.lit(None).cast("string")

    def tried(r: Rule):
        return F.when(line.rlike(r.pattern), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.framework).alias("framework"), F.upper(part(r, r.method)).alias("method"), part(r, r.target).alias("target"), part(r, r.handler).alias("handler")))

    # a line meets the rules for its kind of file alone; each kind is asked for once
    of_kind = {f: F.array_compact(F.array(*(tried(r) for r in rules if r.files == f))) for f in dict.fromkeys(r.files for r in rules)}
    found = None
    for files_of, hits in of_kind.items():
        found = F.when(F.col("path").rlike(files_of), hits) if found is None else found.when(F.col("path").rlike(files_of), hits)
    lines = files.filter(F.col("path").isNotNull()).select("scope_id", "path", F.posexplode(F.split("content", r"\r\n|\n|\r")).alias("at", "text")).filter((F.length(line) > 3) & ~line.rlike(COMMENT))
    return lines.select("scope_id", "path", (F.col("at") + 1).alias("line"), F.explode(found).alias("f")).select("scope_id", "path", "line", "f.*")


def findings_sql(files: str, rules: list[Rule] = RULES) -> str:
    """The same as SQL over a relation ``files`` of scope_id, path and content."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def part(r: Rule, what) -> str:
        return quote(what) if isinstance(what, str) else f"nullif(regexp_extract(text, {quote(r.pattern)}, {what}), '')" if what else "NULL::VARCHAR"

    each = " UNION ALL ".join(
        f"SELECT scope_id, path, line, {quote(r.kind)} AS kind, {quote(r.framework)} AS framework, upper({part(r, r.method)}) AS method, {part(r, r.target)} AS target, {part(r, r.handler)} AS handler FROM l WHERE regexp_matches(path, {quote(r.files)}) AND regexp_matches(text, {quote(r.pattern)})"
        for r in rules
    )
    return f"""WITH s AS (SELECT scope_id, path, regexp_split_to_array(content, '\\r\\n|\\n|\\r') AS t FROM {files} WHERE path IS NOT NULL AND content IS NOT NULL),
        l AS (SELECT * FROM (SELECT scope_id, path, unnest(t) AS text, unnest(range(1, len(t) + 1))::INT AS line FROM s) WHERE NOT regexp_matches(text, {quote(COMMENT)})) {each}"""


# Where frameworks look for files that are routes; the group is what lies below.
ROUTE_FILES = [
    ("http-route", "next-app", r"(?:^|/)app/((?:.*/)?route\.[cm]?[jt]sx?)$", False), ("page", "next-app", r"(?:^|/)app/((?:.*/)?page\.[cm]?[jt]sx?)$", False), ("http-route", "next-pages", r"(?:^|/)pages/(api/.*\.[cm]?[jt]sx?)$", True),
    ("http-route", "sveltekit", r"(?:^|/)src/routes/((?:.*/)?\+server\.[jt]s)$", False), ("page", "sveltekit", r"(?:^|/)src/routes/((?:.*/)?\+page\.svelte)$", False), ("edge-function", "supabase", r"(?:^|/)supabase/functions/([^/]+/index\.ts)$", False),
]


def file_routes(files: DataFrame) -> DataFrame:
    """scope_id, path, kind, framework, route: files (scope_id, path) that are routes by where they lie."""
    found = [
        F.when(F.col("path").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(f).alias("framework"), K.file_route(F.regexp_extract("path", p, 1), whole).alias("route")))
        for k, f, p, whole in ROUTE_FILES
    ]
    flat = F.regexp_extract("path", r"(?:^|/)app/routes/([^/]+)\.[jt]sx?$", 1)
    parts = F.filter(F.transform(F.split(flat, r"\."), lambda s: F.when(s.startswith("_"), "").when(s.startswith("$"), F.when(s == "$", "*").otherwise(F.concat(F.lit(":"), F.substr(s, F.lit(2))))).otherwise(F.regexp_replace(s, "_$", ""))), lambda s: s != "")
    remix = F.when(flat != "", F.struct(F.lit("page").alias("kind"), F.lit("remix").alias("framework"), F.concat(F.lit("/"), F.array_join(parts, "/")).alias("route")))
    return files.filter(F.col("path").isNotNull()).select("scope_id", "path", F.explode(F.array_compact(F.array(*found, remix))).alias("f")).select("scope_id", "path", "f.*").distinct()


def composed_routes(routes: DataFrame, mounts: DataFrame, rounds: int = 12) -> DataFrame:
    """The routes (scope_id, router, route, ...) with ``full``: the prefixes of all routers they hang in, in front.

    ``mounts`` has scope_id, host, router and prefix. A router that is mounted in several ways whose prefixes differ, or
    deeper than ``rounds`` or in a circle, has the prefix ``…``: what is not known is said so.
    """
    from strataq.operators.scale import cut

    key = ["scope_id", "router"]
    m = mounts.filter(F.col("router").isNotNull()).select("scope_id", "host", "router", F.coalesce("prefix", F.lit("")).alias("prefix")).distinct()
    hosts = m.select("scope_id", F.col("host").alias("router")).distinct()
    known = cut(hosts.join(m.select(*key).distinct(), key, "left_anti").withColumn("whole", F.lit("")))
    for _ in range(rounds):
        step = m.join(known.select("scope_id", F.col("router").alias("host"), F.col("whole").alias("above")), ["scope_id", "host"], "left")
        per = step.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count("above").alias("n_known"), F.countDistinct(F.concat("above", "prefix")).alias("n_ways"), F.min(F.concat("above", "prefix")).alias("way"))
        new = per.filter("n = n_known").join(known.select(*key), key, "left_anti").select(*key, F.when(F.col("n_ways") > 1, "…").otherwise(F.col("way")).alias("whole"))
        new = cut(new)
        if new.isEmpty():
            break
        known = known.unionByName(new)
    mounted = m.select(*key).distinct().withColumn("__mounted", F.lit(True))
    full = F.when(F.col("__mounted").isNotNull(), F.coalesce("whole", F.lit("…"))).otherwise(F.lit(""))
    joined = F.regexp_replace(F.regexp_replace(F.concat(full, F.lit("/"), F.coalesce("route", F.lit(""))), "/{2,}", "/"), "(.)/$", "$1")
    return routes.join(known, key, "left").join(mounted, key, "left").withColumn("full", joined).drop("whole", "__mounted")


def behind_a_check(mounts: DataFrame, own: DataFrame, rounds: int = 12) -> DataFrame:
    """scope_id, router, guard: routers behind a check: their own (scope_id, router, guard), else, if every way to them passes
    one (on the mount or before its host), that of the first way by host."""
    from strataq.operators.scale import cut

    key = ["scope_id", "router"]
    known = cut(own.filter(F.col("guard").isNotNull()).groupBy(*key).agg(F.min("guard").alias("guard")))
    m = mounts.filter(F.col("router").isNotNull()).select("scope_id", "host", "router", F.col("guard").alias("on_mount")).distinct()
    for _ in range(rounds):
        above = m.join(known.select("scope_id", F.col("router").alias("host"), F.col("guard").alias("before")), ["scope_id", "host"], "left").withColumn("g", F.coalesce("on_mount", "before"))
        per = above.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count("g").alias("n_checked"), F.min_by("g", "host").alias("guard")).filter("n = n_checked")
        new = cut(per.join(known.select(*key), key, "left_anti").select(*key, "guard"))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


def scheduled(routes: DataFrame, crons: DataFrame) -> DataFrame:
    """The routes (scope_id, path pattern ``route``) with the schedule of the first cron (scope_id, path, schedule) that calls them."""
    first = crons.filter(F.col("path").isNotNull()).groupBy("scope_id", F.lower(F.regexp_replace("path", "(.)/+$", "$1")).alias("__p")).agg(F.min("schedule").alias("schedule"))
    return routes.withColumn("__p", F.lower(F.regexp_replace("route", "(.)/+$", "$1"))).join(first, ["scope_id", "__p"], "left").drop("__p")


def filled_tables(tables: DataFrame, models: DataFrame) -> DataFrame:
    """Tables (scope_id, name, fields, observed) with the fields of the model that declares them.

    ``models`` has scope_id, class_name, table_name (null if undeclared), fields and ordinal. Of models that declare one
    table the one with most fields counts, the first among equals. A table's name, in lower case, is looked up among declared
    tables and the classes that declare; a name that two declarers claim is nobody's; classes that declare nothing come last.
    Only observed tables without fields are filled; they are no longer observed alone then.
    """
    m = models.withColumn("n", F.size("fields"))
    best = m.filter(F.col("table_name").isNotNull()).groupBy("scope_id", F.lower("table_name").alias("t")).agg(F.max_by(F.struct("class_name", "fields", "ordinal"), F.struct("n", -F.col("ordinal"))).alias("m"))
    claim = best.select("scope_id", F.explode(F.array_distinct(F.array("t", F.lower("m.class_name")))).alias("key"), "m.fields", "m.ordinal")
    one = claim.groupBy("scope_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min_by("fields", "ordinal").alias("f")).select("scope_id", "key", F.when(F.col("n") == 1, F.col("f")).alias("f"), F.lit(0).alias("late"))
    plain = m.filter(F.col("table_name").isNull()).groupBy("scope_id", F.lower("class_name").alias("key")).agg(F.min_by("fields", "ordinal").alias("f")).withColumn("late", F.lit(1))
    claims = one.unionByName(plain).groupBy("scope_id", "key").agg(F.min_by("f", "late").alias("f"))
    empty = F.coalesce("observed", F.lit(False)) & (F.coalesce(F.size("fields"), F.lit(0)) <= 0)
    hit = empty & F.col("f").isNotNull()
    joined = tables.withColumn("key", F.lower("name")).join(claims, ["scope_id", "key"], "left")
    return joined.withColumns({"observed": F.when(hit, False).otherwise(F.col("observed")), "fields": F.when(hit, F.col("f")).otherwise(F.col("fields"))}).drop("f", "key")
