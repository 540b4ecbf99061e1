"""Ways into an application (doors) with what stands behind and before them, over tables of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Kinds of doors that a check would be expected before, and the order of reading by verdict.
AUTH_KINDS = ["http-route", "server-action", "realtime"]
URGENCY = {"unreadable": 2, "page": 4, "auth-mount": 4}
NOT_WAYS_IN = ["export", "file-read"]


def is_auth_relevant(kind: Column, verified: Column | None = None) -> Column:
    """Doors that a check is expected before: some kinds always, a webhook if nothing verifies its sender."""
    unverified = ~F.coalesce(verified, F.lit(False)) if verified is not None else F.lit(True)
    return F.when(kind == "webhook", unverified).otherwise(F.coalesce(kind.isin(AUTH_KINDS), F.lit(False)))


def is_way_in(kind: Column) -> Column:
    return ~F.coalesce(kind.isin(NOT_WAYS_IN), F.lit(False))


def behind(edges: DataFrame, kind: str) -> DataFrame:
    """door_id, node_id: the distinct ends of a door's edges of a kind (exposed-by, protected-by)."""
    return edges.filter((F.col("kind") == kind) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).select(F.col("from_id").alias("door_id"), F.col("to_id").alias("node_id")).distinct()


def writing_doors(edges: DataFrame, stores: DataFrame) -> DataFrame:
    """door_id of the doors whose handler writes to one of ``stores`` (id): two joins on keys, no path is followed further."""
    ids = stores.filter(F.col("id").isNotNull()).select(F.col("id").alias("to_id")).distinct()
    writers = edges.filter(F.col("kind") == "writes-to").join(ids, "to_id", "left_semi").select(F.col("from_id").alias("node_id")).filter(F.col("node_id").isNotNull()).distinct()
    return behind(edges, "exposed-by").join(writers, "node_id", "left_semi").select("door_id").distinct()


def reaching_doors(edges: DataFrame, doors: DataFrame, targets: DataFrame, kinds: list[str]) -> DataFrame:
    """target_id, door_id: the doors (id, endpoint_kind) that are ways in and whose handler has an edge of ``kinds`` to a target (id)."""
    ways = doors.filter(is_way_in(F.col("endpoint_kind"))).select(F.col("id").alias("door_id")).distinct()
    ids = targets.filter(F.col("id").isNotNull()).select(F.col("id").alias("target_id")).distinct()
    use = edges.filter(F.col("kind").isin(kinds)).select(F.col("from_id").alias("node_id"), F.col("to_id").alias("target_id")).distinct().join(ids, "target_id", "left_semi")
    return behind(edges, "exposed-by").join(ways, "door_id", "left_semi").join(use, "node_id").select("target_id", "door_id").distinct()


def first_unread(files: DataFrame, imports: DataFrame, unread: DataFrame) -> DataFrame:
    """door_id, path: for each door the first file behind it (door_id, file_id, place) that is unread (file_id, path) or
    imports (from_id, to_id) one; of a file's imports the first by path."""
    own = files.join(unread, "file_id").select("door_id", "place", F.lit(0).alias("hop"), "path")
    far = files.join(imports.select(F.col("from_id").alias("file_id"), F.col("to_id").alias("other")).distinct(), "file_id").join(unread.withColumnRenamed("file_id", "other"), "other").select("door_id", "place", F.lit(1).alias("hop"), "path")
    return own.unionByName(far).groupBy("door_id").agg(F.min_by("path", F.struct("place", "hop", "path")).alias("path"))


def open_doors(doors: DataFrame, files: DataFrame, imports: DataFrame, unread: DataFrame, mounts: DataFrame, writers: DataFrame) -> DataFrame:
    """id, verdict, because: why each unguarded door that a check is expected before is open.

    ``doors`` has id, endpoint_kind, verified, method, route, writes, n_guards, sign_in and generated; ``files`` (door_id,
    file_id, place) what stands behind them; ``mounts`` (file_id, provider) files in which a provider of sign-in is mounted;
    ``writers`` (door_id) doors that write data. In this order: unreadable, auth-mount (a route with a star in a mount's
    file, or a call that signs in and writes nothing), generated, page, worth-a-look. Guarded doors have no row.
    """
    open_ = doors.filter(is_auth_relevant(F.col("endpoint_kind"), F.col("verified")) & (F.coalesce("n_guards", F.lit(0)) == 0)).dropDuplicates(["id"])
    blind = first_unread(files, imports, unread).select(F.col("door_id").alias("id"), F.col("path").alias("__blind"))
    mounted = files.join(mounts, "file_id").groupBy("door_id").agg(F.min_by("provider", F.struct("place", "provider")).alias("__provider")).withColumnRenamed("door_id", "id")
    writes = writers.select(F.col("door_id").alias("id"), F.lit(True).alias("__data")).distinct()
    all_ = open_.join(blind, "id", "left").join(mounted, "id", "left").join(writes, "id", "left")
    star = F.coalesce(F.col("route").contains("*"), F.lit(False)) & F.col("__provider").isNotNull()
    signs_in = F.col("sign_in").isNotNull() & F.col("__data").isNull()
    verdict = (
        F.when(F.col("__blind").isNotNull(), "unreadable").when(star | signs_in, "auth-mount").when(F.coalesce("generated", F.lit(False)), "generated")
        .when((F.col("method") == "PAGE") & ~F.coalesce("writes", F.lit(False)), "page").otherwise("worth-a-look")
    )
    because = F.when(F.col("__blind").isNotNull(), F.concat(F.lit("imports "), F.col("__blind"), F.lit(", which could not be read"))).when(star, F.concat(F.col("__provider"), F.lit(" is mounted here"))).when(signs_in, F.concat(F.lit("calls "), F.col("sign_in")))
    return all_.select("id", verdict.alias("verdict"), because.alias("because"))


def urgency(verdict: Column, writes: Column, protection: Column) -> Column:
    """Where a door stands in the order of reading, from 0."""
    known = F.coalesce(*(F.when(verdict == k, v) for k, v in URGENCY.items()))
    return F.when(verdict == "worth-a-look", F.when(writes, 0).otherwise(1)).when(known.isNotNull(), known).when(protection == "likely", 3).otherwise(5)


def entry_points(doors: DataFrame, limit: int = 5) -> DataFrame:
    """id, name, score of the doors most worth a tour: by handlers, writes, kind and places, network doors before screens."""
    score = (
        F.col("n_handlers") * 3 + F.when(F.col("writes"), 6).otherwise(0) + F.when(F.col("endpoint_kind") == "webhook", 4).when(F.col("endpoint_kind") == "server-action", 2).otherwise(0)
        - F.when(F.col("method") == "PAGE", 3).otherwise(0) + F.least(F.col("n_sites"), F.lit(4))
    )
    scored = doors.filter(~F.col("endpoint_kind").isin("env", "file-read")).withColumn("score", score.cast("bigint")).filter("score > 0")
    return scored.orderBy(F.col("endpoint_kind") == "screen", F.desc("score"), "name", "id").select("id", "name", "score").limit(limit)


def guard_reach(guards: DataFrame, references: DataFrame, hops: int = 3) -> DataFrame:
    """node_id, guard_id, hops, via: who calls a check (id), directly or through others, by the fewest steps.

    ``via`` are the ids between the caller and the check, the check last; of equally short ways the first in order. Each
    step is one join and one aggregation over all checks at once; no node is left out for the number of those found before.
    """
    from strataq.operators.scale import cut

    calls = references.filter(F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).select(F.col("from_id").alias("caller"), F.col("to_id").alias("node_id")).distinct()
    seen = cut(guards.filter(F.col("id").isNotNull()).select(F.col("id").alias("node_id"), F.col("id").alias("guard_id"), F.lit(0).alias("hops"), F.array(F.col("id")).alias("via")).distinct())
    front = seen
    for n in range(1, hops + 1):
        way = F.when(F.col("hops") == 0, F.col("via")).otherwise(F.concat(F.array("node_id"), "via"))
        step = front.join(calls, "node_id").select(F.col("caller").alias("node_id"), "guard_id", F.lit(n).alias("hops"), way.alias("via"))
        front = cut(step.join(seen.select("node_id", "guard_id"), ["node_id", "guard_id"], "left_anti").groupBy("node_id", "guard_id", "hops").agg(F.min("via").alias("via")))
        seen = seen.unionByName(front)
    return seen.filter("hops > 0")


def door_diff(prev: DataFrame, following: DataFrame) -> DataFrame:
    """id, change (new, lost-check, removed), name, writes of doors that a check is expected before.

    Both sides have id, name, endpoint_kind, verified, writes and n_guards, keys unique; a door is judged by its own side. A
    door that lost every check is reported though nothing else of it changed. Order: writing doors first, then by name.
    """
    side = lambda df, tag: df.filter(is_auth_relevant(F.col("endpoint_kind"), F.col("verified"))).select("id", *(F.col(c).alias(f"{c}_{tag}") for c in ("name", "writes", "n_guards")), F.lit(True).alias(f"here_{tag}"))
    existed = prev.select("id", F.lit(True).alias("__was"), F.coalesce("n_guards", F.lit(0)).alias("__guards"))
    now = side(following, "b").join(existed, "id", "left")
    change = F.when(F.col("__was").isNull(), "new").when((F.col("__guards") > 0) & (F.coalesce("n_guards_b", F.lit(0)) == 0), "lost-check")
    there = now.select("id", change.alias("change"), F.col("name_b").alias("name"), F.col("writes_b").alias("writes")).filter(F.col("change").isNotNull())
    gone = side(prev, "a").join(following.select("id"), "id", "left_anti").select("id", F.lit("removed").alias("change"), F.col("name_a").alias("name"), F.col("writes_a").alias("writes"))
    return there.unionByName(gone).orderBy("change", F.desc("writes"), "name", "id")


def comparable(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """because: one row, the first field in which two one-row tables of facts differ, in words; null if they can be compared."""
    a, b = (df.limit(1).select(F.struct(*fields).alias(n)) for df, n in ((before, "a"), (after, "b")))
    said = [F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.concat_ws(" ", F.lit(f), F.lit("was"), F.col(f"a.{f}").cast("string"), F.lit("and is"), F.col(f"b.{f}").cast("string"))) for f in fields]
    return a.crossJoin(F.broadcast(b)).select(F.coalesce(*said).alias("because"))  # one row each


def merge_endpoints(findings: DataFrame) -> DataFrame:
    """One door per (endpoint_kind, key) of findings (endpoint_kind, key, ordinal, name, method, route, writes, schedule,
    handler, path, line): the first finding names it, writes if any does, the first schedule, handlers as a sorted set, sites in
    order."""
    first = lambda c: F.min_by(c, "ordinal").alias(c)
    site = F.struct("ordinal", "path", "line")
    return findings.groupBy("endpoint_kind", "key").agg(
        first("name"), first("method"), first("route"), F.bool_or(F.coalesce("writes", F.lit(False))).alias("writes"),
        F.min_by("schedule", F.when(F.col("schedule").isNotNull(), F.col("ordinal"))).alias("schedule"), F.array_sort(F.collect_set("handler")).alias("handlers"),
        F.transform(F.array_sort(F.collect_list(site)), lambda s: F.struct(s["path"].alias("path"), s["line"].alias("line"))).alias("sites"),
    )


def merge_services(findings: DataFrame) -> DataFrame:
    """One service per name in lower case of findings (name, category, package, host, sends, ordinal): call sites, sorted
    packages and hosts, whether any sends."""
    return findings.filter(F.col("name").isNotNull()).groupBy(F.lower("name").alias("key")).agg(
        F.min_by("name", "ordinal").alias("name"), F.min_by("category", "ordinal").alias("category"), F.count(F.lit(1)).alias("n_sites"),
        F.array_sort(F.collect_set("package")).alias("packages"), F.array_sort(F.collect_set("host")).alias("hosts"), F.bool_or(F.coalesce("sends", F.lit(False))).alias("sends"),
    ).orderBy(F.desc("n_sites"), "name")


def merge_stores(findings: DataFrame) -> DataFrame:
    """One store per key in lower case of findings (store, table, operation, ordinal), with reads, writes and its sorted tables."""
    return findings.filter(F.col("store").isNotNull()).groupBy(F.lower("store").alias("key")).agg(
        F.min_by("store", "ordinal").alias("name"), F.count_if(F.col("operation") == "read").alias("n_reads"), F.count_if(F.col("operation") == "write").alias("n_writes"),
        F.array_sort(F.collect_set("table")).alias("tables"),
    ).orderBy(F.desc(F.col("n_reads") + F.col("n_writes")), "name")


def env_inventory(reads: DataFrame, documented: DataFrame) -> DataFrame:
    """name, n_reads, n_files, has_default, kind, documented: one row per variable of reads (name, path, has_default)."""
    from strataq.functions.scalars import env_name_kind

    known = documented.filter(F.col("name").isNotNull()).select("name", F.lit(True).alias("documented")).distinct()
    per = reads.filter(F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n_reads"), F.countDistinct("path").alias("n_files"), F.bool_or(F.coalesce("has_default", F.lit(False))).alias("has_default"))
    return per.join(known, "name", "left").select("name", "n_reads", "n_files", "has_default", env_name_kind(F.col("name")).alias("kind"), F.coalesce("documented", F.lit(False)).alias("documented"))


def distinct_guards(guards: DataFrame) -> DataFrame:
    """door_id, name, path, line, confidence: checks of a door without repeats: of one name in one file the first line stays,
    then of one line in one file the first name; certain if any of the repeats is."""
    sure = F.when(F.bool_or(F.col("confidence") == "certain"), "certain").otherwise(F.min("confidence")).alias("confidence")
    by_name = guards.groupBy("door_id", "name", "path").agg(F.min("line").alias("line"), sure)
    return by_name.groupBy("door_id", "path", "line").agg(F.min("name").alias("name"), sure).select("door_id", "name", "path", "line", "confidence")


def matched_routes(doors: DataFrame, matchers: DataFrame) -> DataFrame:
    """door_id, matcher, excluded: the matchers (matcher, excludes) that a door's route fits. A stated query set against all doors.

    Every matcher is an anchored expression; those that begin with a fixed first segment meet the doors of that segment alone,
    the rest all doors. A matcher that is no valid expression fits nothing.
    """
    import re

    from strataq.functions.classes import matcher_regex

    rows = matchers.filter(F.col("matcher").isNotNull()).select("matcher", F.coalesce("excludes", F.lit("")).alias("excludes"), matcher_regex(F.col("matcher")).alias("regex")).distinct().collect()
    def valid(p: str) -> bool:
        try:
            re.compile(p)
        except re.error:
            return False
        return True

    hits = F.array_compact(F.array(*(F.when(F.col("route").rlike(r.regex), F.struct(F.lit(r.matcher).alias("matcher"), F.coalesce(F.col("route").rlike(r.excludes), F.lit(False)).alias("excluded") if r.excludes and valid(r.excludes) else F.lit(False).alias("excluded"))) for r in rows if valid(r.regex))))
    return doors.filter(F.col("route").isNotNull()).select(F.col("id").alias("door_id"), F.explode(hits).alias("m")).select("door_id", "m.matcher", "m.excluded")


def residual_top(rows: DataFrame, group: str, name: str, weight: str, limit: int) -> DataFrame:
    """group, name, weight, place: the heaviest of each group and one row ``N more`` for the rest, so sums stay whole."""
    order = W.partitionBy(group).orderBy(F.desc(weight), name)
    ranked = rows.withColumn("place", F.row_number().over(order))
    top = ranked.filter(F.col("place") <= limit).select(group, F.col(name).cast("string").alias(name), weight, "place")
    rest = ranked.filter(F.col("place") > limit).groupBy(group).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" more")).alias(name), F.sum(weight).alias(weight), F.lit(limit + 1).alias("place"))
    return top.unionByName(rest)
