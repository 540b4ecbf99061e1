"""Doors, groups and classifiers against plain expectations on small, dirty inputs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strataq.functions import classes as K
from strataq.operators import doors as D
from strataq.operators import graph as G
from strataq.operators import groups as P
from strataq.operators import hierarchy as H
from strataq.operators import scale as C


def rows(df):
    return {tuple(r) for r in df.collect()}


def one(spark, expr, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(expr(F.col("x"))).collect()]


def test_zones(spark):
    paths = ["tests/a.py", "x/models.py", "api/x.py", "a/settings.py", "a/gunicorn_config.py", "a/b.py", "p/a_test.go", "cmd/main.go", "src/benches/x.rs", "build.rs", "test_x.ipynb", "db/x.ipynb", "a/b.test.tsx", "vite.config.ts", "src/api/x.ts", "App.TSX", "lib/x.ts", "", None]
    assert one(spark, K.zone_of, *paths) == ["test", "data", "api", "config", "config", "logic", "test", "logic", "test", "config", "logic", "data", "test", "config", "api", "ui", "logic", "logic", None]


def test_personal_columns(spark):
    got = one(spark, K.personal_column, "emailAddress", "customer_email", "file_name", "full-name", "owner_name", "applicant_dob", "status_email", "", None, "order_total", "_SSN_")
    assert [(x.category, x.strength) if x else None for x in got] == [("contact", "direct"), ("contact", "direct"), None, ("person-name", "ambiguous"), None, ("date-of-birth", "direct"), None, None, None, None, ("government-id", "direct")]


def test_small_functions(spark):
    assert one(spark, K.route_segment, "(g)", "@slot", "[id]", "[...all]", "[[...all]]", "x", "") == [None, None, ":id", "*", "*", "x", None]
    assert one(spark, lambda c: K.file_route(c, True), "(tabs)/index.tsx", "cellar/[id].tsx", "index.ts", None) == ["/", "/cellar/:id", "/", None]
    assert one(spark, K.file_route, "a/(g)/[x]/page.tsx", "page.tsx") == ["/a/:x", "/"]
    assert one(spark, K.matcher_regex, "/dashboard/:path*", "/a/:x", "/a/:x+", "/*", "/(.*)") == ["^/dashboard(?:/.*)?$", "^/a/[^/]+$", "^/a/.*$", "^/.*$", "^/(.*)$"]
    assert one(spark, lambda c: K.resolve_specifier(c, F.lit("a/b/c.ts")), "./x", "../y.ts", "@/z", "#w", "react", None) == ["a/b/x", "a/y", "z", "w", None, None]
    assert one(spark, K.catalog_of, "pg_class", "information_schema.x", "user_sessions", None) == ["pg_catalog", "information_schema", None, None]
    arrays = spark.createDataFrame([(1, ["a", None, "b", "", "c"]), (2, ["a"]), (3, [])], "i int, x array<string>").orderBy("i")
    assert [r[0] for r in arrays.select(K.listed(F.col("x"))).collect()] == ["a, b and c", "a", ""]
    r = spark.createDataFrame([("_legacy/a.py", "logic", None), ("a.py", "logic", "\n ** Deprecated: use b\nx"), ("a.py", "test", "deprecated"), ("a.py", "logic", "Adds. @deprecated"), ("a.py", None, None), (None, None, None)], "p string, z string, s string")
    assert [tuple(x[0]) if x[0] else None for x in r.select(K.retirement(F.col("p"), F.col("z"), F.col("s"))).collect()] == [("path", "_legacy"), ("docstring", "Deprecated: use b"), None, ("docstring", "@deprecated"), None, None]


DOORS = "id string, endpoint_kind string, verified boolean, method string, route string, writes boolean, n_guards int, sign_in string, generated boolean, name string, n_handlers int, n_sites int"


def door(i, kind="http-route", method="GET", route="/x", writes=False, guards=0, sign_in=None, generated=False, verified=None, handlers=1):
    return (i, kind, verified, method, route, writes, guards, sign_in, generated, i, handlers, 1)


def test_open_doors(spark):
    doors = spark.createDataFrame(
        [door("blind"), door("far"), door("mount", route="/auth/*"), door("in", sign_in="auth.signIn"), door("both", sign_in="auth.signIn", writes=True), door("gen", generated=True), door("page", method="PAGE"), door("wpage", method="PAGE", writes=True),
         door("look"), door("look"), door("shut", guards=1), door("hook", kind="webhook", verified=True), door("cli", kind="cli"), door("loose", kind="webhook"), door("bare", route=None)], DOORS)
    files = spark.createDataFrame([("blind", "u", 0), ("far", "f", 0), ("mount", "m", 0), ("look", "m", 0), (None, "u", 0)], "door_id string, file_id string, place int")
    imports = spark.createDataFrame([("f", "u"), ("f", None), ("m", "f")], "from_id string, to_id string")
    unread = spark.createDataFrame([("u", "u.py")], "file_id string, path string")
    mounts = spark.createDataFrame([("m", "provider")], "file_id string, provider string")
    writers = spark.createDataFrame([("both",)], "door_id string")
    got = {r.id: r.verdict for r in D.open_doors(doors, files, imports, unread, mounts, writers).collect()}
    assert got == {"blind": "unreadable", "far": "unreadable", "mount": "auth-mount", "in": "auth-mount", "both": "worth-a-look", "gen": "generated", "page": "page", "wpage": "worth-a-look", "look": "worth-a-look", "loose": "worth-a-look", "bare": "worth-a-look"}
    assert D.open_doors(doors.limit(0), files, imports, unread, mounts, writers).count() == 0
    top = [r.id for r in D.entry_points(doors.filter("id IN ('look', 'both', 'page')").distinct()).collect()]
    assert top == ["both", "look", "page"]


def test_door_diff_and_reach(spark):
    a = spark.createDataFrame([door("lost", guards=2), door("gone", writes=True), door("same", guards=1), door("cli", kind="cli")], DOORS)
    b = spark.createDataFrame([door("lost"), door("new", writes=True), door("same", guards=1), door("cli2", kind="cli")], DOORS)
    assert [(r.id, r.change) for r in D.door_diff(a, b).collect()] == [("lost", "lost-check"), ("new", "new"), ("gone", "removed")]
    calls = spark.createDataFrame([("b", "g"), ("c", "b"), ("d", "c"), ("e", "d"), ("g", "b"), ("c", "g"), (None, "g"), ("b", "g")], "from_id string, to_id string")
    guards = spark.createDataFrame([("g",), (None,)], "id string")
    assert {(r.node_id, r.hops, tuple(r.via)) for r in D.guard_reach(guards, calls).collect()} == {("b", 1, ("g",)), ("c", 1, ("g",)), ("d", 2, ("c", "g")), ("e", 3, ("d", "c", "g"))}
    one_ = spark.createDataFrame([(1, "x")], "format int, root string")
    assert D.comparable(one_, spark.createDataFrame([(1, "y")], "format int, root string"), ["format", "root"]).first()[0] == "root was x and is y" and D.comparable(one_, one_, ["format", "root"]).first()[0] is None


def test_merges(spark):
    f = spark.createDataFrame(
        [("http", "k", 2, "two", "GET", "/", True, None, "h", "p", 1), ("http", "k", 1, "one", "GET", "/", None, None, "g", "q", 2), ("http", "k", 3, "x", "GET", "/", False, "daily", None, None, None)],
        "endpoint_kind string, key string, ordinal int, name string, method string, route string, writes boolean, schedule string, handler string, path string, line int",
    )
    r = D.merge_endpoints(f).first()
    assert (r["name"], r.writes, r.schedule, r.handlers, [s.path for s in r.sites]) == ("one", True, "daily", ["g", "h"], ["q", "p", None])
    g = spark.createDataFrame([("d", "n", "p", 5, "likely"), ("d", "n", "p", 3, "certain"), ("d", "m", "p", 3, "likely"), ("d", "n", None, None, "likely")], "door_id string, name string, path string, line int, confidence string")
    assert rows(D.distinct_guards(g)) == {("d", "m", "p", 3, "certain"), ("d", "n", None, None, "likely")}
    top = D.residual_top(spark.createDataFrame([("g", "a", 5), ("g", "b", 3), ("g", "c", 1)], "g string, n string, w bigint"), "g", "n", "w", 1)
    assert rows(top) == {("g", "a", 5, 1), ("g", "2 more", 4, 2)}
    reads = spark.createDataFrame([("DB_PASSWORD", "a", None), ("DB_PASSWORD", "b", True), ("PORT", "a", False), (None, "a", False)], "name string, path string, has_default boolean")
    assert rows(D.env_inventory(reads, spark.createDataFrame([("PORT",), (None,)], "name string"))) == {("DB_PASSWORD", 2, 2, True, "secret", False), ("PORT", 1, 1, False, "plain", True)}
    routes = spark.createDataFrame([("a", "/x/y"), ("b", "/z"), ("c", None)], "id string, route string")
    m = spark.createDataFrame([("/:p/:q", None), ("/([", None), ("/*", "^/z"), (None, None)], "matcher string, excludes string")
    assert rows(D.matched_routes(routes, m)) == {("a", "/:p/:q", False), ("a", "/*", False), ("b", "/*", True)}


def plain_cut(folders, split, most):
    """The cut by looking through all folders again at each step."""
    kids, ids = defaultdict(list), {f[0] for f in folders}
    for f in folders:
        kids[f[1] if f[1] in ids else None].append(f)
    cut, settled = {f[0]: f for f in kids[None]}, set()
    while True:
        able = sorted((f for f in cut.values() if f[0] not in settled and f[4] > split and kids[f[0]]), key=lambda f: (-f[4], f[2]))
        if not able:
            return sorted(cut)
        f = able[0]
        settled.add(f[0])
        if len(cut) + len(kids[f[0]]) - (0 if f[3] else 1) > most:
            continue
        if not f[3]:
            del cut[f[0]]
        cut |= {k[0]: k for k in kids[f[0]]}


@pytest.mark.parametrize("seed", range(20))
def test_folder_cut_against_a_plain_one(seed):
    rnd = random.Random(seed)
    own = {f"d{i}": rnd.choice([0, 0, 1, 5, 20]) for i in range(30)}
    parent = {f"d{i}": (f"d{rnd.randrange(i)}" if i and rnd.random() < 0.9 else None) for i in range(30)}
    below = dict(own)
    for i in range(29, -1, -1):
        if parent[f"d{i}"]:
            below[parent[f"d{i}"]] += below[f"d{i}"]
    folders = [(k, parent[k], k, own[k], below[k]) for k in own]
    assert P.open_folders(folders, 12, 12) == plain_cut(folders, 12, 12)


def test_groups(spark):
    names = [f"src/a{i}/f{k}.py" for i in range(3) for k in range(9)] + ["src/x.py", "README.md"]
    files = spark.createDataFrame([(n, n, n.rsplit("/", 1)[-1], "s", "test" if "a0" in n else "logic") for n in names] + [("null", None, None, "s", None)], "id string, path string, name string, scope_id string, zone string")
    counts = P.folder_counts(files)
    assert {(r.folder, r.own, r.below) for r in counts.collect()} == {("", 1, 29), ("src", 1, 28)} | {(f"src/a{i}", 9, 9) for i in range(3)}
    folders = counts.withColumnRenamed("folder", "path").withColumn("id", F.col("path")).withColumn("parent_id", F.when(F.col("path") != "", F.regexp_replace("path", "(^|/)[^/]+$", "")))
    cut = P.folder_cut(folders)
    assert {r.path for r in cut.collect()} == {"", "src", "src/a0", "src/a1", "src/a2"}
    got = {r.id: r.group for r in P.assign(files, cut.filter("path <> ''")).collect()}
    assert got["src/x.py"] == "src" and got["src/a1/f2.py"] == "src/a1" and got["README.md"] is None and got["null"] is None
    shaped = {r.group: r for r in P.shape(files.join(P.assign(files, cut).select("id", "group"), "id")).collect()}
    assert shaped["src/a0"].n_files == 9 and shaped["src/a0"].zone == "test" and len(shaped["src/a1"].names) == 9
    e = spark.createDataFrame([("src/x.py", "src/a1/f1.py", 2), ("src/x.py", "src/a1/f2.py", 3), ("src/a1/f1.py", "src/a1/f2.py", 9), (None, "src/x.py", 1)], "from_id string, to_id string, weight bigint")
    assert rows(P.links(e, P.assign(files, cut))) == {("src", "src/a1", 5)}
    assert rows(P.collapse(P.folder_counts(spark.createDataFrame([("s", "a/b/c.py")], "scope_id string, path string"))).select("folder", "shown")) == {("", True), ("a", False), ("a/b", True)}


def test_world_flows(spark):
    tree = [("app", None, "app"), ("m", "app", "module"), ("f", "m", "file"), ("out", None, "zone"), ("s", "out", "store"), ("t", "s", "type"), ("q", "out", "file")]
    nodes = spark.createDataFrame(tree, "id string, parent_id string, kind string")
    e = spark.createDataFrame([("writes-to", "f", "t", 2), ("reads-from", "f", "s", 1), ("references", "s", "m", 5), ("references", "f", "q", 9), ("contains", "f", "s", 7), ("references", None, "f", 1)], "kind string, from_id string, to_id string, weight bigint")
    got = rows(G.world_flows(H.paths(nodes), nodes, e, "app").select("world_id", "child", "direction", "weight", "kinds", "total"))
    assert got == {("s", "m", "out", 3, "reads-from,writes-to", 8), ("s", "m", "in", 5, "references", 8)}


def test_salted_join_by_rows_per_task(spark):
    left = spark.range(3000).selectExpr("IF(id < 2000, 'hot', 'k' || id % 300) AS k", "id")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", 2) for i in range(250)], "k string, v int")
    hot = {r.k: r["__salts"] for r in C.hot_keys(left, "k", task_rows=100).collect()}
    assert hot == {"hot": 134}
    got = C.salted_join(left, right, "k", "left", task_rows=100)
    assert got.count() == 3000 and got.filter("k = 'hot' AND v = 1").count() == 2000 and got.filter("v IS NULL").count() == left.join(right, "k", "left_anti").count()
    assert C.measured(spark.createDataFrame([({"a": "x" * 1000},)], "m map<string,string>"))[1] > 1000


def test_checkpoints_refuse_a_cluster_without_a_shared_folder(monkeypatch):
    class Nothing:
        def __getattr__(self, _):
            return self

        def __call__(self, *a):
            return self

    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

        conf = type("F", (), {"get": staticmethod(lambda k, default=None: None)})

    with pytest.raises(ValueError):
        C.checkpoint_dir(Session)


def test_views(spark):
    from strataq.operators import views as V

    assert [V.read_limit(x) for x in (None, "5", 0, 9999, "x", 2.9, float("nan"), float("inf"))] == [60, 5, 1, 500, 60, 2, 60, 60]
    n = spark.createDataFrame([("a", "ui"), ("b", "test"), ("c", None)], "id string, zone string")
    e = spark.createDataFrame([("a", "b"), ("a", "c"), (None, "a")], "from_id string, to_id string")
    kept, seen, hidden = V.filter_level(n, e, ["test"])
    assert {r.id for r in kept.collect()} == {"a", "c"} and {(r.from_id, r.to_id) for r in seen.collect()} == {("a", "c"), (None, "a")} and rows(hidden) == {("test", 1)}
    f = spark.createDataFrame([("x", "p", 2), ("x", "p", 3), (None, "p", 1)], "l string, r string, w bigint")
    assert rows(V.flows(f, "l", "r", "w", spark.createDataFrame([("x", "p"), ("y", "p")], "l string, r string"))) == {("x", "p", 5), ("y", "p", 1)}
    r = spark.createDataFrame([(None, 3), (False, 3), (True, 0), (True, None), (True, 1)], "e boolean, n int")
    assert [x[0] for x in r.select(V.rls_rank(F.col("e"), F.col("n"))).collect()] == [2, 0, 1, 1, 3]
    g = spark.createDataFrame([("1", "function", "go"), ("2", "function", "GO"), ("3", "file", "f"), ("go", "file", "x")], "id string, kind string, name string")
    c = spark.createDataFrame([("references", "3", "1", 2), ("references", "3", "2", 5), ("references", "3", "go", 1), ("imports", "3", "1", 9), ("references", None, "1", 1)], "kind string, from_id string, to_id string, weight bigint")
    assert [(x.target_id, x.n_targets) for x in V.callers(g, c, " Go ").collect()] == [("2", 2), ("1", 2)] and [x.target_id for x in V.callers(g, c, "go").collect()] == ["go"] and V.callers(g, c, " ").count() == 0
    assert rows(V.door_classes(spark.createDataFrame([("http-route",), ("odd",), (None,)], "endpoint_kind string"))) == {("network", 1), ("other", 2)}
