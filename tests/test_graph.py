"""Graph, history and scalar operators against plain Python on small, dirty inputs."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strataq.functions import scalars as S
from strataq.operators import graph as G
from strataq.operators import hierarchy as H
from strataq.operators import history as T


def rows(df):
    return {tuple(r) for r in df.collect()}


def edges_of(spark, es):
    return spark.createDataFrame([(*e, "likely", i, [e[0]]) for i, e in enumerate(es)], "kind string, from_id string, to_id string, weight bigint, confidence string, ordinal bigint, symbols array<string>")


def test_level_and_outside(spark):
    rnd = random.Random(3)
    tree = [("app", None), ("other", None)] + [(f"m{i}", "app") for i in range(4)] + [(f"f{i}", f"m{i % 4}") for i in range(20)] + [("x", "other"), ("c1", "c2"), ("c2", "c1")]
    names = [n for n, _ in tree]
    es = [("imports" if rnd.random() < 0.5 else "references", rnd.choice([*names, None, "gone"]), rnd.choice(names), rnd.randrange(5)) for _ in range(300)] + [("contains", "m1", "f1", 9)]
    nodes = spark.createDataFrame([(n, p, "module" if n[0] == "m" else "file") for n, p in tree], "id string, parent_id string, kind string")
    p = H.paths(nodes)
    e = edges_of(spark, es)
    child = {n: (n if par == "app" else par if par and par[0] == "m" else None) for n, par in tree}
    want, out = defaultdict(lambda: [0, set()]), Counter()
    for k, a, b, w in es:
        if k == "contains" or a is None or b is None:
            continue
        ca, cb = child.get(a), child.get(b)
        if ca and cb and ca != cb:
            want[ca, cb][0] += w
            want[ca, cb][1].add(k)
        if bool(ca) != bool(cb):
            out[(ca, "out") if ca else (cb, "in")] += w
    assert rows(G.level_rollup(p, e, "app")) == {(a, b, w, ",".join(sorted(k))) for (a, b), (w, k) in want.items()}
    assert rows(G.outside_flows(p, e, "app")) == {(*k, w) for k, w in out.items()}
    assert rows(G.nearest_of_kind(p, nodes, "module")) == {(n, n if n[0] == "m" else par) for n, par in tree if n[0] == "m" or (par or "")[:1] == "m"}
    assert G.level_rollup(p, e, "nowhere").count() == 0
    assert G.live_edges(e, nodes).count() == sum(a in child and b in child for _, a, b, _ in es)
    merged = {(r.kind, r.from_id, r.to_id): r.weight for r in G.merge_edges(e).collect()}
    assert merged == dict(sum((Counter({(k, a, b): w}) for k, a, b, w in es if w), Counter()) | {(k, a, b): 0 for k, a, b, w in es if (k, a, b) not in {x[:3] for x in es if x[3]}})
    top = [r for r in G.neighbours(e, 3).collect()]
    assert all(r.place <= 3 for r in top) and {(r.node_id, r.direction): r.total for r in top}["f1", "in"] == sum(b == "f1" and a is not None and k != "contains" for k, a, b, _ in es)


def test_reach_and_rank(spark):
    es = [("references", "a", "b", 1), ("references", "b", "c", 1), ("references", "c", "d", 1), ("references", "d", "e", 1), ("references", "a", "c", 1), ("references", "c", "a", 1), ("references", None, "a", 1), ("imports", "a", "z", 1)]
    starts = spark.createDataFrame([("a",), ("a",), ("q",)], "id string")
    assert rows(G.reach(edges_of(spark, es), starts, 3)) == {("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("a", "e", 3)}
    links = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e"), ("a", "gone"), (None, "a")]
    ids = list("abcde")
    score = dict.fromkeys(ids, 1 / 5)
    ok = [(s, t) for s, t in links if s in ids and t in ids and s != t]
    deg = Counter(s for s, _ in ok)
    for _ in range(6):
        lost = sum(score[i] for i in ids if not deg[i])
        score = {i: 0.15 / 5 + 0.85 * lost / 5 + 0.85 * sum(score[s] / deg[s] for s, t in ok if t == i) for i in ids}
    got = {r.id: r.score for r in G.rank(spark.createDataFrame([(i,) for i in [*ids, "a", None]], "id string"), spark.createDataFrame(links, "src string, dst string"), 6).collect()}
    assert got.keys() == score.keys() and all(abs(got[i] - score[i]) < 1e-9 for i in ids)
    spread = G.rank(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(links, "src string, dst string"), 6, one_task=0)
    assert all(abs(r.score - score[r.id]) < 1e-9 for r in spread.collect())
    assert abs(sum(r.score for r in G.rank(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(links, "src string, dst string")).collect()) - 1) < 1e-9
    assert G.rank(spark.createDataFrame([], "id string"), spark.createDataFrame([], "src string, dst string")).count() == 0


def test_search_prefix_spans(spark):
    n = spark.createDataFrame([("1", "file", "ledger", "x"), ("2", "type", "LedgerBox", None), ("3", "file", "my_ledger", None), ("4", "module", None, "a/ledger/b"), ("5", "file", "other", "y")], "id string, kind string, name string, path string")
    assert [r.id for r in G.ranked_search(n, " LEDGER ").collect()] == ["1", "2", "3", "4"] and G.ranked_search(n, " ").count() == 0
    p = spark.createDataFrame([("a/b/c.py",), ("a/bb.py",), ("z.py",), (None,), ("a/b/c.py",)], "path string")
    f = spark.createDataFrame([("a",), ("a/b",), ("a/b",), (None,)], "folder string")
    assert rows(G.longest_prefix(p, f)) == {("a/b/c.py", "a/b"), ("a/bb.py", "a"), ("z.py", None), (None, None)}
    points = spark.createDataFrame([("f", 5), ("f", 50), ("g", 1), (None, 1)], "file string, at int")
    spans = spark.createDataFrame([("f", 1, 10, "out"), ("f", 4, 6, "in"), ("f", 4, 6, "inz"), ("g", None, None, "n")], "file string, first int, last int, span string")
    assert rows(G.contained(points, spans)) == {("f", 5, "in"), ("f", 50, None), ("g", 1, None), (None, 1, None)} or rows(G.contained(points, spans)) == {("f", 5, "in"), ("f", 50, None), ("g", 1, None)} | {(None, 1, None)}
    assert rows(G.dominant(spark.createDataFrame([("g", "test"), ("g", "test"), ("g", "ui"), ("h", "test")], "g string, v string"), "g", "v", ["test"]).select("g", "v")) == {("g", "ui"), ("h", "test")}
    assert [r.id for r in G.unused(n.select("id"), spark.createDataFrame([("1",), (None,)], "id string"), [F.col("id")]).collect()] == ["2", "3", "4", "5"]


def test_history(spark):
    a = spark.createDataFrame([("1", "f", "h"), ("2", "f", None), ("3", "f", "h"), ("4", "t", None)], "id string, kind string, hash string")
    b = spark.createDataFrame([("1", "f", "h"), ("2", "f", "x"), ("4", "t", None), ("5", "t", "h")], "id string, kind string, hash string")
    assert rows(T.diff(a, b)) == {("2", "f", "changed"), ("3", "f", "removed"), ("5", "t", "added")}
    assert T.diff(a.limit(0), b.limit(0)).count() == 0
    r = spark.createDataFrame([("k", 1, "a"), ("k", 3, "b"), ("k", None, "c"), (None, 1, "d")], "key string, t int, v string")
    assert rows(T.last_wins(r, "key", "t").select("key", "v")) == {("k", "b"), (None, "d")}
    assert sorted(x.unique_name for x in T.unique_names(spark.createDataFrame([("n", 1), ("n", 2), ("m", 1)], "name string, o int"), "name", "o").collect()) == ["m", "n", "n~2"]
    taken = spark.createDataFrame([("n", 1), ("n", 2), ("n~2", 1), ("n~2", 2)], "name string, o int")
    assert sorted(x.unique_name for x in T.unique_names(taken, "name", "o").collect()) == ["n", "n~2", "n~2~2", "n~~2"]
    docs = "id string, summary_source string, doc_hash string, body_hash string, docs_stale boolean"
    was = spark.createDataFrame([("1", "docs", "d", "b", False), ("2", "docs", "d", "b", True), ("3", "docs", "d", "b", True), ("4", "docs", "d", None, False)], docs)
    now = spark.createDataFrame([("1", "docs", "d", "x", None), ("2", "docs", "d", "b", None), ("3", "docs", "e", "b", None), ("4", "docs", "d", "b", None)], docs)
    assert rows(T.stale_docs(was, now)) == {("1", True), ("2", True), ("4", False)}
    cur = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", None)], "path string, hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "9"), ("z", "0"), ("d", None)], "path string, hash string")
    uses = spark.createDataFrame([("a", "b"), ("d", "a"), ("d", None)], "src string, dst string")
    assert rows(T.cache_plan(cur, old, uses)) == {("a", "importer"), ("b", "changed"), ("c", "new"), ("d", "reuse"), ("z", "gone")}


def test_scalars(spark):
    def one(expr, *values):
        df = spark.createDataFrame([(v,) for v in values], "x string")
        return [r[0] for r in df.select(expr(F.col("x"))).collect()]

    import hashlib

    h = lambda t: hashlib.sha256(t.encode()).hexdigest()[:16]
    assert one(S.content_hash, "a \t\r\nb  ", "", None) == [h("a\nb"), h(""), None]
    assert one(lambda c: S.parts_hash(c, F.lit("z")), "a", None) == [h("a\0z"), h("\0z")]
    assert one(S.folder_of, "a/b/c.x", "c", None) == ["a/b", "", None] and one(S.extension_of, "a.b/C.TS", ".env", "x") == [".ts", "", ""]
    assert one(S.module_of, "a/index.ts", "b/__init__.py", "c/d.go") == ["a", "b", "c/d"]
    assert one(S.host_of, "https://u:p@Ex.COM:8/x", "no", None) == ["ex.com", None, None]
    assert one(S.path_pattern, "/A/:id/42/?q", "/x/{y}/", "/") == ["/a/{}/{}", "/x/{}", "/"]
    assert one(S.first_sentence, "One  v1.2 is.\nTwo", "none", "Why? ", "", None, "x" * 200) == ["One v1.2 is.", "none", "Why?", "", None, "x" * 160]
    assert one(lambda c: S.clip(c, 5), "abcdefgh", "abc", "abc  de") == ["abcd…", "abc", "abc…"]
    assert one(S.sql_operation, "-- c\nSELECT 1", "(with x as", "DELETE FROM t", "grant x", None) == ["read", "read", "write", None, None]
    assert one(S.sql_table, 'insert into public."T" values', "select * from a.b join c", "drop table if exists x", "select 1") == ["T", "a.b", "x", None]
    assert one(S.env_name_kind, "NEXT_PUBLIC_TOKEN", "DB_PASSWORD", "PORT") == ["public", "secret", "plain"]
    assert spark.range(1).select(S.percent(F.lit(1), F.lit(3)), S.percent(F.lit(1), F.lit(0))).first() == (33, 0)


def test_contained_compares_no_pairs(spark):
    import random

    rnd = random.Random(5)
    spans = [(f, a, a + rnd.choice([-1, 0, 1, 7, 60, 900]), f"s{i:03}") for i in range(400) for f in [rnd.choice("fg")] for a in [rnd.randrange(-20, 1000)]] + [("f", 1, None, "n"), (None, 1, 9, "n")]
    points = [(rnd.choice("fgh"), rnd.randrange(-30, 1200)) for _ in range(500)] + [("f", None), (None, 5)]
    p, s = spark.createDataFrame(points, "file string, at int"), spark.createDataFrame(spans, "file string, first int, last int, span string")

    def want(f, at):
        held = [(b - a, n) for g, a, b, n in spans if at is not None and f is not None and g == f and b is not None and a <= at <= b]
        return min(held)[1] if held else None

    assert rows(G.contained(p, s)) == {(f, at, want(f, at)) for f, at in points}
    assert G.contained(p, s.limit(0)).filter("span IS NOT NULL").count() == 0


def test_contained_joins_on_equal_keys(spark):
    points = spark.range(3000).selectExpr("'f' AS file", "CAST(id AS INT) AS at")
    spans = spark.range(3000).selectExpr("'f' AS file", "CAST(id AS INT) AS first", "CAST(id + 1 AS INT) AS last", "CAST(id AS STRING) AS span")
    plan = G.contained(points, spans)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join " in line]
    assert joins and not any("<=" in line for line in joins)  # equal keys alone
