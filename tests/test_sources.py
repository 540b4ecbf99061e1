"""Readers and sinks on small files."""

import json

from strataq.sources import manifests as M
from strataq.sources import python_code as P
from strataq.sources import sinks

FILES = [
    ("s", "package.json", json.dumps({"name": "x", "dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}, "main": "./lib/i.js", "bin": {"x": "cli.js"}, "exports": {".": {"import": "./e.mjs"}}, "scripts": {"go": "node tools/run.ts --x"}})),
    ("s", "bad/package.json", "{"), ("s", "requirements-dev.txt", "# c\nFoo_Bar>=1\n-r x\nzed[extra]==2 ; python_version>'3'\n"), ("s", "pyproject.toml", '[project]\ndependencies = ["Req.A>1"]\n[tool.poetry.dependencies]\npython = "3"\nb = "1"\n'),
    ("s", "go.mod", "module m.io/x\n\nrequire a.io/b v1.2.3\nrequire (\n\tc.io/d v0.1.0\n\te.io/f v2.0.0 // indirect\n)\n"), ("s", "Cargo.toml", '[dependencies]\na = "1"\nb = { version = "2" }\n[target.\'cfg(unix)\'.dev-dependencies]\nc = "3"\n'),
    ("s", "x.csproj", '<Project><PackageReference Include="N.A" Version="1.0" /><FrameworkReference Include="F" /></Project>'), ("s", ".env.example", "A=1\nexport B_2 = x\n# C=3\n"), ("s", ".env", "SECRET=1"),
    ("s", "appsettings.Dev.json", '{"A": {"B": 1, "C": ["x"]}}'), ("s", "vercel.json", '{"crons": [{"path": "/p", "schedule": "* * * * *"}]}'), ("s", "a/b.vue", ""), ("s", "c.vue", None), ("s", "d.astro", ""), ("s", "node_modules/z.js", ""), ("s", "src/z.ts", ""),
]


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_manifests(spark):
    f = spark.createDataFrame(FILES, "scope_id string, rel_path string, content string")
    assert rows(M.node_packages(f).select("package", "kind")) == {("a", "dependencies"), ("b", "devDependencies")}
    assert rows(M.entry_points(f).select("path", "field", "command")) == {("lib/i.js", "main", None), ("cli.js", "bin", "x"), ("e.mjs", "exports", None), ("tools/run.ts", "scripts", "go")}
    assert rows(M.python_packages(f).select("package")) == {("foo-bar",), ("zed",), ("req-a",), ("b",)}
    assert rows(M.go_modules(f).select("package", "kind")) == {("m.io/x", "module"), ("a.io/b", "require"), ("c.io/d", "require")}
    assert rows(M.cargo_packages(f).select("package", "version")) == {("a", "1"), ("b", "2"), ("c", "3")}
    assert rows(M.dotnet_packages(f).select("package", "version")) == {("N.A", "1.0"), ("F", None)}
    assert rows(M.env_names(f).select("name")) == {("A",), ("B_2",)}
    assert rows(M.settings(f).select("name", "value")) == {("A", None), ("A:B", "1"), ("A:C", None), ("A:C:0", "x")}
    assert rows(M.scheduled_routes(f).select("path", "schedule")) == {("/p", "* * * * *")}
    assert [tuple(r) for r in M.unread_formats(f).collect()] == [("vue", 2), ("astro", 1)]
    assert rows(M.source_files(f).select("rel_path")) == {("src/z.ts",)}
    assert M.node_packages(f.limit(0)).count() == 0


def test_scan(spark, tmp_path):
    (tmp_path / "a/.git").mkdir(parents=True)
    (tmp_path / "a/x.py").write_text("pass")
    (tmp_path / "a/.git/y").write_text("no")
    assert rows(M.scan(spark, str(tmp_path)).select("rel_path", "content")) == {("a/x.py", "pass")}


def test_python(spark):
    code = "import os.path as p\nfrom .util import f as g, h\n@deco.it(1)\nclass A(B.C):\n    def m(self):\n        return g(self.x.y())\n\nif __name__ == '__main__':\n    main()\n"
    book = json.dumps({"cells": [{"cell_type": "code", "source": ["%magic\n", "def q(): pass"]}, {"cell_type": "code", "source": "not ( valid"}, {"cell_type": "markdown", "source": "x"}]})
    f = spark.createDataFrame([("1", "pkg/a.py", code), ("2", "b.ipynb", book), ("3", "c.py", "def"), ("4", "d.py", None), ("5", "e.go", "x"), (None, "pkg/util.py", "﻿x = 1")], "key string, rel_path string, content string")
    facts = P.python_facts(f)
    got = rows(facts.select("key", "fact", "name", "owner", "target"))
    assert {("1", "import", "p", None, "os.path"), ("1", "import", "g", None, ".util:f"), ("1", "class", "A", None, None), ("1", "base", "A", None, "B.C"), ("1", "decorator", "A", None, "deco.it"), ("1", "function", "m", "A", None),
            ("1", "call", "g", "A.m", "g"), ("1", "call", "y", "A.m", "self.x.y"), ("1", "main", "__main__", None, None), ("2", "function", "q", None, None), ("3", "error", "SyntaxError", None, None)} <= got
    g = spark.createDataFrame([("9", "import", "f", None, "pkg.util:f", 1, 1), ("9", "import", "k", None, "os", 1, 1)], "key string, fact string, name string, owner string, target string, line int, end_line int")
    assert [(r.key, r.target_path, r.names) for r in P.resolve_imports(g, f).collect()] == [("9", "pkg/util.py", ["f"])]


def test_sinks(spark, tmp_path):
    n = spark.createDataFrame([("a", "file", 1), ("b", "type", 2)], "id string, kind string, x int")
    e = spark.createDataFrame([("a", "b", "imports")], "from_id string, to_id string, kind string")
    sinks.write_snapshot(n, e, str(tmp_path / "s"), "one")
    sinks.write_snapshot(n.limit(1), e, str(tmp_path / "s"), "two")
    assert sinks.read_snapshot(spark, str(tmp_path / "s"))[0].count() == 1 and sinks.read_snapshot(spark, str(tmp_path / "s"), "one")[0].count() == 2
    sinks.export_json(n, e, str(tmp_path / "j"))
    assert {json.loads(r.value)["table"] for r in spark.read.text(str(tmp_path / "j")).collect()} == {"nodes", "edges"}
    old = spark.createDataFrame([("k", 1, "old"), ("l", 1, "old")], "key string, t int, v string")
    new = spark.createDataFrame([("k", 2, "new"), ("m", 1, "new")], "key string, t int, v string")
    assert rows(sinks.upsert(old, new, "key", "t").select("key", "v")) == {("k", "new"), ("l", "old"), ("m", "new")}
    assert rows(sinks.pruned(old, new, spark.createDataFrame([("k",), ("m",)], "key string"), "key").select("key", "v")) == {("k", "new"), ("m", "new")}


def test_stream(spark, tmp_path):
    from datetime import datetime as D

    from strataq.streaming import changes

    ev = [{"ts": f"2025-01-01T00:00:0{s}.{ms:03}", "path": p, "scope_id": "s"} for s, ms, p in [(0, 0, "b"), (0, 100, "a"), (0, 200, "b"), (1, 0, "c")]]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, ev)))
    schema = "ts timestamp, path string, scope_id string"
    table = changes.change_batches(spark.read.schema(schema).json(str(tmp_path / "in")))
    assert sorted((r.paths, r.n_events) for r in table.collect()) == [(["a", "b"], 3), (["c"], 1)]
    seen = []
    q = changes.watch(spark, str(tmp_path / "in"), schema, lambda df, i: seen.append(df.count()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sum(seen) == 4
    stream = changes.change_batches(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert stream.isStreaming and spark.table("bursts").count() <= 2 and D


def test_cache_views(spark, tmp_path):
    n = spark.createDataFrame([("a", "file", "x"), ("b", "file", "y")], "id string, kind string, payload string")
    e = spark.createDataFrame([("imports", "a", "b")], "kind string, from_id string, to_id string")
    at = str(tmp_path / "c")
    sinks.write_snapshot(n, e, at, "one")
    found = sinks.lookup(sinks.read_snapshot(spark, at)[0], ["a"], "id")
    assert [r.payload for r in found.collect()] == ["x"] and sinks.lookup(n, []).count() == 0 and sinks.index_of(n, "id").columns == ["id"]
    sinks.truncate(spark, at, "two")
    assert sinks.read_snapshot(spark, at)[0].count() == 0 and sinks.read_snapshot(spark, at, "one")[0].count() == 2
    (tmp_path / "c" / "current" / "000000000003").mkdir()  # a pointer whose writing broke
    assert sinks.read_snapshot(spark, at)[0].count() == 0
