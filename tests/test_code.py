"""Rules over code, configuration files and facts in words, on small dirty inputs."""

import pytest

from strataq.operators import reports as R
from strataq.sources import boundaries as B
from strataq.sources import configs as C

FILES = "scope_id string, path string, content string"
LINES = [
    ("a.ts", "app.get('/users/:id', users.show)", ("http-route", "express", "GET", "/users/:id", "users.show")), ("a.ts", "  @Post('x')", ("http-route", "nest", "POST", "x", None)), ("a.ts", "@Get()", ("http-route", "nest", "GET", None, None)),
    ("a.ts", "@Controller('cats')", ("router", "nest", None, "cats", None)), ("a.tsx", "list: publicProcedure.input(z).query(() => 1)", ("procedure", "trpc", "QUERY", "list", None)), ("a.js", "app.use('/v1', api)", ("router", "mount", None, "/v1", "api")),
    ("a.ts", "cron.schedule('0 * * * *', run)", ("job", "cron", None, "0 * * * *", None)), ("a.ts", "await fetch(`https://x.example/y`)", ("outbound", "fetch", None, "https://x.example/y", None)), ("a.ts", "await prisma.user.findMany({})", ("store", "prisma", "FINDMANY", "user", None)),
    ("a.ts", "const k = process.env.API_KEY", ("env", "node", None, "API_KEY", None)), ("a.ts", "return res.status(401).end()", ("refusal", "status", None, "401", None)), ("a.ts", "  @UseGuards(JwtGuard)", ("guard", "nest", None, "JwtGuard", None)),
    ("a.py", "@router.post(\"/items\")", ("http-route", "flask-fastapi", "POST", "/items", "router")), ("a.py", "    path('x/<int:y>', views.show),", ("http-route", "django", None, "x/<int:y>", "views.show")), ("a.py", "app.include_router(users, prefix='/u')", ("router", "include", None, "/u", "users")),
    ("a.py", "x = os.environ.get('HOME')", ("env", "python", None, "HOME", None)), ("a.py", "def f(u=Depends(get_user)):", ("guard", "depends", None, "get_user", None)), ("a.py", "@shared_task", ("job", "celery", None, "shared_task", None)), ("a.py", "requests.get('https://x.test/a')", ("outbound", "requests", "GET", "https://x.test/a", None)),
    ("m.go", "mux.HandleFunc(\"/health\", h.Health)", ("http-route", "mux", "HANDLEFUNC", "/health", "h.Health")), ("m.go", "p := os.Getenv(\"PORT\")", ("env", "go", None, "PORT", None)), ("c.cs", "[HttpGet(\"{id}\")]", ("http-route", "aspnet", "GET", "{id}", None)), ("c.cs", "app.MapPost(\"/x\", Add)", ("http-route", "minimal-api", "POST", "/x", "Add")),
    ("c.cs", "public DbSet<Order> Orders { get; set; }", ("store", "ef", None, "Order", "Orders")), ("r.rs", ".route(\"/x\", get(list))", ("http-route", "axum", "GET", "/x", "list")), ("r.rs", "#[post(\"/y\")]", ("http-route", "attribute", "POST", "/y", None)), ("r.rs", "let k = env::var(\"KEY\");", ("env", "rust", None, "KEY", None)),
]


def test_findings(spark):
    rows = [("s", f"{i}/{p}", f"first\r\n{t}\n") for i, (p, t, _) in enumerate(LINES)] + [("s", "c.ts", "// app.get('/no', x)\n * app.get('/no', x)"), ("s", "n.ts", None), ("s", None, "app.get('/x')"), (None, "e.py", ""), ("s", "x.go", "app.get('/users')")]
    got = {}
    for r in B.findings(spark.createDataFrame(rows, FILES)).collect():
        got.setdefault(r.path, set()).add((r.kind, r.framework, r.method, r.target, r.handler))
        assert r.line == 2
    missing = [(p, t, got.get(f"{i}/{p}")) for i, (p, t, want) in enumerate(LINES) if want not in got.get(f"{i}/{p}", ())]
    assert not missing and set(got) == {f"{i}/{p}" for i, (p, _, _) in enumerate(LINES)}


def test_composed_routes(spark):
    routes = spark.createDataFrame([("s", "root", "/a"), ("s", "users", "/:id"), ("s", "deep", "x"), ("s", "two", "/"), ("s", "round", "/r"), ("t", "users", "/t"), ("s", None, "/n"), ("s", "users", None)], "scope_id string, router string, route string")
    mounts = spark.createDataFrame([("s", "root", "users", "/users"), ("s", "users", "deep", "/deep"), ("s", "root", "two", "/one"), ("s", "root", "two", "/two"), ("s", "round", "other", ""), ("s", "other", "round", ""), ("s", "root", "users", "/users")], "scope_id string, host string, router string, prefix string")
    got = {(r.scope_id, r.router, r.route): r.full for r in B.composed_routes(routes, mounts).collect()}
    assert got == {("s", "root", "/a"): "/a", ("s", "users", "/:id"): "/users/:id", ("s", "deep", "x"): "/users/deep/x", ("s", "two", "/"): "…", ("s", "round", "/r"): "…/r", ("t", "users", "/t"): "/t", ("s", None, "/n"): "/n", ("s", "users", None): "/users"}
    checks = spark.createDataFrame([("s", "root", "a", "jwt"), ("s", "root", "b", None), ("s", "a", "c", None), ("s", "b", "c", "key"), ("s", "b", "d", None), ("s", "a", "d", None)], "scope_id string, host string, router string, guard string")
    own = spark.createDataFrame([("s", "e", "own"), ("s", "f", None)], "scope_id string, router string, guard string")
    assert {(r.router, r.guard) for r in B.behind_a_check(checks, own).collect()} == {("a", "jwt"), ("c", "jwt"), ("e", "own")}
    crons = spark.createDataFrame([("s", "/A/", "daily"), ("s", None, "x")], "scope_id string, path string, schedule string")
    assert {(r.route, r.schedule) for r in B.scheduled(routes.select("scope_id", "route"), crons).collect() if r.route == "/a"} == {("/a", "daily")}


def test_filled_tables(spark):
    t = spark.createDataFrame([("s", "Users", None, True), ("s", "user", [], True), ("s", "orders", ["own"], True), ("s", "twice", None, True), ("s", "plain", None, True), ("s", "known", None, False)], "scope_id string, name string, fields array<string>, observed boolean")
    m = spark.createDataFrame([("s", "User", "users", ["a"], 1), ("s", "User2", "users", ["a", "b"], 2), ("s", "Plain", None, ["p"], 3), ("s", "Twice", "t1", ["x"], 4), ("s", "Other", "twice", ["y"], 5), ("s", "Known", None, ["k"], 6)], "scope_id string, class_name string, table_name string, fields array<string>, ordinal int")
    got = {r.name: (r.fields, r.observed) for r in B.filled_tables(t, m).collect()}
    assert got == {"Users": (["a", "b"], False), "user": ([], True), "orders": (["own"], True), "twice": (None, True), "plain": (["p"], False), "known": (None, False)}


def test_configs(spark):
    files = [
        ("s", "docker-compose.yml", "services:\n  web:\n    image: x\n    ports:\n      - \"127.0.0.1:8080:80\" # c\n      - 443\n    env: y\n  db:\n    image: z\n"),
        ("s", "prisma/schema.prisma", "model User {\n  id Int @id\n  mail String? @unique\n  posts Post[]\n  @@map(\"users\")\n}\nmodel Empty {\n}\n"),
        ("s", "wrangler.toml", "main = \"src/w.ts\"\n# crons = [\"no\"]\ncrons = [\"0 0 * * *\", \"1 * * * *\"]\n[[kv]]\nbinding = \"KV\"\n"),
        ("s", "package.json", '{"workspaces": {"packages": ["packages/*", "!packages/old"]}}'), ("s", "packages/a/package.json", "{}"), ("s", "packages/old/package.json", "{}"), ("s", "packages/a/b/package.json", "{}"), ("t", "packages/a/package.json", "{}"),
        ("u", "pnpm-workspace.yaml", "packages:\n  - 'libs/**'\n"), ("u", "libs/x/y/package.json", "{}"), ("s", "V.xaml", '<Window x:Class="App.V"><Button Click="Go" Loaded="Go"/></Window>'), ("s", "n.xaml", None), ("s", None, None),
    ]
    f = spark.createDataFrame(files, FILES)
    assert {(r.service, r.port.bind_address, r.port.host_port, r.port.container_port) for r in C.compose_ports(f).collect()} == {("web", "127.0.0.1", "8080", "80"), ("web", None, None, "443")}
    models = {r.model: r for r in C.prisma_models(f).collect()}
    assert models["User"].table_name == "users" and [(x["name"], x.type, x.optional, x.many, x.is_id, x.is_unique) for x in models["User"].fields] == [("id", "Int", False, False, True, False), ("mail", "String", True, False, False, True), ("posts", "Post", False, True, False, False)] and models["Empty"].fields == []
    assert {(r.kind, r.value) for r in C.worker_settings(f).collect()} == {("entry", "src/w.ts"), ("cron", "0 0 * * *"), ("cron", "1 * * * *"), ("binding", "KV")}
    assert {(r.scope_id, r.package) for r in C.workspaces(f).collect()} == {("s", "packages/a"), ("u", "libs/x/y")}
    assert {(r.class_name, tuple(r.handlers)) for r in C.markup(f).filter("content IS NOT NULL" if False else "path = 'V.xaml'").collect()} == {("App.V", ("Go",))}
    w = spark.createDataFrame([("s", "wrangler.toml", 1, 1), ("s", "wrangler.toml", 99, 99), ("s", "gone", 1, 1), ("s", "wrangler.toml", None, 1)], "scope_id string, path string, start_line int, end_line int")
    assert [r.text for r in C.source_slice(f, w, 1).collect()] == ['main = "src/w.ts"\n# crons = ["no"]']


STATS = "routes int, open int, unreadable int, public int, unread_files int, likely_only int"


@pytest.mark.parametrize(
    "stats,want",
    [((0, 0, 0, 0, 2, 0), "no routes were found, but 2 files"), ((5, 2, 1, 1, 0, 0), "2 of 5 routes have no"), ((1, 1, 0, 0, 0, 0), "the one route has no"), ((5, 0, 2, 0, 0, 0), "nothing is left unexplained, but 2 of the 5"), ((5, 0, 0, 2, 0, 0), "every one of the 5 routes is checked, or open"),
     ((1, 0, 0, 0, 0, 0), "the one route has an auth check"), ((5, 0, 0, 0, 0, 5), "every one of the 5 routes has an auth check - all matched"), ((5, 0, 0, 0, 0, 2), "every one of the 5 routes has an auth check, though 2"), ((5, None, None, None, None, None), "every one of the 5 routes has an auth check")],
)
def test_headline(spark, stats, want):
    row = R.auth_headline(spark.createDataFrame([stats], STATS)).first()
    assert row.headline.startswith(want) and row.tone == ("warn" if stats[0] == 0 or (stats[1] or 0) + (stats[2] or 0) > 0 else "ok")


def test_no_headline_and_reports(spark):
    assert R.auth_headline(spark.createDataFrame([(0, 0, 0, 0, 0, 0)], STATS)).count() == 0
    changes = spark.createDataFrame([("1", "file", "added"), ("2", "file", "added"), ("3", "type", "added"), ("4", "file", "changed")], "id string, kind string, change string")
    doors = spark.createDataFrame([("d1", "new", "b", False), ("d2", "new", "a", True), ("d3", "new", "c", False)], "id string, change string, name string, writes boolean")
    assert [r.line for r in R.change_report(changes, doors, 2).collect()] == ["added: 2 file and 1 type", "changed: 1 file", "3 doors new: a and b"]
    sections = spark.createDataFrame([("1", 2, "One", "b"), ("1", 1, "One", "a\nx"), ("2", None, "Two", None)], "section string, place int, title string, line string")
    assert [r.text for r in R.markdown(sections).collect()] == ["## One", "", "- a x", "- b", "", "## Two", "", ""]
    assert R.markdown(sections.limit(0)).count() == 0


def test_declarations_and_imports(spark):
    from strataq.sources import declarations as L

    files = [
        ("s", "web/a.ts", "import { b } from './lib/b';\nexport async function go(x) {\n  if (x) {\n  }\n  return helper(b, b);\n}\nexport const arrow = (y: number): number => y;\nclass K {\n  private run(a: string): void {\n  }\n}\n"), ("s", "web/lib/b/index.ts", "export function helper() {\n}\nconst z = require('../../a');\n"),
        ("s", "py/app/main.py", "from app.util import thing\nimport os\n"), ("s", "py/app/util.py", "class thing:\n    def m(self):\n        pass\n"), ("t", "py/app/util.py", "x = 1\n"), ("s", "go/cmd/main.go", "package main\nimport (\n\t\"fmt\"\n\t\"example.com/x/pkg/store\"\n)\nfunc main() {}\n"), ("s", "go/pkg/store/s.go", "package store\nfunc (s *S) Get() {}\ntype S struct {}\n"),
        ("s", "cs/A.cs", "using My.Space;\nnamespace Other;\npublic partial class A\n{\n    public static int F(int a) => a;\n}\n"), ("s", "cs/B.cs", "namespace My.Space\n{\n    class B {}\n}\n"), ("s", "cs/A2.cs", "namespace Other;\npublic partial class A {}\n"),
        ("s", "rs/src/main.rs", "mod engine;\nuse crate::engine::Engine;\nfn main() {}\n"), ("s", "rs/src/engine.rs", "pub struct Engine;\npub(crate) async fn f() {}\n"), ("s", "n.ts", None), ("s", None, "function f() {}"),
    ]
    f = spark.createDataFrame([*files, files[0]], FILES)
    facts = L.declarations(f).cache()
    got = {(r.path, r.fact, r.name) for r in facts.collect()}
    assert {("web/a.ts", "function", "go"), ("web/a.ts", "function", "arrow"), ("web/a.ts", "type", "K"), ("web/a.ts", "method", "run"), ("py/app/util.py", "type", "thing"), ("go/pkg/store/s.go", "function", "Get"), ("cs/A.cs", "method", "F"), ("rs/src/engine.rs", "function", "f"), ("rs/src/engine.rs", "type", "Engine")} <= got
    assert not any(n == "if" for _, _, n in got)
    edges = L.resolved_imports(facts, f)
    assert {(r.path, r.target_path) for r in edges.collect()} == {("web/a.ts", "web/lib/b/index.ts"), ("web/lib/b/index.ts", "web/a.ts"), ("py/app/main.py", "py/app/util.py"), ("go/cmd/main.go", "go/pkg/store/s.go"), ("cs/A.cs", "cs/B.cs"), ("rs/src/main.rs", "rs/src/engine.rs")}
    assert {(r.path, r.name, r.weight) for r in L.linked_names(f, facts, edges).collect()} >= {("web/a.ts", "helper", 1), ("py/app/main.py", "thing", 1), ("rs/src/main.rs", "Engine", 1)}
    assert {(r.namespace, r.name, tuple(r.paths)) for r in L.merged_types(facts).collect()} == {("Other", "A", ("cs/A.cs", "cs/A2.cs")), ("My.Space", "B", ("cs/B.cs",))}
    assert L.unique_ids(facts).filter("id = 'func:web/a.ts#go'").count() == 1 and L.declarations(f.limit(0)).count() == 0
