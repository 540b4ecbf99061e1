"""Descriptions that say something and those that do not; functions of whole and broken files; a small GLL grammar."""

import ast

import pytest

from strataq.llm import functions as FN
from strataq.llm.gll import GLL

GOOD = [
    ("load_row", "Caller closes the stream."), ("f", "返回最早的记录，忽略已删除的条目，并且保留原有顺序。"), ("trim", "TODO markers aside, this trims whitespace and rejects values longer than 9 bytes."),
    ("sort", "Gibt die 430 ältesten Einträge zurück."), ("f", "@param rows the input rows, never modified"), ("f", ":param x: seconds to wait\n:return:"), ("pub", "Slow on public disks."),
    ("f", "<summary>\nPicks the newest policy per owner.\n</summary>"), ("f", "=====\nSorts by age; ties keep their order.\n====="), ("f", "Returns null rather than throwing."), (None, "Keeps order."),
    ("f", "/** Opens the channel lazily. */"), ("getUser", "Gets the user from the cache, or from the store when it is stale."),
]
EMPTY = [
    ("sort_rows", "Sorts the rows."), ("sortRows", "This function sorts rows."), ("SortRows", "Function to sort rows."), ("copyRow", "Copies the row"), ("mapRow", "Description of mapRow."), ("mapRow", "map_row()"),
    ("f", "TODO"), ("f", "TODO: document this"), ("f", "FIXME write docs later"), ("f", "N/A"), ("f", "???"), ("f", "..."), ("f", "待补充"), ("f", "Noch zu dokumentieren."), ("f", "(no docs yet)"), ("f", "No description provided."),
    ("f", "Auto-generated method stub."), ("f", "noqa: E501"), ("f", "eslint-disable-next-line no-unused-vars"), ("f", "istanbul ignore next"), ("f", "{@inheritDoc}"), ("f", "<inheritdoc/>"), ("f", "Copyright 2019 Some Works. All rights reserved."),
    ("f", "SPDX-License-Identifier: MIT"), ("f", "Generated code, do not edit."), ("f", "-----"), ("f", "===== helpers ====="), ("f", "#region helpers"), ("f", "return limit + 1;"), ("f", "rows.filter(Boolean);"), ("f", "@param limit limit\n@returns"),
    ("f", ":param rows:\n:return:"), ("f", "@returns {any}"), ("f", "@function f"), ("f", " \n\t"), ("f", "*"),
]


@pytest.mark.parametrize("name,summary", GOOD)
def test_good(name, summary):
    assert FN.own_words(name or "", summary)


@pytest.mark.parametrize("name,summary", EMPTY)
def test_empty(name, summary):
    assert not FN.own_words(name, summary)


def test_described(spark):
    rows = [(f"g{i}", n, s) for i, (n, s) in enumerate(GOOD)] + [(f"e{i}", n, s) for i, (n, s) in enumerate(EMPTY)]
    rows += rows[:3] + [("n", "f", None), (None, "f", "Keeps its order well."), ("long", "f", "word " * 50_000)]
    rows += [(f"t{i}", "f", "Whatever.") for i in range(20)] + [(f"u{i}", "f", "Caller closes the stream.") for i in range(20)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "id string, name string, summary string, weight int")
    got = {r.node_id: r.n_same for r in FN.described(df).collect()}
    want = {f"g{i}" for i in range(len(GOOD))} | {None, "long"} | {f"u{i}" for i in range(20)}
    assert set(got) == want and got["u1"] == 21
    assert FN.described(df.limit(0)).count() == 0


def test_gll_ambiguous_and_left_recursive():
    g = GLL("e: e '+' e | ID ; s: 'a' s? | s 'b' ;")
    assert g.ends(["ID", "+", "ID", "+", "ID"], "e", 0) == {1, 3, 5}
    assert g.ends(list("aab"), "s", 0) == {1, 2, 3} and g.ends(list("b"), "s", 0) == set()


PY = "import x\n\n@deco\ndef a(p, q=(1, 2)) -> int:\n    '''d'''\n    def inner(): return 1\n    return {1: [2]}\n\nclass K:\n    async def m(self):\n        pass\n\n    def n(self): pass\n\nasync def last():\n    x = f'{a(1)}'\n"


def test_python_functions():
    want = sorted((n.name, n.lineno, n.end_lineno) for n in ast.walk(ast.parse(PY)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)))
    assert sorted(FN.functions_in(PY, "python")) == want
    broken = PY.replace("return {1: [2]}", "return {1: [2}")
    assert {n for n, _, _ in FN.functions_in(broken, "python")} >= {"inner"} and "a" not in {n for n, _, _ in FN.functions_in(broken, "python")}


OTHER = {
    "javascript": ("async function a(x, { y }) {\n  if (x) { call(y); }\n}\nclass K {\n  static async m(a) {\n    for (const b of a) { b(); }\n  }\n  get z() { return 1; }\n}\n", {("a", 1, 3), ("m", 5, 7), ("z", 8, 8)}),
    "typescript": ("export function a<T>(x: T[] | any): Map<string, { y: T }> {\n  return x;\n}\nclass K {\n  private m(a: string): void {\n  }\n}\n", {("a", 1, 3), ("m", 5, 6)}),
    "go": ("package p\n\nfunc (t *T) m(a string, b ...int) (n int, err error) {\n\tif a == \"}\" {\n\t}\n}\n\nfunc f() error {\n\treturn nil\n}\n", {("m", 3, 6), ("f", 8, 10)}),
    "csharp": ("namespace N;\npublic class C\n{\n    public C(int a) : base(a)\n    {\n    }\n    public static Task<List<int>> F<T>(T x)\n    {\n        if (x) { return null; }\n    }\n    int G() => 3;\n}\n", {("C", 4, 6), ("F", 7, 10), ("G", 11, 11)}),
    "rust": ("impl<'a> S<'a> {\n    pub fn m<'b>(&'b self, x: Vec<u8>) -> Result<&'b str, E> where E: D {\n        match x { _ => {} }\n    }\n}\nfn f() {}\n", {("m", 2, 4), ("f", 6, 6)}),
}


@pytest.mark.parametrize("language", OTHER)
def test_other_functions(language):
    text, want = OTHER[language]
    assert set(FN.functions_in(text, language)) == want
    cut = text.rstrip()[:-1]  # the last bracket is missing: the functions before it are still found
    assert {x for x in want if x[2] < max(e for _, _, e in want)} <= set(FN.functions_in(cut, language))


FUNCTIONS = "id string, scope_id string, name string, path string, language string, start_line int, summary string"
FILES = "scope_id string, path string, content string, language string, run_at int, loaded_at int, name string"


def test_pairs(spark):
    f = spark.createDataFrame(
        [("a", "s", "a", "p.py", "Python", 4, "Adds both halves up."), ("a", "s", "a", "p.py", "Python", 4, "Adds both halves up."), ("m", "s", "m", "p.py", None, 10, "Waits for the lock."), ("x", "s", "x", "gone.py", None, 1, "Waits for it."),
         ("y", "s", "y", "p.py", None, 500, "Lies outside."), ("z", "s", "z", None, None, None, "Has no file."), ("w", "s", "w", "p.py", None, None, "Has no line."), ("o", "other", "a", "p.py", None, 4, "Is in a file of its own scope."),
         ("t", "s", "inner", "p.py", None, 6, "TODO"), ("n", None, "a", "p.py", None, 4, "Belongs to no scope.")],
        FUNCTIONS,
    )
    old = PY.replace("return {1: [2]}", "return None")
    e = spark.createDataFrame(
        [("s", "p.py", old, "python", 1, 9, "k"), ("s", "p.py", PY, "python", 2, 1, "k"), ("s", "p.py", PY, "python", 2, 1, "k"), ("s", "q.py", None, "python", 1, 1, "k"), ("s", None, "x", "python", 1, 1, "k"), (None, "p.py", old, "python", 1, 1, "k")], FILES
    )
    got = {r.node_id: r for r in FN.pairs(f, e).collect()}
    assert set(got) == {"a", "m", "n"} and got["a"].whole and got["a"].code == "\n".join(PY.split("\n")[3:7]) and got["a"].doc == "d" and got["n"].code != got["a"].code
    assert FN.pairs(f, e.limit(0)).count() == 0 and FN.pairs(f.limit(0), e).count() == 0
    files = spark.createDataFrame([(1, PY, "python"), (1, PY, "python"), (2, None, "go"), (None, "fn f() {}", "rust"), (3, "x", None)], "extract_id bigint, content string, language string")
    assert FN.whole_functions(files).count() == 6


def test_pairs_in_broken_files(spark):
    text = "func f(a int) int {\n\treturn a\n}\n\nfunc g(b int) int {\n\treturn (b\n"
    f = spark.createDataFrame([("f", "s", "f", "p.go", None, 1, "Keeps what it gets."), ("g", "s", "g", "p.go", None, 5, "Loses what it gets.")], FUNCTIONS)
    got = {r.node_id: r.whole for r in FN.pairs(f, spark.createDataFrame([("s", "p.go", text, "go", 1, 1, "k")], FILES)).collect()}
    assert got == {"f": True, "g": False}


@pytest.mark.parametrize(
    "language,inside,want",
    [("python", "self, a, b: dict[str, int] = {}, *c, **d", ("a", "b", "c", "d")), ("typescript", "rows: Map<string, any>, { x }, y = 3", ("rows", "x", "y")), ("go", "a string, b ...int", ("a", "b")), ("csharp", "List<int> a, ref string b = \"\"", ("a", "b")), ("rust", "&self, mut a: Vec<u8>", ("a",)), ("go", "", ())],
)
def test_params(language, inside, want):
    assert FN._params(inside, language) == want


def test_templates_are_dropped_by_their_counts(spark):
    rows = [(f"n{i}", f"pack{w}", s.format(w)) for i, w in enumerate(("Row", "Lane", "Gate", "Node")) for s in ("Zurra {0}.", "Caller closes the stream.")]
    rows = [(f"{i}{n}", name, s) for i, (n, name, s) in enumerate(rows)] + [("one", "load", "Zurra load it lazily, later than others.")]
    f = spark.createDataFrame(rows, "id string, name string, summary string")
    assert {r.text: r.dropped for r in FN.templates(FN.judged(f)).collect()} == {"zurra <name>": True, "caller closes the stream": False, "zurra <name> it lazily later than others": False}
    assert {r.node_id for r in FN.described(f).collect()} == {k for k, _, s in rows if not s.startswith("Zurra") or k == "one"}


def test_p5_found_comes_from_the_parser(spark, monkeypatch):
    from strataq.llm import queries_functions as Q

    f = spark.createDataFrame(
        [("a", "function", "s", "a", "p.py", "Python", 4, "Adds both halves up.", "docs"), ("file", "file", "s", "p.py", "p.py", "Python", None, None, None)],
        "id string, kind string, scope_id string, name string, path string, language string, start_line int, summary string, summary_source string",
    )
    e = spark.createDataFrame([("file", "p.py", PY, "s", 1, 1)], "file_id string, path string, content string, scope_id string, run_at int, loaded_at int")
    monkeypatch.setattr(Q, "table", lambda s, d, name, *columns: {"nodes": f, "extracts": e}[name].select(*columns))
    assert {r.node_id for r in Q.p5_found(spark, "").collect()} == {"a"}
    monkeypatch.setattr(GLL, "islands", lambda *a: [])
    assert [f for f in FN.functions_of(PY, "python")] == []


@pytest.mark.parametrize("copies", [1, 19, 20, 60])
def test_verdict_is_alike_at_every_size(spark, copies):
    rows = [(f"{s}{i}", "f", s) for s in ("Whatever.", "Idempotent.") for i in range(copies)]
    got = FN.described(spark.createDataFrame(rows, "id string, name string, summary string")).collect()
    assert {r.node_id for r in got} == {f"Idempotent.{i}" for i in range(copies)} and {r.n_same for r in got} == {copies}
