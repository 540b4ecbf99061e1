"""Valid and broken files of each language; for Python every cut and every dropped token against the compiler."""

import ast
import random
import re

import pytest

from strataq.llm import syntax
from strataq.llm.derivatives import Grammar
from strataq.llm.grammars import grammar
from strataq.llm.lexers import tokens

VALID = {
    "python": [
        "", "# only\n", "﻿import os\r\nx = 1\r\n",
        "import a.b as c\nfrom . import (x, y as z,)\n@deco(1)\nasync def f(a, /, b: int = 1, *c, d=2, **e) -> list[int]:\n    '''doc'''\n    async with g() as h, i: pass\n"
        "    return [x async for x in y if x] or {**e, 'k': v} or {1, *s}\n\nclass K(B, metaclass=M):\n    x: int = 3; y = z = 4\n    def m(self):\n        try:\n            raise E from None\n"
        "        except* (A, B) as err:\n            del a, b\n        finally:\n            yield from q\n\nmatch cmd:\n    case [1, *rest] if rest: pass\n    case K(x=1) | None: pass\n"
        "    case _: pass\nprint(f'{x!r:>{w}} {{}} {d[\"k\"]}', *a, sep='')\nlam = lambda x, *y: (yield)\nif (n := 3) > 2 if a else b: pass\nelse:\n    x[1:2, ::3] += 1\nwhile True:\n  break\n",
    ],
    "javascript": [
        "", "// only", "const { a, b: [c = 1], ...d } = require('x');\nlet r = a / b / 2, q = /[/{]\\//g.test(x)\nlabel: for (const [k, v] of Object.entries(o)) { if (k) continue label; else break }\n"
        "async function* g(x = 1, { y }, ...z) { yield* h(); await x?.y?.[1]?.(2) }\nclass A extends B { static #p = 1; get x() { return this.#p } async *m() {} static { init() } }\n"
        "export default class { }\nexport const f = async (a, b) => ({ a, [b]: `t ${a + `${b}`} u` });\nswitch (x) { case 1: case 2: y++; default: z() }\ndo x--\nwhile (x)\nvar t = x ? y : z, u = function () {}, w = typeof t === 'a' && !(b in c)\n",
    ],
    "typescript": [
        "import type { A } from './a';\nexport interface I<T extends object = {}> extends J { readonly a?: string; m(x: number): void; [k: string]: any }\ntype U<T> = T extends (infer R)[] ? R : 'a' | 1 | { [K in keyof T]?: T[K] };\n"
        "export abstract class C<T> extends D<T> implements I<T> { constructor(private readonly x: Map<string, Array<T>>, y?: number) { super(); } public static async f<T>(this: Window, a: T = b as T): Promise<T | null> { return a!; } declare z: string; }\n"
        "enum E { A = 1, B }\ndeclare function g(x: string): x is 'a';\nconst h = <T,>(x: T): x is NonNullable<T> => x != null;\nnamespace N.M { export let q: typeof h = h satisfies F; }\nlet t: [a: string, b?: number, ...c: boolean[]] = f<number>(1) as const;\n",
    ],
    "go": [
        "package a\n\nimport (\n\t\"fmt\"\n\tm \"math\"\n)\n\ntype T[K comparable, V any] struct {\n\ta, b int `json:\"a\"`\n\t*E\n\tf func(x int, y ...string) (n int, err error)\n}\n\nfunc (t *T[K, V]) M(a, b int) (c chan<- int) {\n\tfor i := range 10 {\n\t\tgo func() { c <- i }()\n\t}\n"
        "\tif x, ok := t.m[1]; !ok && (T{}) != y {\n\t\tdefer f(a...)\n\t} else if v := p.(type1); v {\n\t}\n\tswitch y := x.(type) {\n\tcase int, []string:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\t\t_ = v\n\tdefault:\n\t}\n\tm := map[string][]int{\"a\": {1, 2}, \"b\": nil}\n\treturn &T[int, string]{a: 1}.c\n}\n",
    ],
    "csharp": [
        "using System;\nusing static A.B;\nusing X = A.B<int>;\n\nnamespace N.M;\n\n[Serializable, Obsolete(\"x\")]\npublic sealed partial class C<T> : B<T>, I where T : class, new()\n{\n    private readonly Dictionary<string, List<int[]>> d = new();\n    public int P { get; private set; } = 3;\n    public int Q => d.Count;\n"
        "    public C(int a, params string[] b) : base(a) { }\n    public async Task<int> F<U>(ref int x, out string y, U? z = default) where U : struct\n    {\n        var q = $\"{x,5:N2} {(y ?? \"n\")} {{}}\" + @\"c:\\\" + $@\"{x}\";\n        if (o is string { Length: > 3 } s && !(o is null or int)) return await G(x: 1, out var k);\n        foreach (var (a, b) in d) { yield return a; }\n"
        "        var t = x switch { 1 => \"a\", > 2 and < 5 => \"b\", _ => throw new E() };\n        try { lock (this) { i++; } } catch (E e) when (e.X) { throw; } finally { }\n        using var f = new S { A = 1, [\"b\"] = { 2 } };\n        int[] n = { 1, 2 }; Func<int, int> g = static (int v) => v * (int)2.0f; x = y ? a[^1] : b[1..];\n        return (1, c: 2).c;\n    }\n    public static C<T> operator +(C<T> a, C<T> b) => a;\n    enum E : byte { A = 1, B }\n}\nrecord R(int X, string Y = \"\");\n",
    ],
    "rust": [
        "#![allow(x)]\nuse std::{fs::{self, File}, io::*};\npub(crate) struct S<'a, T: ?Sized + 'a>(pub &'a T, [u8; 4]) where T: Clone;\nimpl<'a, T> Tr<T> for S<'a, T> where T: Fn(i32) -> bool {\n    const N: usize = 1 << 3;\n    async fn f(&mut self, (a, b): (i32, &str)) -> Result<Vec<Vec<u8>>, Box<dyn Error + 'a>> {\n"
        "        let x = if let Some(y) = a.get(0)? { y } else { return Err(e.into()) };\n        match x { 1..=5 | 7 if b => {} S { a, ref b, .. } => (), _ => panic!(\"{}\", x), }\n        'outer: loop { while let Some(_) = it.next() { break 'outer; } }\n        let v: Vec<_> = (0..n).map(|&i| i as u64 * 2).collect::<Vec<_>>();\n        for (i, c) in s.chars().enumerate() { if c == '\\'' && i < v.len() { continue; } }\n        Ok(unsafe { *p }..=3)\n    }\n}\nmacro_rules! m { ($x:expr) => { $x + 1 }; }\nenum E { A, B(i32), C { x: r#type } }\ntrait Q: A + B { type T; fn g() -> impl Iterator<Item = u8>; }\nstatic mut Z: &str = r#\"a \"b\" {\"#; /* a /* b */ c */\n".replace("r#type", "u8"),
    ],
}
BROKEN = {
    "javascript": ["f(5));", "{\n  \"a\": 1,\n  \"b\": [true]\n}\n", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n", "let x = `a ${b`;", "call(\"abc, 1);\n", "var a = 1 b = 2;", "/* open", "package a\n"],
    "go": ["", "package", "package a\nfunc f() {\n\tcall([1, 2\n", "package a\nx := 1\n", "import json\n", "package a\nfunc f() {\n\tif x == T{} {\n\t}\n}\n"],
    "csharp": ["class A {", "call({ 6 );", "# Title\n\nSome words here.\n", "public class A { void F() { var a = $\"{b\"; } }"],
    "rust": ["fn f() { call((1 + 2); }", "fn f() {", "{\"a\": 1}", "import json\n", "fn f() { let x = 'ab'; }"],
    "typescript": ["export function f(a: string[] | any): any {\n", "+++ b/x\n@@ -1,3 +1,4 @@\n", "class A { m( { }", "let x: = 3;"],
}


@pytest.mark.parametrize("language", VALID)
def test_valid(language):
    for text in VALID[language]:
        assert grammar(language).check([(t.kind, t.new_line) for t in tokens(text, language)], ";" if "script" in language else None) is None, syntax.fault(text, language)
        assert syntax.fault(text.replace("\r", "").replace("\n", "\r\n"), language) is None


@pytest.mark.parametrize("language", BROKEN)
def test_broken(language):
    for text in BROKEN[language]:
        assert syntax.fault(text, language), text


def test_python_against_compiler():
    rnd = random.Random(5)
    text = VALID["python"][3]
    words = re.findall(r"\w+|\s+|[^\w\s]", text)
    for _ in range(600):
        w = list(words)
        at = rnd.randrange(len(w))
        op = rnd.randrange(3)
        if op == 0:
            w = w[:at]
        elif op == 1:
            del w[at]
        else:
            w.insert(at, rnd.choice(["(", ")", "]", ":", "= =", "if", "\n", "'"]))
        s = "".join(w)
        try:
            ast.parse(s)
            good = True
        except SyntaxError:
            good = False
        if good:
            assert syntax.fault(s, "python") is None, s


def test_truncated():
    assert syntax.fault("function f() {\n  g(1, ", "javascript") == ("truncated", 2, "")
    assert syntax.fault("a b\n", "javascript") == ("token", 1, "b")


def test_deep():
    assert syntax.fault("(" * 1500 + "a" + ")" * 1500, "javascript") is None
    assert syntax.fault("(" * 1500 + "a" + ")" * 1499, "javascript") == ("truncated", 1, "")


def test_nullable_and_forgetting():
    g = Grammar("s: 'a' s 'b' | x* ; x: 'c'? ;", "s", limit=3)
    for word, good in (("", True), ("aabb", True), ("aacccbb", True), ("aab", False), ("abb", False)):
        assert (g.check([(c, False) for c in word]) is None) == good


def test_operator(spark):
    rows = [(1, "f1", "s", "a.py", "x = 1"), (2, "f2", "s", "a.py", "x = = 1"), (2, "f2", "s", "a.py", "x = = 1"), (3, "f3", "s", "b.js", ""), (4, "f4", None, "c.go", ""), (5, "f5", "s", "z.rs", "x ="),
            (6, "f6", "s", "d.py", None), (None, None, "s", "e.rs", "fn"), (7, "f1", "s", "x.unknown", "x y"), (8, "f8", "s", "y.py", "(" * 150 + ")" * 150 + "\n" + "x = [1, 2]\n" * 20_000)]
    files = spark.createDataFrame(rows, "extract_id bigint, file_id string, scope_id string, path string, content string")
    nodes = spark.createDataFrame([("f1", "file", " PYTHON ", 1), ("f1", "file", " PYTHON ", 1), ("f5", "file", None, 1), ("f2", "type", "go", 1), (None, "file", "go", 1)], "id string, kind string, language string, content int")
    known = syntax.with_language(files, nodes)
    got = {(r.extract_id, r.kind) for r in syntax.faults(known).collect()}
    assert {(2, "token"), (4, "truncated"), (None, "truncated"), (7, "token")} <= got and {k for k, _ in got} == {2, 4, None, 5, 7}
    rates = {(r.scope_id, r.language): (r.n_files, r.n_invalid) for r in syntax.rates(known.filter("extract_id < 8")).collect()}
    assert rates[("s", "python")] == (3, 2) and rates[(None, "go")] == (1, 1)
    assert syntax.faults(known.limit(0)).count() == 0


MARKUP = [
    "const a = <div>text</div>;", "const a = <div />;", "export default () => <A.B x='1' y={2 + f(3)} {...rest} flag>{items.map((i) => <li key={i}>{i}</li>)}</A.B>;", "function F() { return (<><p>a {/* c */} {b && <i/>}</p></>); }",
    "const x = a < b && c > d;", "const t = ok ? <A /> : <B>{}</B>;",
]
BROKEN_MARKUP = ["const a = <div>text</span>;", "const a = <div>;", "const a = <div x=1 />;", "const a = <div>{f(}</div>;", "const a = <div>}</div>;", "const a = <div"]


@pytest.mark.parametrize("language", ["jsx", "tsx"])
def test_markup(language):
    from strataq.llm import syntax as S

    assert [S.fault(t, language) for t in MARKUP] == [None] * len(MARKUP)
    assert all(S.fault(t, language) for t in BROKEN_MARKUP)
    assert S.fault("const a = <div>text</div>;", language[0] + "s" if language == "ts" else "javascript")


def test_extensions_of_markup(spark):
    from strataq.llm import syntax as S
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(None, "a.tsx"), ("JSX", "a.js"), (None, "b.JSX"), ("TypeScript", "a.tsx")], "n string, p string")
    assert [r[0] for r in d.select(S.language_of(F.col("n"), F.col("p"))).collect()] == ["tsx", "jsx", "jsx", "typescript"]
