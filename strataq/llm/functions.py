"""Functions of source files paired with their documentation.

Files are parsed by the island grammars (generalised LL), also where they are broken; the functions found there are the
rows, with name, lines, parameters, code and the comment that stands with them. Descriptions are turned into templates:
the function's own name and its parameters become slots. A template of few words that is repeated across the corpus under
many names says nothing and is dropped by the count of its hash; what no count can show (notices, directives, a
restated name that stands once) is judged by its words.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.gll import GLL
from strataq.llm.lexers import DIALECTS, Token, tokens
from strataq.llm.syntax import language_of
from strataq.operators.scale import cut, sized_join

#: A template is dropped if it has at most TEMPLATE_WORDS words beside its slots and more than one in TEMPLATE_SHARE of
#: all functions have it, under TEMPLATE_NAMES names or more. A share, so the verdict is alike at every size; it also means
#: that fewer than TEMPLATE_SHARE templates can be dropped, whatever the data.
TEMPLATE_WORDS, TEMPLATE_SHARE, TEMPLATE_NAMES = 2, 500, 3

# What fills descriptions, and what stands in for them.
_FILL = frozenset(
    "a an the this that it its is to of for in on and by with function functions method methods description describes summary documentation does name called"
    " returns return param params parameter parameters argument value result object data type".split()
)
_PLACEHOLDER = frozenset(
    "todo fixme xxx hack tbd tba wip n/a na none null nil undefined placeholder stub missing pending later soon here now yet no not provided available documented undocumented document documenting"
    " documentation docs doc describe description add write fill insert needs need me please generated auto automatically autogenerated method function comment comments text lorem ipsum"
    " noch zu dokumentieren dokumentation fehlt folgt à documenter compléter por documentar pendiente sin descripción описание отсутствует документировать the this a of in to be is it be".split()
)
#: Words that say nothing where a description has no other of its own.
_VAGUE = frozenset("whatever something anything everything nothing stuff thing things misc miscellaneous various etc obvious above below same ditto foo bar baz blah ok yes utils helpers".split())
_PLACEHOLDER_HAN = re.compile(r"(?:待补充|待完善|待定|待办|暂无(?:说明|描述|文档)?|无|未完成|未記入|後で書く|説明なし|추후 작성|설명 없음)[。.!！]?")
_TYPES = frozenset("any string str number int integer float bool boolean object void null none undefined list dict map array tuple set unknown never error func promise t".split())
_LINE_NOISE = re.compile(
    r"""^(?:
      (?:eslint|tslint|jshint|jslint|prettier|biome|stylelint|istanbul|c8|v8)\b.* | @?ts-(?:ignore|expect-error|nocheck|check)\b.* | noqa\b.* | (?:pylint|mypy|pyright|flake8|ruff|isort|yapf|fmt)\s*:.* | type:\s*ignore.*
    | pragma\b.* | nolint\b.* | nosec\b.* | go:\w+.* | \+build\b.* | sonar\w*.* | resharper\b.* | clippy::.* | rustfmt::.* | coverage:\s*ignore.* | webpackChunkName.* | region\b.*
    | (?:copyright|©|\(c\)\s*\d{4}|licen[sc]ed?\b|spdx-|all\s+rights\s+reserved).* | .*\ball\s+rights\s+reserved\.?\s* | (?:this\s+(?:file|code)\s+(?:is|was)\s+)?(?:auto-?)?generated\s+(?:code|file|by|from)\b.* | do\s+not\s+edit.*
    | \#\s*(?:end)?region\b.* | .*\bauto-?generated\b.*(?:do\s+not|stub).* | auto-?generated\s+\w+\s+stub\.?
    | \{?@inheritdoc\}?.* | <inheritdoc\b.*
    | [\W_]*[=\-~*\#_]{3,}\s*[\w ]{0,40}\s*[=\-~*\#_]{3,}[\W_]* | [\W_]+
    )$""",
    re.IGNORECASE | re.VERBOSE,
)
_CODE = re.compile(
    r"^(?:return\b\s*[\w.\[\]()'\" ]*(?:[-+*/%&|<>=!]+\s*[\w.\[\]()'\"]+)*;?|(?:if|for|while|switch)\s*\(.*|(?:let|var|const|import|from|using|use)\s+[\w.{}, *]+(?:[=;(].*|\sfrom\s.*)|[\w.\[\]]+\s*(?:[-+*/]?=|:=)\s*\S.*|[\w.]+\([^)]*\)\s*[;{]?|[{}\[\]();]+|.*[;{]\s*$)$"
)
_TAG = re.compile(r"^(?:@|:|\\)(\w+)(?:\s*\{[^}]*\})?\s*:?\s*(.*)$", re.DOTALL)
_NAMED = frozenset("param parameter arg argument property prop throws raises exception typeparam tparam key var ivar cvar keyword".split())
_WITHOUT_NAME = frozenset("return returns yields yield rtype type summary remarks deprecated since see".split())
_SELF = frozenset("function method func name class alias member memberof module namespace file author version private public protected internal override async static constructor".split())
_MARKUP = re.compile(r"</?(?:summary|remarks|para|returns|param|c|code|see|value|example|typeparam|exception)\b[^>]*>")
_WORD = re.compile(r"[぀-ヿ㐀-鿿]+|[가-힯]+|[฀-๿]+|[^\W_]+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+|\d+")


def _name_words(name: str) -> frozenset[str]:
    """The words of a name with their usual inflections."""
    out = set()
    for w in _PARTS.findall(name):
        w = w.lower()
        out |= {w, w + "s", w + "es", w + "ed", w + "d", w + "ing", w[:-1] + "ing", w[:-1] + "ies", w + w[-1] + "ed", w + w[-1] + "ing", w[:-1] + "ied"}
        if w.endswith("s"):
            out.add(w[:-1])
    out.add(name.lower().replace("_", ""))
    return frozenset(out)


def own_words(name: str, summary: str) -> list[str]:
    """The words of a description that say something: not the function's name, fillers, placeholders, directives,
    notices, rulers, code or bare parameters."""
    known = _name_words(name)
    out: list[str] = []
    for line in _MARKUP.sub(" ", summary).replace("\r", "\n").split("\n"):
        line = re.sub(r"^\s*(?:/\*\*?|\*/|\*(?!\*)|///?!?|#(?!region|endregion)|--|;;|\"\"\")\s?", "", line).strip().removesuffix("*/").strip()
        if not line or _LINE_NOISE.match(line) or _CODE.match(line) or _PLACEHOLDER_HAN.fullmatch(line):
            continue
        skip: frozenset[str] = frozenset()
        if m := _TAG.match(line):
            tag, rest = m[1].lower(), m[2]
            if tag in _SELF:
                continue
            if tag in _NAMED:
                # ":param x: text" and "@param x text"; what repeats the parameter's name or type explains nothing
                p = re.match(r"\[?([\w.$]+)[^\s:]*\]?\s*:?\s*-?\s*", rest)
                if p:
                    skip = _name_words(p[1])
                    rest = rest[p.end() :]
                rest = re.sub(r"^\([^)]*\)\s*", "", rest)
            skip = skip | _TYPES
            line = rest
        words = [w.lower() for w in _WORD.findall(line)]
        plain = line.strip().lower().strip(".!…:()[] ")
        if plain in _PLACEHOLDER or (words and all(w in _PLACEHOLDER or w in _FILL for w in words) and any(w in _PLACEHOLDER and w not in _FILL for w in words)):
            continue
        out += [w for w in words if w not in known and w not in _FILL and w not in skip and not w.isdigit()]
    return [] if len(out) == 1 and out[0] in _VAGUE else out


# Words that do not count as words of a template.
_FRAME = frozenset("a an and of or the this to".split())
_NAME_SLOT, _PARAMETER_SLOT, _NUMBER_SLOT = "<name>", "<parameter>", "<number>"


def template_of(name: str, params: list[str], summary: str) -> tuple[str, int]:
    """The description with slots for the function's own name, its parameters and numbers, and the words beside them.

    Slots of a kind that follow each other become one. A run of a script without spaces counts a word per two characters.
    """
    known = _name_words(name)
    own = {p.lower() for p in params}
    out: list[str] = []
    for w in _WORD.findall(_MARKUP.sub(" ", summary)):
        w = w.lower()
        w = _NUMBER_SLOT if w.isdigit() else _PARAMETER_SLOT if w in own else _NAME_SLOT if w in known else w
        if not (out and w == out[-1] and w in (_NAME_SLOT, _PARAMETER_SLOT)):
            out.append(w)
    said = [w for w in out if w not in _FRAME and w not in (_NAME_SLOT, _PARAMETER_SLOT, _NUMBER_SLOT)]
    return " ".join(out), sum(1 if w.isascii() or _PARTS.fullmatch(w) else max(1, len(w) // 2) for w in said)


def judged(functions: DataFrame) -> DataFrame:
    """node_id, name, text, template, words, own: the functions (id, name, summary and, if there, params) with their templates.

    ``template`` is a 64-bit hash, ``text`` the template in short, ``own`` tells whether the words alone say something.
    Null and blank descriptions say nothing and are left out; a null name restates nothing. Repeated rows of a function
    count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows = []
            for key, name, params, summary in zip(*(c.to_pylist() for c in b.columns)):
                text, words = template_of(name or "", params or [], summary)
                rows.append((key, name, text[:80], xxhash.xxh64_intdigest(text) - (1 << 63), words, bool(own_words(name or "", summary))))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["node_id", "name", "text", "template", "words", "own"])

    params = F.col("params") if "params" in functions.columns else F.lit(None).cast("array<string>").alias("params")
    speaking = functions.select(F.col("id").cast("string").alias("id"), "name", params, "summary").filter(F.length(F.trim("summary")) > 0)
    return speaking.mapInArrow(run, "node_id string, name string, text string, template bigint, words int, own boolean").dropDuplicates(["node_id"])


def templates(rows: DataFrame) -> DataFrame:
    """template, text, words, n_same, n_names, dropped: the templates of ``judged`` rows, counted over all functions.

    Counts combine in each task before the shuffle, so a template of a third of all rows is no burden.
    """
    per_name = rows.groupBy("template", "name").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text"), F.min("words").alias("words"))
    per = per_name.groupBy("template").agg(F.min("text").alias("text"), F.min("words").alias("words"), F.sum("n").alias("n_same"), F.count(F.lit(1)).alias("n_names"))
    total = rows.agg(F.count(F.lit(1)).alias("__all"))  # one row
    boilerplate = (F.col("words") <= TEMPLATE_WORDS) & (F.col("n_same") * TEMPLATE_SHARE > F.col("__all")) & (F.col("n_names") >= TEMPLATE_NAMES)
    return per.crossJoin(F.broadcast(total)).withColumn("dropped", boilerplate).drop("__all")


def described(functions: DataFrame) -> DataFrame:
    """node_id, template, n_same: the functions (id, name, summary and, if there, params) whose description says something.

    Dropped are descriptions whose template is repeated across the corpus (see ``templates``) and those without a word of
    their own. ``n_same`` is the number of functions that share the template. Null and blank descriptions say nothing; a
    null name restates nothing. Repeated rows of a function count once.
    """
    rows = cut(judged(functions))
    counted = cut(templates(rows).filter(F.col("dropped") | (F.col("n_same") > 1)))
    dropped = counted.filter("dropped").select("template")
    left = rows.filter("own").join(F.broadcast(dropped), "template", "left_anti")  # fewer than TEMPLATE_SHARE rows
    return (
        sized_join(left, counted.filter("not dropped").select("template", "n_same"), "template", "left")
        .withColumn("n_same", F.coalesce("n_same", F.lit(1)))
        .select("node_id", "template", "n_same")
    )


# Grammars of function headers over tokens in which each balanced pair of brackets has become one token.
_NEVER = frozenset(("{}", ";", "NEWLINE", "SUITE", "BAD", "ERR"))
_GRAMMARS = {
    "python": "function: 'async'? 'def' ID '[]'? '()' ('->' ANY+)? ':' ('NEWLINE' 'SUITE' | ANY+ (';' ANY*)* 'NEWLINE') ;",
    "javascript": "function: 'async'? ('function' '*'? ID? | modifier* '*'? name) '()' body ; name: ID | '[]' | 'get' | 'set' | 'static' | 'async' | 'from' | 'of' ; modifier: 'static' | 'async' | 'get' | 'set' ; body: '{}' ;",
    "typescript": "function: 'export'? 'default'? 'async'? ('function' '*'? ID? | modifier* '*'? name) generics? '()' (':' result)? '{}' ; name: ID | '[]' | 'get' | 'set' | 'type' | 'from' | 'of' ;"
    " modifier: 'static' | 'async' | 'get' | 'set' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' ; generics: '<' ANY* '>' ;"
    " result: ('|' | '&')? part (('|' | '&') part)* ; part: ('readonly' | 'keyof' | 'typeof' | 'asserts' | ID 'is' | 'this' 'is')* atom '[]'* ; atom: ID ('.' ID)* types? | 'void' | 'null' | 'this' | 'true' | 'false' | STR | NUM | '{}' | '[]' | '()' ('=>' result)? ;"
    " types: '<' result (',' result)* '>' ;",
    "go": "function: 'func' '()'? ID '[]'? '()' result? '{}' ; result: ANY+ ('{}' ANY*)* ;",
    "csharp": "function: '[]'* modifier* type ID generics? '()' where* ('{}' | '=>' ANY+ ';') | modifier+ ID '()' (':' ANY '()')? '{}' ; where: ANY+ ; generics: '<' ANY* '>' ; type: (ID | PREDEFINED | '.' | '<' | '>' | ',' | '?' | '[]' | '()')+ ;"
    " modifier: 'public' | 'private' | 'protected' | 'internal' | 'static' | 'abstract' | 'sealed' | 'virtual' | 'override' | 'extern' | 'unsafe' | 'new' | ID ;",
    "rust": "function: ('pub' '()'?)? ('const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' ID generics? '()' ('->' ANY+)? ('where' ANY+)? '{}' ; generics: '<' ANY* '>' ;",
}
_PREDEFINED = frozenset("bool byte char decimal double float int long object sbyte short string uint ulong ushort void".split())
_NOT_NAMES = frozenset("if for while switch catch return with else do try lock using fixed foreach".split())
_CLOSE = {"(": ")", "[": "]", "{": "}", "INDENT": "DEDENT", "SB": "SE", "${": "}$"}
_OPEN = {v: k for k, v in _CLOSE.items()}


@cache
def _grammar(language: str, damaged: bool = False) -> GLL:
    """The grammar of whole functions, or of those whose header stands before a body with unbalanced brackets."""
    text = _GRAMMARS[language].replace("PREDEFINED", "'PREDEFINED'")
    return GLL(text.replace("'{}'", "'BAD'").replace("'SUITE'", "'BAD'") if damaged else text, _NEVER)


def _groups(found: list[Token]) -> tuple[list[list[Token]], list[Token]]:
    """Token lists, one for each bracket pair's inside and one for the outside, with each balanced pair as one token.

    A pair that holds an unbalanced bracket or an error becomes BAD: nothing that needs it matches. Closers close the
    nearest pair they fit, so what follows the damage is grouped again as it stands.
    """
    done: list[list[Token]] = []
    stack: list[tuple[Token | None, list[Token], bool]] = [(None, [], False)]

    def close(end: Token | None, bad: bool) -> None:
        opener, inside, broken = stack.pop()
        bad = bad or broken
        done.append(inside)
        outer, out, outer_broken = stack[-1]
        kind = {"INDENT": "SUITE", "SB": "STR", "${": "HOLE"}.get(opener.kind, opener.kind + _CLOSE.get(opener.kind, ""))
        out.append(Token("BAD" if bad else kind, opener.start, end.end if end else (inside[-1].end if inside else opener.end), opener.new_line))
        if bad:
            stack[-1] = (outer, out, True)

    for t in found:
        if t.kind in _CLOSE:
            stack.append((t, [], False))
        elif t.kind in _OPEN:
            depth = next((i for i in range(len(stack) - 1, max(0, len(stack) - 60), -1) if stack[i][0] is not None and stack[i][0].kind == _OPEN[t.kind]), 0)
            if not depth:
                stack[-1] = (stack[-1][0], stack[-1][1], True)
                continue
            while len(stack) - 1 > depth:
                close(None, True)
            close(t, False)
        else:
            if t.kind == "ERR":
                stack[-1] = (stack[-1][0], stack[-1][1], True)
            stack[-1][1].append(t)
    while len(stack) > 1:
        close(None, True)
    return done, stack[0][1]


class Function(NamedTuple):
    """A function of a file: lines count from 1; ``doc`` is the comment or docstring that stands with it, as written."""

    name: str
    first: int
    last: int
    params: tuple[str, ...]
    doc: str | None
    whole: bool = True


_PARAM_END = re.compile(r"[:=?]")


def _params(inside: str, language: str) -> tuple[str, ...]:
    """The names of the parameters of a list without its brackets."""
    out, depth, part = [], 0, ""
    for c in inside + ",":
        depth += (c in "([{<") - (c in ")]}>" and not part.endswith(("=", "-")))
        if c == "," and depth <= 0:
            words = re.findall(r"[^\W\d]\w*", part.split("=")[0] if language == "csharp" else _PARAM_END.split(part)[0])
            words = [w for w in words if w not in ("mut", "self", "cls", "this", "ref", "out", "in", "params")]
            if words:
                out.append(words[-1] if language in ("csharp", "rust") else words[0])
            part = ""
        else:
            part += c
    return tuple(out)


def _comment_above(lines: list[str], first: int) -> str | None:
    """The comment that ends on the line above ``first`` (from 1), attributes between left out."""
    at = first - 2
    while at >= 0 and re.match(r"\s*(?:#\[|@\w|\[\w)", lines[at]):
        at -= 1
    end = at + 1
    if at >= 0 and lines[at].rstrip().endswith("*/"):
        while at >= 0 and "/*" not in lines[at]:
            at -= 1
        return "\n".join(lines[at:end]) if at >= 0 else None
    while at >= 0 and lines[at].lstrip().startswith("//"):
        at -= 1
    return "\n".join(lines[at + 1 : end]) or None


_DOCSTRING = re.compile(r"\s*[rRuU]{0,2}(\"\"\"|'''|\"|')([\s\S]*?)\1")


def functions_of(content: str, language: str, damaged: bool = False) -> list[Function]:
    """The functions that are whole, also in a file that does not parse; with ``damaged`` also those with a broken body."""
    found_tokens = tokens(content, language) if DIALECTS.get(language, language) in _GRAMMARS else []
    language = DIALECTS.get(language, language)
    if not found_tokens:
        return []
    inner, outer = _groups(found_tokens)
    starts_of = [0]
    for m in re.finditer("\n", content):
        starts_of.append(m.end())
    lines = content.split("\n")

    grammar = _grammar(language)
    out = set()
    words = {"python": ("def", "async"), "go": ("func",)}.get(language)
    for group in (*inner, outer):
        kinds = ["PREDEFINED" if language == "csharp" and t.kind in _PREDEFINED else t.kind for t in group]
        starts = [i for i, t in enumerate(group) if (kinds[i] in words if words else t.new_line and kinds[i] not in _NEVER)]
        if not any(k in ("()", "BAD") for k in kinds):
            continue
        found = [(*x, True) for x in grammar.islands(kinds, "function", starts)]
        if damaged and "BAD" in kinds:
            met = {x[0] for x in found}
            found += [(*x, False) for x in _grammar(language, True).islands(kinds, "function", [i for i in starts if i not in met])]
        for first, end, whole in found:
            at = next((i for i in range(first, end) if kinds[i] == "()" and i > first), None)
            if language == "rust" and at is not None and kinds[at - 1] == "pub":
                at = next(i for i in range(at + 1, end) if kinds[i] == "()")
            k, depth = (at or first) - 1, 0
            while k > first and (kinds[k] == ">" or depth or kinds[k] == "[]"):  # type parameters
                depth += (kinds[k] == ">") - (kinds[k] == "<")
                k -= 1
            name = content[group[k].start : group[k].end] if at and k >= first else ""
            if language == "go":
                n = next(i for i in range(first, end) if kinds[i] == "ID")
                name = content[group[n].start : group[n].end]
                at = next((i for i in range(n, end) if kinds[i] == "()"), at)
            if name in _NOT_NAMES:
                continue
            last = group[end - 1]
            stop = last.end if last.kind != "NEWLINE" else group[end - 2].end
            doc = None
            if last.kind == "SUITE":
                body = content[last.start : last.end]
                stop = last.start + len(body.rstrip())
                if m := _DOCSTRING.match(body):
                    doc = m[2]
            begin = bisect_right(starts_of, group[first].start)
            if language != "python":
                doc = _comment_above(lines, begin)
            params = _params(content[group[at].start + 1 : group[at].end - 1], language) if at else ()
            out.add(Function(name, begin, bisect_right(starts_of, max(group[first].start, stop - 1)), params, doc, whole))
    return sorted(out, key=lambda x: (x.first, x.last, x.name))


def functions_in(content: str, language: str) -> list[tuple[str, int, int]]:
    """(name, first line, last line) of ``functions_of``."""
    return [f[:3] for f in functions_of(content, language)]


def parsed(files: DataFrame, code: bool = True) -> DataFrame:
    """scope_id, path, name, first, last, params, doc, whole, code: the functions found by parsing the latest delivery of each file.

    ``files`` has scope_id, path, content, language, run_at and loaded_at. A file is its scope and path; of its deliveries
    the one with the latest run, then arrival, then the greatest text counts. Null contents, null paths and unknown
    languages have no functions. Several functions that begin on one line are told apart by their names. A function whose
    header is sound but whose body is not is there with ``whole`` false.
    """
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    latest = (
        files.filter(F.col("path").isNotNull())
        .repartition(tasks, "scope_id", "path")  # a stated number: small texts that are dear to parse are not put together again
        .groupBy("scope_id", "path")
        .agg(F.max(F.struct("run_at", "loaded_at", "content", "language")).alias("f"))
        .select("scope_id", "path", F.col("f.content").alias("content"), F.col("f.language").alias("language"))
        .filter(F.col("content").isNotNull() & F.col("language").isNotNull())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["scope_id", "path", "name", "first", "last", "params", "doc", "whole", "code"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.string()]
        for b in batches:
            for scope, path, content, language in zip(*(c.to_pylist() for c in b.columns)):
                content = content.removeprefix("\ufeff").replace("\r\n", "\n")
                lines = content.split("\n")
                rows = [(scope, path, f.name, f.first, f.last, list(f.params), f.doc, f.whole, "\n".join(lines[f.first - 1 : f.last]) if code else None) for f in functions_of(content, language, damaged=True)]
                if rows:  # a batch a file: a file's functions never wait for those of others
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return latest.mapInArrow(run, "scope_id string, path string, name string, first int, last int, params array<string>, doc string, whole boolean, code string")


def pairs(functions: DataFrame, files: DataFrame, code: bool = True) -> DataFrame:
    """node_id, language, description, doc, code, whole, n_same: described functions with the functions that the parser found.

    ``functions`` has id, scope_id, name, path, language, start_line and summary, ``files`` as ``parsed`` takes them. A node
    and a parsed function are one if scope, path, first line and name agree; what the parser does not find has no
    pair. ``doc`` is the comment in the file; the description that is judged is the node's ``summary``. Null ids of scopes
    agree with each other, other nulls with nothing. Repeated rows of a function give one.
    """
    kept = ["id", "scope_id", "name", "path", "start_line", "summary"]
    rows = functions.select(*kept, language_of(F.col("language"), F.col("path")).alias("language")).filter(F.length(F.trim("summary")) > 0).dropDuplicates(["id"])
    islands = parsed(files, code)
    same = (
        rows["scope_id"].eqNullSafe(islands["scope_id"]) & (rows["path"] == islands["path"]) & (rows["start_line"] == islands["first"]) & (rows["name"] == islands["name"])
    )
    matched = rows.join(islands, same).select(rows["id"].cast("string").alias("id"), rows["name"], "language", "summary", "params", "doc", "code", "whole")
    matched = cut(matched.dropDuplicates(["id"]))
    good = described(matched)
    return (
        matched.join(good.select(F.col("node_id").alias("id"), "n_same"), "id")
        .select(F.col("id").alias("node_id"), "language", F.col("summary").alias("description"), "doc", "code", "whole", F.col("n_same").cast("bigint").alias("n_same"))
    )


def whole_functions(files: DataFrame) -> DataFrame:
    """extract_id, name, start_line, end_line, params, doc of the whole functions of ``files`` (extract_id, content, language).

    Null contents and unknown languages have none; repeated rows count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(key, f.name, f.first, f.last, list(f.params), f.doc) for key, content, language in zip(*(c.to_pylist() for c in b.columns)) for f in functions_of(content, language)]
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [b.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["extract_id", "name", "start_line", "end_line", "params", "doc"])

    known = files.select("extract_id", "content", "language").filter(F.col("content").isNotNull() & F.col("language").isNotNull())
    key = known.schema["extract_id"].dataType.simpleString()
    return known.mapInArrow(run, f"extract_id {key}, name string, start_line int, end_line int, params array<string>, doc string").distinct()
