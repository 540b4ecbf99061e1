"""Tables that SQL migrations describe, by replaying their statements in order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_NAME = r"(?:\"[^\"]+\"|`[^`]+`|\[[^\]]+\]|[A-Za-z_]\w*)(?:\s*\.\s*(?:\"[^\"]+\"|`[^`]+`|\[[^\]]+\]|[A-Za-z_]\w*))?"
_CREATE = re.compile(rf"(?is)^\s*create\s+(?:global\s+|local\s+)?(?:temp(?:orary)?\s+|unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?({_NAME})\s*\((.*)\)[^)]*$")
_ALTER = re.compile(rf"(?is)^\s*alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?({_NAME})\s+(.*)$")
_DROP = re.compile(rf"(?is)^\s*drop\s+table\s+(?:if\s+exists\s+)?({_NAME})")
_CONSTRAINT = re.compile(r"(?i)^(?:constraint\s+\S+\s+)?(primary\s+key|unique|foreign\s+key|check|exclude|like|index|key)\b")
_STOP = re.compile(r"(?i)\s+(?:not\s+null|null|primary\s+key|unique|references|default|check|collate|generated|constraint|auto_?increment|comment|on\s+(?:update|delete))\b.*$", re.DOTALL)


def statements(text: str) -> Iterator[str]:
    """The statements of a script: semicolons within quotes, $tag$ bodies and nested comments do not divide it; comments become blanks."""
    out, at, n = [], 0, len(text)
    token = re.compile(r"--[^\n]*|/\*|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\$(\w*)\$|;")
    while m := token.search(text, at):
        out.append(text[at : m.start()])
        t, at = m[0], m.end()
        if t == ";":
            yield "".join(out)
            out = []
        elif t == "/*":
            depth = 1
            while depth and (c := re.compile(r"/\*|\*/").search(text, at)):
                depth += 1 if c[0] == "/*" else -1
                at = c.end()
            at = n if depth else at
            out.append(" ")
        elif t.startswith("--"):
            out.append(" ")
        elif t.startswith("$"):
            end = text.find(t, at)
            end = n if end < 0 else end + len(t)
            out.append(text[m.start() : end])
            at = end
        else:
            out.append(t)
    out.append(text[at:])
    if "".join(out).strip():
        yield "".join(out)


def plain(name: str) -> str:
    """A name as it is looked up: without its schema and quotes, lower case unless quoted."""
    last = re.split(r"\.(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", name.strip())[-1].strip()
    return last[1:-1] if last[:1] in "\"`[" else last.lower()


def _parts(body: str) -> list[str]:
    out, depth, start = [], 0, 0
    for m in re.finditer(r"'(?:[^']|'')*'|[(),]", body):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth -= 1
        elif m[0] == "," and depth == 0:
            out.append(body[start : m.start()].strip())
            start = m.end()
    return [p for p in [*out, body[start:].strip()] if p]


def _column(text: str) -> tuple[str, dict] | None:
    m = re.match(rf"(?is)^({_NAME})\s+(.*)$", text)
    if not m:
        return None
    rest = m[2]
    kind = re.sub(r"\s+", " ", _STOP.sub("", " " + rest)).strip()
    ref = re.search(rf"(?i)\breferences\s+({_NAME})", rest)
    key = bool(re.search(r"(?i)\bprimary\s+key\b", rest))
    return plain(m[1]), {
        "type": kind if kind.startswith('"') else kind.lower(), "optional": not key and not re.search(r"(?i)\bnot\s+null\b", rest), "is_key": key, "is_unique": bool(re.search(r"(?i)\bunique\b", rest)), "references": plain(ref[1]) if ref else None,
    }


def replay(scripts: list[str]) -> dict[str, dict[str, dict]]:
    """Columns per table after all scripts; the first CREATE of a table counts, later ones are ignored until it is dropped."""
    tables: dict[str, dict[str, dict]] = {}
    for text in scripts:
        for s in statements(text):
            if m := _CREATE.match(s):
                name = plain(m[1])
                if name in tables:
                    continue
                columns: dict[str, dict] = {}
                for p in _parts(m[2]):
                    if c := _CONSTRAINT.match(p):
                        names = [plain(x) for x in re.split(r",", (re.search(r"\(([^)]*)\)", p) or [None, ""])[1]) if x.strip()]
                        what = re.sub(r"\s+", " ", c[1].lower())
                        ref = re.search(rf"(?i)\breferences\s+({_NAME})", p)
                        for x in names:
                            if x in columns:
                                columns[x].update({"primary key": {"is_key": True, "optional": False}, "unique": {"is_unique": len(names) == 1 or columns[x]["is_unique"]}, "foreign key": {"references": plain(ref[1]) if ref else None}}.get(what, {}))
                    elif col := _column(p):
                        columns[col[0]] = col[1]
                tables[name] = columns
            elif m := _ALTER.match(s):
                t = tables.get(plain(m[1]))
                if t is None:
                    continue
                for p in _parts(m[2]):
                    if a := re.match(r"(?is)^add\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?(?!constraint|primary|unique|foreign|check)(.*)$", p):
                        if col := _column(a[1]):
                            t.setdefault(*col)
                    elif a := re.match(rf"(?is)^drop\s+(?:column\s+)?(?:if\s+exists\s+)?(?!constraint)({_NAME})", p):
                        t.pop(plain(a[1]), None)
                    elif a := re.match(rf"(?is)^alter\s+(?:column\s+)?({_NAME})\s+(?:set\s+data\s+)?type\s+(.*)$", p):
                        if plain(a[1]) in t:
                            t[plain(a[1])]["type"] = re.sub(r"\s+", " ", re.sub(r"(?is)\s+using\s.*$", "", a[2])).strip().lower()
                    elif (a := re.match(rf"(?is)^rename\s+(?:column\s+)?({_NAME})\s+to\s+({_NAME})", p)) and plain(a[1]) in t:
                        t[plain(a[2])] = t.pop(plain(a[1]))
            elif m := _DROP.match(s):
                tables.pop(plain(m[1]), None)
    return tables


def schema_of(migrations: DataFrame) -> DataFrame:
    """scope_id, table, column, type, optional, is_key, is_unique, references after the migrations (scope_id, path, text) of each scope, in the order of their paths.

    The migrations of a scope are replayed by one task, as their order matters; null texts count as empty.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("path")
        rows = [(pdf["scope_id"].iloc[0], t, c, v["type"], v["optional"], v["is_key"], v["is_unique"], v["references"]) for t, cols in replay([x or "" for x in pdf["text"]]).items() for c, v in cols.items()]
        return pd.DataFrame(rows, columns=["scope_id", "table", "column", "type", "optional", "is_key", "is_unique", "references"])

    return migrations.select("scope_id", "path", "text").groupBy("scope_id").applyInPandas(run, "scope_id string, table string, column string, type string, optional boolean, is_key boolean, is_unique boolean, references string")
