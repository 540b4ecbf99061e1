"""Facts of Python source files: definitions, imports and calls, from the syntax tree of each file."""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "key string, fact string, name string, owner string, target string, line int, end_line int"


def notebook_source(content: str) -> str:
    """The code cells of a notebook as one text; lines that are no Python (magics, shell) become blank."""
    cells = json.loads(content).get("cells", [])
    out = []
    for c in cells:
        if c.get("cell_type") == "code":
            text = "".join(c.get("source", [])) if isinstance(c.get("source"), list) else c.get("source") or ""
            text = "\n".join("" if x.lstrip().startswith(("%", "!", "?")) else x for x in text.split("\n"))
            try:
                ast.parse(text)
            except (SyntaxError, ValueError):
                text = "\n" * text.count("\n")
            out.append(text)
    return "\n".join(out)


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    return None


def facts_of(content: str) -> list[tuple]:
    """(fact, name, owner, target, line, end_line): function, class, import, call, base, decorator, main; raises if it does not parse."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(content.removeprefix("﻿"))
    out: list[tuple] = []
    work: list[tuple[ast.AST, str | None]] = [(x, None) for x in reversed(tree.body)]
    while work:
        n, owner = work.pop()
        inner = owner
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(n, ast.ClassDef) else "function"
            out.append((kind, n.name, owner, None, n.lineno, n.end_lineno))
            inner = f"{owner}.{n.name}" if owner else n.name
            out += [("decorator", n.name, owner, t, d.lineno, d.end_lineno) for d in n.decorator_list if (t := _dotted(d.func if isinstance(d, ast.Call) else d))]
            if kind == "class":
                out += [("base", n.name, owner, t, b.lineno, b.end_lineno) for b in n.bases if (t := _dotted(b))]
        elif isinstance(n, ast.Import):
            out += [("import", a.asname or a.name, owner, a.name, n.lineno, n.end_lineno) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            module = "." * n.level + (n.module or "")
            out += [("import", a.asname or a.name, owner, f"{module}:{a.name}", n.lineno, n.end_lineno) for a in n.names]
        elif isinstance(n, ast.Call) and (t := _dotted(n.func)):
            out.append(("call", t.rsplit(".", 1)[-1], owner, t, n.lineno, n.end_lineno))
        elif isinstance(n, ast.If) and isinstance(n.test, ast.Compare) and isinstance(n.test.left, ast.Name) and n.test.left.id == "__name__":
            out.append(("main", "__main__", owner, None, n.lineno, n.end_lineno))
        work += [(x, inner) for x in reversed(list(ast.iter_child_nodes(n)))]
    return out


def python_facts(files: DataFrame) -> DataFrame:
    """Rows of _SCHEMA for files (key, rel_path, content). A file that does not parse gives one row ``error``; null contents none.

    Nothing is resolved here: targets are names as written. Repeated rows repeat their facts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int32()] * 2
        for b in batches:
            rows = []
            for key, path, content in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    rows += [(key, *f) for f in facts_of(notebook_source(content) if path.endswith(".ipynb") else content)]
                except (SyntaxError, ValueError, RecursionError, MemoryError, AttributeError) as e:
                    rows.append((key, "error", type(e).__name__, None, None, getattr(e, "lineno", None), None))
            out = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    some = files.filter(F.col("content").isNotNull() & F.col("rel_path").rlike(r"\.(py|pyi|ipynb)$"))
    return some.select(F.col("key").cast("string"), "rel_path", "content").mapInArrow(run, _SCHEMA)


def resolve_imports(facts: DataFrame, files: DataFrame) -> DataFrame:
    """key, target_path, names: imports joined to the file their module names, by every dotted tail of the files' paths.

    A tail that two files share resolves to none. ``files`` has rel_path.
    """
    module = F.regexp_replace(F.regexp_replace("rel_path", r"\.pyi?$", ""), r"/__init__$", "")
    parts = F.split(module, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    index = files.filter(F.col("rel_path").rlike(r"\.pyi?$")).select("rel_path").distinct().select("rel_path", F.explode(tails).alias("tail"))
    unique = index.groupBy("tail").agg(F.count(F.lit(1)).alias("n"), F.min("rel_path").alias("target_path")).filter("n = 1")
    wanted = facts.filter("fact = 'import'").select("key", F.substring_index("target", ":", 1).alias("tail"), "name")
    return wanted.join(unique, "tail").groupBy("key", "target_path").agg(F.array_sort(F.collect_set("name")).alias("names"))
