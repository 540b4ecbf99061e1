"""Source files that do not parse, by memoised parsing with derivatives of their tokens."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.grammars import grammar
from strataq.llm.lexers import DIALECTS, tokens

#: Spellings of language names, and file extensions.
NAMES = {
    "python": "python", "py": "python", "python3": "python", "cpython": "python", "typescript": "typescript", "ts": "typescript", "tsx": "tsx",
    "javascript": "javascript", "js": "javascript", "jsx": "jsx", "ecmascript": "javascript", "node": "javascript", "go": "go", "golang": "go",
    "c#": "csharp", "csharp": "csharp", "cs": "csharp", "c sharp": "csharp", "rust": "rust", "rs": "rust", "rustlang": "rust",
}
EXTENSIONS = {
    "py": "python", "pyi": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "go": "go", "cs": "csharp", "rs": "rust", "tsx": "tsx", "jsx": "jsx",
}


#: Nested calls that a derivative may take, some four for each open bracket.
DEPTH = 200_000


def language_of(name: Column, path: Column) -> Column:
    """The language by its name, however spelt, else by the extension of the path; null if neither is known."""
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    return F.coalesce(F.element_at(table(NAMES), F.lower(F.trim(name))), F.element_at(table(EXTENSIONS), F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))))


def fault(content: str, language: str) -> tuple[str, int, str] | None:
    """What is wrong with a text: (kind, line from 1, the failing token), or None if it parses.

    The kind is ``token`` (the first token that cannot stand there) or ``truncated`` (the text ends too early).
    """
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)  # brackets nest as deep as the derivatives of their languages
    found = tokens(content, language)
    failure = grammar(DIALECTS.get(language, language)).check([(t.kind, t.new_line) for t in found], ";" if language in ("javascript", "typescript", *DIALECTS) else None)
    if failure is None:
        return None
    if failure.truncated:
        return "truncated", content.count("\n") + 1, ""
    t = found[failure.token]
    return "token", content.count("\n", 0, t.start) + 1, content[t.start : t.end][:80]


def faults(files: DataFrame) -> DataFrame:
    """The rows of ``files`` (extract_id, content, language) that do not parse, with kind, line and token.

    Null contents and unknown languages are no case; an empty file is a case in the languages that demand more than
    nothing (Go). Repeated rows give one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, content, language in zip(*(c.to_pylist() for c in b.columns)):
                if f := fault(content, language):
                    rows.append((key, language, *f))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], b.schema.field(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.string())],
                ["extract_id", "language", "kind", "line", "token"],
            )

    kind = files.schema["extract_id"].dataType.simpleString()
    known = files.select("extract_id", "content", "language").filter(F.col("content").isNotNull() & F.col("language").isNotNull())
    return known.mapInArrow(run, f"extract_id {kind}, language string, kind string, line int, token string").distinct()


def with_language(extracts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``extracts`` with the language of its file node, and only the columns wanted here."""
    named = nodes.filter(F.col("kind") == "file").groupBy(F.col("id").alias("file_id")).agg(F.max("language").alias("__name"))
    return extracts.join(named, "file_id", "left").withColumn("language", language_of(F.col("__name"), F.col("path"))).drop("__name")


def rates(files: DataFrame) -> DataFrame:
    """Per scope and language: the files, those that do not parse and their share. Files without content do not count."""
    counted = files.filter(F.col("content").isNotNull()).select("extract_id", "scope_id", "language").dropDuplicates(["extract_id"])
    bad = faults(files).select("extract_id", F.lit(1).alias("bad"))
    return (
        counted.join(bad, "extract_id", "left")
        .groupBy("scope_id", "language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count("bad").alias("n_invalid"))
        .withColumn("share", F.col("n_invalid") / F.col("n_files"))
    )
