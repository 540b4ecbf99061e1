"""Queries on functions and their documentation (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import functions
from strataq.llm.syntax import with_language
from strataq.sources.tables import table


def _documented(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes", "id", "kind", "scope_id", "name", "path", "language", "start_line", "summary", "summary_source")
    return nodes.filter((F.col("kind") == "function") & (F.col("summary_source") == "docs"))


def _files(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return with_language(table(spark, d, "extracts", "file_id", "path", "content", *more), table(spark, d, "nodes", "id", "kind", "language"))


def _by_delivery(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d, "scope_id", "run_at", "loaded_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The functions that the parser finds in the files and whose description says something."""
    return functions.pairs(_documented(spark, d), _by_delivery(spark, d), code=False).select("node_id")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return functions.pairs(_documented(spark, d), _by_delivery(spark, d))


def p5_templates(spark: SparkSession, d: str) -> DataFrame:
    """The templates that more than one function has, how many have them, and which are dropped for it."""
    rows = functions.judged(_documented(spark, d))
    return functions.templates(rows).filter(F.col("n_same") > 1).select("text", "words", "n_same", "n_names", "dropped")


def p5_functions(spark: SparkSession, d: str) -> DataFrame:
    """Every whole function that the island grammars find in the source files, broken ones included."""
    return functions.whole_functions(_files(spark, d, "extract_id")).select("extract_id", "name", "start_line", "end_line", "doc")


QUERIES = {q.__name__: q for q in (p5_found, p5_pairs, p5_templates, p5_functions)}

SQL: dict[str, str] = {}
