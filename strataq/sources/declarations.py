"""Declarations and imports of source files by line rules, imports resolved to files, and names linked to what declares them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataq.functions.classes import resolve_specifier
from strataq.functions.scalars import folder_of, module_of
from strataq.sources.boundaries import _CS, _GO, _PY, _RS, _TS, Rule, findings

_MOD = r"(?:(?:public|private|protected|internal|static|async|virtual|override|abstract|sealed|readonly|get|set)\s+)"
# How each language writes what it declares, as far as one line shows it; the target is the name.
RULES = [
    Rule("function", "typescript", _TS, r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", 0, 1),
    Rule("function", "typescript", _TS, r"^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>", 0, 1),
    Rule("method", "typescript", _TS, rf"^\s+{_MOD}*(\w+)\s*\([^)]*\)\s*(?::\s*[^{{]+)?\{{\s*$", 0, 1),
    Rule("type", "typescript", _TS, r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:class|interface|enum|type)\s+(\w+)", 0, 1),
    Rule("import", "typescript", _TS, r"^\s*(?:import|export)\s+(?:.*\sfrom\s+)?[\"']([^\"']+)[\"']", 0, 1),
    Rule("import", "typescript", _TS, r"\brequire\(\s*[\"']([^\"']+)[\"']\s*\)", 0, 1),
    Rule("function", "python", _PY, r"^\s*(?:async\s+)?def\s+(\w+)", 0, 1),
    Rule("type", "python", _PY, r"^\s*class\s+(\w+)", 0, 1),
    Rule("import", "python", _PY, r"^\s*(?:from|import)\s+([\w.]+)", 0, 1),
    Rule("function", "go", _GO, r"^func\s+(?:\([^)]*\)\s*)?(\w+)", 0, 1),
    Rule("type", "go", _GO, r"^type\s+(\w+)", 0, 1),
    Rule("import", "go", _GO, r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$", 0, 1),
    Rule("namespace", "go", _GO, r"^package\s+(\w+)", 0, 1),
    Rule("type", "csharp", _CS, rf"^\s*{_MOD}*(?:partial\s+)?(?:class|interface|struct|record|enum)\s+(\w+)", 0, 1),
    Rule("method", "csharp", _CS, rf"^\s+{_MOD}+[\w<>\[\],.?]+(?:\s*<[^>]*>)?\s+(\w+)\s*(?:<[^>]*>)?\(", 0, 1),
    Rule("import", "csharp", _CS, r"^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;", 0, 1),
    Rule("namespace", "csharp", _CS, r"^\s*namespace\s+([\w.]+)", 0, 1),
    Rule("function", "rust", _RS, r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(\w+)", 0, 1),
    Rule("type", "rust", _RS, r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+(\w+)", 0, 1),
    Rule("import", "rust", _RS, r"^\s*(?:pub\s+)?(?:use|mod)\s+([\w:]+)", 0, 1),
]
#: Words that stand before brackets without naming a method.
NOT_NAMES = ["if", "for", "while", "switch", "catch", "return", "with", "function", "using", "lock", "foreach", "else", "do", "new", "await"]


def declarations(files: DataFrame) -> DataFrame:
    """scope_id, path, line, fact, language, name: functions, methods, types, imports and namespaces of ``files``.

    By line: what spreads over several lines shows by its first, or not at all. Null paths and contents have none; repeated
    rows count once.
    """
    found = findings(files, RULES).filter(F.col("target").isNotNull() & ~((F.col("kind") == "method") & F.col("target").isin(NOT_NAMES)))
    return found.select("scope_id", "path", "line", F.col("kind").alias("fact"), F.col("framework").alias("language"), F.col("target").alias("name")).distinct()


def resolved_imports(facts: DataFrame, files: DataFrame) -> DataFrame:
    """scope_id, path, target_path, language: imports (of ``declarations``) joined to the files of their scope that they mean.

    Relative and aliased paths are folded and met by the file or index they name; a namespace means every file that opens it; a
    dotted, slashed or ``::`` name means the file or, in Go, the files of the folder whose path ends in the longest tail of it
    that names but one. Each is a join on equal keys. A file does not import itself.
    """
    known = files.filter(F.col("path").isNotNull()).select("scope_id", "path").distinct()
    want = facts.filter("fact = 'import'").select("scope_id", "path", "language", "name").distinct()
    by_module = known.select("scope_id", module_of(F.col("path")).alias("key"), F.col("path").alias("target_path"))
    relative = want.filter("language = 'typescript'").withColumn("key", module_of(F.concat(resolve_specifier(F.col("name"), F.col("path")), F.lit(".x")))).join(by_module.filter(F.col("target_path").rlike(_TS)), ["scope_id", "key"])
    spaces = facts.filter("fact = 'namespace' AND language = 'csharp'").select("scope_id", "name", F.col("path").alias("target_path")).distinct()
    opened = want.filter("language = 'csharp'").join(spaces, ["scope_id", "name"])

    # tails: every end of a module's path as a key, kept where it names one module alone
    unit = F.when(F.col("path").rlike(_GO), folder_of(F.col("path"))).when(F.col("path").rlike(rf"{_PY}|{_RS}"), F.regexp_replace(F.regexp_replace("path", r"\.\w+$", ""), r"/(__init__|mod)$", ""))
    language = F.when(F.col("path").rlike(_GO), "go").when(F.col("path").rlike(_PY), "python").otherwise("rust")
    units = known.select("scope_id", unit.alias("unit"), language.alias("language"), "path").filter(F.col("unit").isNotNull())
    tails = lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    index = units.select("scope_id", "language", "unit").distinct().select("scope_id", "language", "unit", F.explode(tails(F.split("unit", "/"))).alias("tail"))
    single = index.groupBy("scope_id", "language", "tail").agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("unit")).filter("n = 1")
    parts = F.filter(F.split(F.regexp_replace("name", r"::|\.(?=\w)", "/"), "/"), lambda s: ~s.isin("crate", "self", "super", ""))
    named = want.filter("language IN ('go', 'python', 'rust')").withColumn("parts", F.when(F.col("language") == "go", F.split("name", "/")).otherwise(parts)).filter(F.size("parts") > 0)
    heads = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.struct(n.alias("n"), F.slice("parts", F.lit(1), n).alias("p")))
    # in Go a tail of the name, elsewhere all of it or, where it ends in a declared name, what stands before
    keys = F.when(F.col("language") == "go", F.transform(tails(F.col("parts")), lambda t: F.struct(F.size(F.split(t, "/")).alias("n"), t.alias("tail")))).otherwise(F.transform(heads, lambda h: F.struct(h["n"].alias("n"), F.array_join(h["p"], "/").alias("tail"))))
    tried = named.select("scope_id", "path", "language", "name", F.explode(keys).alias("k")).select("scope_id", "path", "language", "name", "k.n", "k.tail")
    best = tried.join(single.drop("n"), ["scope_id", "language", "tail"]).groupBy("scope_id", "path", "language", "name").agg(F.max_by("unit", "n").alias("unit"))
    by_tail = best.join(units.select("scope_id", "language", "unit", F.col("path").alias("target_path")), ["scope_id", "language", "unit"])
    columns = ["scope_id", "path", "target_path", "language"]
    return relative.select(*columns).unionByName(opened.select(*columns)).unionByName(by_tail.select(*columns)).filter(F.col("path") != F.col("target_path")).distinct()


def linked_names(files: DataFrame, facts: DataFrame, imports: DataFrame) -> DataFrame:
    """scope_id, path, target_path, fact, name, weight: names declared in an imported file (``facts``, ``imports``) that the
    importing file uses, with how often. A name that several imported files declare links to each."""
    word = F.explode(F.regexp_extract_all("content", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))
    used = files.filter(F.col("path").isNotNull()).select("scope_id", "path", "content").distinct().select("scope_id", "path", word.alias("name")).groupBy("scope_id", "path", "name").agg(F.count(F.lit(1)).alias("weight"))
    declared = facts.filter("fact IN ('function', 'type', 'method')").select("scope_id", F.col("path").alias("target_path"), "fact", "name").distinct()
    offered = imports.select("scope_id", "path", "target_path").distinct().join(declared, ["scope_id", "target_path"])
    return offered.join(used, ["scope_id", "path", "name"]).select("scope_id", "path", "target_path", "fact", "name", "weight")


def merged_types(facts: DataFrame) -> DataFrame:
    """scope_id, namespace, name, paths: types of C# that several files of a namespace declare, as one (partial classes)."""
    spaces = facts.filter("fact = 'namespace' AND language = 'csharp'").groupBy("scope_id", "path").agg(F.min_by("name", "line").alias("namespace"))
    types = facts.filter("fact = 'type' AND language = 'csharp'").select("scope_id", "path", "name").distinct().join(spaces, ["scope_id", "path"], "left")
    return types.groupBy("scope_id", "namespace", "name").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def unique_ids(facts: DataFrame) -> DataFrame:
    """``facts`` with id: functions and types by path and name, ~2, ~3, ... on further ones of a name in a file, by line."""
    n = F.row_number().over(W.partitionBy("scope_id", "path", "fact", "name").orderBy("line"))
    base = F.concat(F.when(F.col("fact") == "type", "type:").otherwise("func:"), "path", F.lit("#"), "name")
    return facts.filter("fact IN ('function', 'method', 'type')").withColumn("id", F.concat(base, F.when(n > 1, F.concat(F.lit("~"), n.cast("string"))).otherwise("")))
