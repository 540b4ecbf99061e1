"""Facts of manifests and configuration files: from files (scope_id, rel_path, content) to rows.

Line-shaped formats are read with column expressions; nested ones by a table function that gets one file at a time.
Null contents and files that do not parse give no rows.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of source files that are read, of those that import but are not read, and ignored folders.
SOURCE = ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "py", "pyi", "ipynb", "go", "cs", "rs"]
UNREAD = ["vue", "svelte", "astro", "razor", "cshtml"]
IGNORED = ["node_modules", "dist", "build", "out", "coverage", "vendor", "target", "__pycache__", "venv", "bin", "obj"]


def scan(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, content and length of all files under a folder, hidden ones left out; contents must be UTF-8 to be read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^[a-z]+:/*", "", root.rstrip("/")).lstrip("/") + "/"
    return raw.select(F.regexp_replace("path", "^.*?" + re.escape(base), "").alias("rel_path"), F.decode("content", "UTF-8").alias("content"), "length").filter(~F.col("rel_path").rlike(r"(^|/)\."))


def source_files(files: DataFrame, ignore: list[str] = IGNORED) -> DataFrame:
    """The files whose extension is read and that lie in no ignored folder."""
    return files.filter(F.lower(F.substring_index("rel_path", ".", -1)).isin(SOURCE) & ~F.exists(F.split("rel_path", "/"), lambda p: p.isin(ignore)))


def unread_formats(files: DataFrame) -> DataFrame:
    """ext, n of files that import modules but are not read, the commonest first."""
    ext = F.lower(F.substring_index("rel_path", ".", -1)).alias("ext")
    return files.select(ext).filter(F.col("ext").isin(UNREAD)).groupBy("ext").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ext")


def _each(files: DataFrame, name: str, read: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """Rows of ``read(content)`` for each file whose base name matches the pattern ``name``."""
    chosen = files.filter(F.substring_index("rel_path", "/", -1).rlike(name) & F.col("content").isNotNull()).select("scope_id", "rel_path", "content")
    width = len(columns.split(","))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for scope, path, content in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    rows += [(scope, path, *r) for r in read(content)]
                except (ValueError, TypeError, AttributeError, KeyError):
                    continue
            out = list(zip(*rows)) if rows else [[]] * (width + 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["scope_id", "rel_path", *(x.split()[0] for x in columns.split(","))])

    return chosen.mapInArrow(run, f"scope_id string, rel_path string, {columns}")


def _package_json(content: str) -> list[tuple]:
    d = json.loads(content)
    return sorted({(k, str(v), group) for group in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for k, v in (d.get(group) or {}).items()})


def node_packages(files: DataFrame) -> DataFrame:
    """package, version, kind of every dependency in package.json."""
    return _each(files, r"^package\.json$", _package_json, "package string, version string, kind string")


def _entries(content: str) -> list[tuple]:
    d = json.loads(content)
    out = [(d[k], k, None) for k in ("main", "module", "browser", "types", "typings", "source") if isinstance(d.get(k), str)]
    b = d.get("bin")
    out += [(v, "bin", k) for k, v in b.items()] if isinstance(b, dict) else [(b, "bin", d.get("name"))] if isinstance(b, str) else []

    def walk(x, depth):
        if isinstance(x, str):
            out.append((x, "exports", None))
        elif isinstance(x, dict) and depth < 6:
            for v in x.values():
                walk(v, depth + 1)

    walk(d.get("exports"), 0)
    for script, line in (d.get("scripts") or {}).items():
        out += [(p, "scripts", script) for p in re.findall(r"[\w./-]+\.(?:[cm]?[jt]sx?|py)\b", str(line))]
    seen: dict[tuple, tuple] = {}
    for p, field, command in out:
        seen.setdefault((p.removeprefix("./"), field), (p.removeprefix("./"), field, command))
    return list(seen.values())


def entry_points(files: DataFrame) -> DataFrame:
    """path, field, command of what package.json declares as an entry; the first command of a path and field counts."""
    return _each(files, r"^package\.json$", _entries, "path string, field string, command string")


def _normal(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name).lower()


def _python(content: str) -> list[tuple]:
    try:
        d = tomllib.loads(content)
    except tomllib.TOMLDecodeError:
        d = None
    if d is not None and any(k in d for k in ("project", "tool", "packages", "build-system")):
        p = d.get("project") or {}
        names = [*(p.get("dependencies") or []), *(x for v in (p.get("optional-dependencies") or {}).values() for x in v)]
        poetry = (d.get("tool") or {}).get("poetry") or {}
        names += [k for k in poetry.get("dependencies") or {} if k != "python"]
        names += [k for g in (poetry.get("group") or {}).values() for k in g.get("dependencies") or {}]
        names += [*(d.get("packages") or {}), *(d.get("dev-packages") or {})]
    else:
        names = [x for x in content.splitlines() if not re.match(r"\s*(?:#|-|$)", x)]
    found = {_normal(m[1]) for n in names if (m := re.match(r"\s*([A-Za-z0-9][\w.\-]*)", n))}
    return [(x,) for x in sorted(found)]


def python_packages(files: DataFrame) -> DataFrame:
    """package of requirements*.txt, pyproject.toml and Pipfile, in normal form."""
    return _each(files, r"^(requirements[\w.-]*\.txt|pyproject\.toml|Pipfile)$", _python, "package string")


def _go(content: str) -> list[tuple]:
    m = re.search(r"(?m)^module\s+(\S+)", content)
    out = [(m[1], None, "module")] if m else []
    body = "\n".join(re.findall(r"(?m)^require\s+([^\s(]\S*\s+\S+.*)$", content) + [x for b in re.findall(r"(?ms)^require\s*\((.*?)^\)", content) for x in b.splitlines()])
    for line in body.splitlines():
        if (r := re.match(r"\s*([^\s/]\S*)\s+(v\S+)", line)) and "// indirect" not in line:
            out.append((r[1], r[2], "require"))
    return out


def go_modules(files: DataFrame) -> DataFrame:
    """package, version, kind: the module path and its direct requirements in go.mod."""
    return _each(files, r"^go\.mod$", _go, "package string, version string, kind string")


def _cargo(content: str) -> list[tuple]:
    d = tomllib.loads(content)
    out = set()

    def take(x: dict) -> None:
        for kind in ("dependencies", "dev-dependencies", "build-dependencies"):
            for k, v in (x.get(kind) or {}).items():
                out.add((k, v if isinstance(v, str) else str(v.get("version")) if v.get("version") else None, kind))

    take(d)
    take(d.get("workspace") or {})
    for t in (d.get("target") or {}).values():
        take(t)
    return sorted(out, key=str)


def cargo_packages(files: DataFrame) -> DataFrame:
    """package, version, kind of Cargo.toml, workspaces and targets included."""
    return _each(files, r"^Cargo\.toml$", _cargo, "package string, version string, kind string")


def dotnet_packages(files: DataFrame) -> DataFrame:
    """package, version of the references in project files."""
    refs = F.regexp_extract_all("content", F.lit(r"<(?:PackageReference|PackageVersion|FrameworkReference)\b[^>]*\bInclude=\"[^\"]+\"[^>]*>"), F.lit(0))
    one = files.filter(F.col("rel_path").rlike(r"\.(csproj|fsproj|props)$") & F.col("content").isNotNull()).select("scope_id", "rel_path", F.explode(refs).alias("r"))
    version = F.regexp_extract("r", r"\bVersion=\"([^\"]+)\"", 1)
    return one.select("scope_id", "rel_path", F.regexp_extract("r", r"\bInclude=\"([^\"]+)\"", 1).alias("package"), F.when(version != "", version).alias("version"))


def env_names(files: DataFrame) -> DataFrame:
    """name of each variable in templates of environment files; real environment files are never read."""
    template = files.filter(F.substring_index("rel_path", "/", -1).rlike(r"^\.?env[\w.-]*\.(example|sample|template|defaults|dist)$|^\.env\.(example|sample|template|defaults|dist)$") & F.col("content").isNotNull())
    names = F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*(?:export[ \t]+)?([A-Za-z_][A-Za-z0-9_]*)[ \t]*="), F.lit(1))
    return template.select("scope_id", F.explode(names).alias("name")).distinct()


def _flat(content: str) -> list[tuple]:
    out: list[tuple] = []

    def walk(x, path):
        if path:
            out.append((":".join(path), None if isinstance(x, (dict, list)) else json.dumps(x) if not isinstance(x, str) else x))
        for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
            walk(v, [*path, str(k)])

    walk(json.loads(content.removeprefix("﻿")), [])
    return out


def settings(files: DataFrame) -> DataFrame:
    """name, value of appsettings*.json, flattened to A:B:C, ancestors included with a null value."""
    return _each(files, r"(?i)^appsettings[\w.-]*\.json$", _flat, "name string, value string")


def scheduled_routes(files: DataFrame) -> DataFrame:
    """path, schedule of the crons in vercel.json and now.json."""
    kind = "struct<crons: array<struct<path: string, schedule: string>>>"
    return files.filter(F.substring_index("rel_path", "/", -1).isin("vercel.json", "now.json")).select("scope_id", F.explode(F.from_json("content", kind).getField("crons")).alias("c")).select("scope_id", "c.path", "c.schedule")
