"""Tables from configuration files: Compose ports, Prisma models, worker settings, workspaces and markup, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ADDRESS = r"(\d{1,3}(?:\.\d{1,3}){3}|\[[^\]]*\]|localhost)"
_PORT = rf"^(?:{_ADDRESS}:)?(?:(\d+(?:-\d+)?|\$\{{[^}}]+\}}):)?(\d+(?:-\d+)?|\$\{{[^}}]+\}})(?:/(tcp|udp))?$"


def compose_port(raw: Column) -> Column:
    """struct(bind_address, host_port, host_port_var, container_port, protocol) of a published port; null if it is none.

    Without a host port the container's port is published on one of Docker's choice.
    """
    bare = F.trim(F.regexp_replace(raw, "^[\"' ]+|[\"' ]+$", ""))
    part = lambda n: F.nullif(F.regexp_extract(bare, _PORT, n), F.lit(""))
    variable = part(2).rlike(r"^\$")
    return F.when(bare.rlike(_PORT), F.struct(
        part(1).alias("bind_address"), F.when(~variable | part(2).isNull(), part(2)).alias("host_port"), F.when(variable, F.regexp_extract(part(2), r"^\$\{([A-Za-z_]\w*)", 1)).alias("host_port_var"),
        part(3).alias("container_port"), F.coalesce(part(4), F.lit("tcp")).alias("protocol"),
    ))


def compose_ports(files: DataFrame) -> DataFrame:
    """scope_id, path, service, port struct of Compose files (scope_id, path, content): lists of ports below a service."""
    compose = files.filter(F.col("path").rlike(r"(^|/)(docker-)?compose(\.[\w-]+)?\.ya?ml$"))
    service = F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^(  [\w.-]+:[ \t]*\r?\n(?:(?:    .*|[ \t]*)\r?\n?)+)"), F.lit(1))).alias("block")
    lists = compose.select("scope_id", "path", service).select("scope_id", "path", F.regexp_extract("block", r"^  ([\w.-]+):", 1).alias("service"), F.regexp_extract("block", r"(?m)^    ports:[ \t]*\r?\n((?:[ \t]*-[ \t]*.*(?:\r?\n|$))+)", 1).alias("list"))
    items = lists.select("scope_id", "path", "service", F.explode(F.regexp_extract_all("list", F.lit(r"-[ \t]*([^\r\n#]+)"), F.lit(1))).alias("raw"))
    return items.select("scope_id", "path", "service", compose_port(F.col("raw")).alias("port")).filter(F.col("port").isNotNull())


def prisma_models(files: DataFrame) -> DataFrame:
    """scope_id, path, model, table_name, fields (name, type, optional, many, is_id, is_unique) of Prisma schemas."""
    prisma = files.filter(F.col("path").endswith(".prisma"))
    block = F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^(model\s+\w+\s*\{[^}]*\})"), F.lit(1))).alias("block")
    model = prisma.select("scope_id", "path", block)
    line = F.filter(F.transform(F.split(F.regexp_extract("block", r"(?s)\{(.*)\}", 1), r"\r?\n"), lambda s: F.trim(s)), lambda s: s.rlike(r"^[A-Za-z]\w*\s+[A-Za-z]"))
    field = lambda s: F.struct(
        F.regexp_extract(s, r"^(\w+)", 1).alias("name"), F.regexp_extract(s, r"^\w+\s+(\w+)", 1).alias("type"), s.rlike(r"^\w+\s+\w+\?").alias("optional"), s.rlike(r"^\w+\s+\w+\[\]").alias("many"),
        s.rlike(r"@id\b").alias("is_id"), s.rlike(r"@unique\b").alias("is_unique"),
    )
    mapped = F.nullif(F.regexp_extract("block", r"@@map\(\s*(?:name:\s*)?\"([^\"]+)\"", 1), F.lit(""))
    return model.select("scope_id", "path", F.regexp_extract("block", r"^model\s+(\w+)", 1).alias("model"), mapped.alias("table_name"), F.transform(line, field).alias("fields"))


def worker_settings(files: DataFrame) -> DataFrame:
    """scope_id, path, kind (entry, cron, route, binding), value of worker settings (wrangler.toml, .json, .jsonc)."""
    w = files.filter(F.col("path").rlike(r"(^|/)wrangler\.(toml|jsonc?)$"))
    text = F.regexp_replace("content", r"(?m)^[ \t]*(?:#|//).*$", "")
    all_ = lambda pattern, kind: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    crons = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\"?crons\"?\s*[=:]\s*\[([^\]]*)\]"), F.lit(1)), lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"\"([^\"]+)\""), F.lit(1)), lambda v: F.struct(F.lit("cron").alias("kind"), v.alias("value")))))
    return w.select("scope_id", "path", F.explode(F.concat(all_(r"(?m)^[ \t]*\"?main\"?\s*[=:]\s*\"([^\"]+)\"", "entry"), crons, all_(r"\"?pattern\"?\s*[=:]\s*\"([^\"]+)\"", "route"), all_(r"\"?binding\"?\s*[=:]\s*\"([^\"]+)\"", "binding"))).alias("s")).select("scope_id", "path", "s.*")


def glob_regex(glob: Column) -> Column:
    """A folder pattern of a workspace as an anchored expression: * is one segment, ** any number."""
    quoted = F.regexp_replace(F.regexp_replace(F.regexp_replace(glob, r"^\./|/$", ""), r"([.+(){}\[\]^$|])", r"\\$1"), r"\*\*/?", "\u0001")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", "[^/]+"), "\u0001", "(?:.+/)?[^/]*"), F.lit("$"))


def workspaces(files: DataFrame) -> DataFrame:
    """scope_id, package: the folders with a package.json that a workspace's patterns name and do not take away.

    Patterns stand in the top package.json (``workspaces``, a list or with ``packages``) or pnpm-workspace.yaml; a pattern
    with ! takes away. Patterns meet the folders of their own scope alone.
    """
    top = files.filter(F.col("path") == "package.json").select("scope_id", F.get_json_object("content", "$.workspaces").alias("w"))
    of_json = top.select("scope_id", F.explode(F.from_json(F.when(F.col("w").startswith("["), F.col("w")).otherwise(F.get_json_object("w", "$.packages")), "array<string>")).alias("glob"))
    yaml = files.filter(F.col("path") == "pnpm-workspace.yaml").select("scope_id", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*-\s*[\"']?([^\"'\r\n#]+?)[\"']?\s*$"), F.lit(1))).alias("glob"))
    globs = of_json.unionByName(yaml).filter(F.col("glob").isNotNull()).groupBy("scope_id").agg(F.collect_set(F.struct(F.col("glob").startswith("!").alias("out"), glob_regex(F.regexp_replace("glob", "^!", "")).alias("regex"))).alias("globs"))
    folders = files.filter(F.col("path").endswith("/package.json")).select("scope_id", F.regexp_replace("path", "/package.json$", "").alias("package")).distinct()
    met = lambda out: F.exists("globs", lambda g: (g["out"] == out) & F.rlike(F.col("package"), g["regex"]))
    return folders.join(globs, "scope_id").filter(met(False) & ~met(True)).select("scope_id", "package")


def markup(files: DataFrame) -> DataFrame:
    """scope_id, path, class_name, handlers: the class and the event handlers that a .xaml file names."""
    x = files.filter(F.col("path").endswith(".xaml"))
    handlers = F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b(?:Click|Loaded|Command|Tapped|Checked|Unchecked|SelectionChanged|TextChanged|Closing)=\"(\w+)\""), F.lit(1))))
    return x.select("scope_id", "path", F.nullif(F.regexp_extract("content", r"x:Class=\"([^\"]+)\"", 1), F.lit("")).alias("class_name"), handlers.alias("handlers"))


def declares_package(path: Column) -> Column:
    """Whether a file says that its folder is a package of some ecosystem."""
    return path.rlike(r"(^|/)(package\.json|pyproject\.toml|setup\.(py|cfg)|go\.mod|Cargo\.toml|[^/]+\.(cs|fs|vb)proj|composer\.json|Gemfile|pom\.xml|build\.gradle(\.kts)?)$")


def source_slice(files: DataFrame, wanted: DataFrame, around: int = 3) -> DataFrame:
    """scope_id, path, first, text: the lines of ``wanted`` (scope_id, path, start_line, end_line) with some around them.

    Lines beyond the file's are left out; what has no file, no line or lies outside has no row.
    """
    w = wanted.filter(F.col("start_line") >= 1).select("scope_id", "path", F.greatest(F.col("start_line") - around, F.lit(1)).alias("first"), (F.coalesce("end_line", "start_line") + around).alias("last"))
    lines = F.split("content", r"\r\n|\n|\r")
    return w.join(files.filter(F.col("content").isNotNull()).select("scope_id", "path", "content"), ["scope_id", "path"]).filter(F.col("first") <= F.size(lines)).select("scope_id", "path", "first", F.array_join(F.slice(lines, F.col("first"), F.col("last") - F.col("first") + 1), "\n").alias("text"))
