"""Classifiers of paths, columns, names and tables as column expressions over stated rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zones by path in lower case, per language, in the order in which they are tried.
ZONE_RULES: dict[str, list[tuple[str, str]]] = {
    "py": [
        ("test", r"(^|/)tests?/|(^|/)test_[^/]+\.py$|_test\.py$|(^|/)conftest\.py$"),
        ("data", r"(^|/)(models|model|schema|schemas|database|db|crud|repository|entities)\.py$|(^|/)(migrations?|alembic|models?|schemas?|db)/"),
        ("api", r"(^|/)(views|urls|routes|router|routers|api|main|app|server|serializers|endpoints|handlers)\.py$|(^|/)(api|routers?|views?|endpoints?)/"),
        ("ui", r"(^|/)(templates?|static)/"),
        ("config", r"(^|/)(settings|conf|config|setup|asgi|wsgi|manage|__init__)\.py$|[/_]config\.py$"),
    ],
    "go": [
        ("test", r"_test\.go$|(^|/)testdata/|(^|/)tests?/"),
        ("data", r"(^|/)(models|model|schema|store|db|database|repository|queries)\.go$|(^|/)(migrations?|models?|store|storage|repositor(y|ies)|db|database|ent)/"),
        ("api", r"(^|/)(handler|handlers|router|routes|server|api|middleware)\.go$|(^|/)(api|handlers?|routes?|controllers?|server|transport|rpc)/"),
        ("ui", r"(^|/)(templates?|static|web|views?)/"),
        ("config", r"(^|/)(config|settings|options|env|doc)\.go$"),
    ],
    "rs": [
        ("test", r"(^|/)tests?/|(^|/)benches/|_test\.rs$"),
        ("data", r"(^|/)(schema|models|model|db|database|store|repository|queries|entities)\.rs$|(^|/)(migrations?|models?|entities|db|database|store|repositor(y|ies))/"),
        ("api", r"(^|/)(routes|router|handlers|handler|server|api|commands|middleware)\.rs$|(^|/)(api|routes?|handlers?|controllers?|server|commands?|rpc)/"),
        ("ui", r"(^|/)(templates?|static|views?|ui)/"),
        ("config", r"(^|/)(build|config|settings|options)\.rs$"),
    ],
    "ipynb": [("data", r"(^|/)(prisma|drizzle|migrations?|db|database|models?|entities|repositor(y|ies)|schemas?|seeds?)/")],
    "": [
        ("test", r"(^|/)__tests__/|(^|/)tests?/|\.(test|spec)\.[cm]?[jt]sx?$"),
        ("config", r"\.config\.[cm]?[jt]s$"),
        ("data", r"(^|/)(prisma|drizzle|migrations?|db|database|models?|entities|repositor(y|ies)|schemas?|seeds?)/"),
        ("api", r"(^|/)(route|middleware|server)\.(ts|js)$|(^|/)(api|routes?|server|trpc|controllers?|handlers?|endpoints?|functions|actions)/"),
        ("ui", r"\.(tsx|jsx|css|scss)$|(^|/)(components?|ui|views?|screens?|pages?|layouts?|styles?|app)/"),
    ],
}
_FAMILY = {"py": "py", "pyi": "py", "go": "go", "rs": "rs", "ipynb": "ipynb"}

# What column names mean, in the order in which they are tried.
DIRECT = [
    ("contact", r"(e_?mail|email)(_?address(es)?)?|emails"), ("government-id", r"ssn|social_security(_number)?"), ("government-id", r"national_id(_number)?|nino|tax_id(_number)?|tin"),
    ("government-id", r"passport(_(number|no|num))?"), ("government-id", r"driver'?s?_licen[cs]e(_number)?"), ("date-of-birth", r"dob|date_of_birth|birth_?date|birthday"),
    ("person-name", r"(first|last|given|family|middle)_names?"), ("person-name", r"surname|forename|maiden_name"), ("contact", r"(phone|mobile|telephone|cell)(_?(number|no))?"),
    ("financial", r"(credit_card|card)_(number|no|num)"), ("financial", r"cvv|cvc|card_security_code"), ("financial", r"iban|bic|swift_?code|sort_code|routing_number"), ("financial", r"bank_account(_number)?"),
    ("credential", r"password|passwd|pwd|password_hash|hashed_password|password_digest"), ("credential", r"mfa_secret|totp_secret|two_factor_secret|recovery_codes?"),
    ("device", r"ip|ip_address|ip_addr|remote_addr|client_ip"), ("device", r"mac_address|imei|device_id|advertising_id|idfa"),
    ("location", r"street_address|postal_address|home_address|billing_address|shipping_address"), ("health", r"diagnosis|medical_record(_number)?|blood_type|nhs_number"),
]
AMBIGUOUS = [
    ("person-name", r"name|full_name|display_name|user_?name|nick_?name|screen_?name"), ("location", r"address|addr"), ("location", r"city|town|postcode|postal_code|zip|zip_code|county|country|region"),
    ("location", r"lat|latitude|lng|lon|longitude|geo|coordinates"), ("financial", r"account_number|customer_(id|number|reference)"), ("government-id", r"licen[cs]e_number|id_number"),
    ("person-name", r"age|gender|sex|ethnicity|nationality|marital_status"), ("device", r"user_agent|fingerprint"), ("contact", r"contact|contact_details|emergency_contact"),
]
NOT_A_PERSON = (
    "file table column field class schema index tag brand product event type role method package service bucket queue topic job step node key image icon theme locale currency host domain app repo branch project org"
    " organization organisation team company store variant category folder directory template plan tier status model variable env server cluster container volume network route action command script module function"
    " group label channel workspace tenant site page menu item sku unit metric wallet contract token chain block bus memory device display"
).split()
PARKED = r"(?i)^(_archived?|_old|_deprecated|_legacy|_unused|_bak|_backup|_graveyard|_parked|_attic|parked|graveyard|attic|deprecated)$"
CATALOGS = ["information_schema", "pg_catalog", "pg_toast", "performance_schema", "mysql", "sys", "sysibm"]
DICTIONARY = (
    "all_tables all_tab_columns all_objects all_constraints all_indexes all_views all_triggers all_sequences all_users user_tables user_tab_columns user_objects user_constraints user_indexes user_views user_triggers"
    " user_sequences dba_tables dba_tab_columns dba_objects dba_constraints dba_indexes dba_views dba_users dba_triggers"
).split()


def zone_of(path: Column) -> Column:
    """test, data, api, ui, config or logic by the path alone; the rules differ by extension. Null for a null path."""
    low = F.lower(path)
    extension = F.regexp_extract(low, r"\.([a-z0-9]+)$", 1)

    def rules(family: str) -> Column:
        return F.coalesce(*(F.when(low.rlike(pattern), zone) for zone, pattern in ZONE_RULES[family]), F.lit("logic"))

    chosen = rules("")
    for end, family in _FAMILY.items():
        chosen = F.when(extension == end, rules(family)).otherwise(chosen)
    return F.when(path.isNotNull(), chosen)


def zone_sql(path: str) -> str:
    """The same rules as an expression of SQL."""
    case = lambda f: "CASE " + " ".join(f"WHEN regexp_matches(lower({path}), '{p}') THEN '{z}'" for z, p in ZONE_RULES[f]) + " ELSE 'logic' END"
    return f"CASE WHEN {path} IS NULL THEN NULL " + " ".join(f"WHEN regexp_matches(lower({path}), '\\.{e}$') THEN {case(f)}" for e, f in _FAMILY.items()) + f" ELSE {case('')} END"


def snake(name: Column) -> Column:
    """A column's name in one spelling: words in lower case between single underscores."""
    split = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), r"[\s.\-]+", "_"), "_+", "_")
    return F.lower(F.regexp_replace(split, "^_|_$", ""))


def personal_column(name: Column) -> Column:
    """struct(category, strength) of what a column's name points at, direct or ambiguous; null if nothing.

    The name is tried, then what follows its first word, and so on: a direct phrase wins wherever it stands; a technical
    first word or an ambiguous phrase ends the search, and the latter counts for the whole name alone.
    """
    part = F.split(snake(name), "_")

    def judge(k: Column) -> Column:
        rest = F.slice(part, k + 1, F.size(part))
        tail = F.array_join(rest, "_")
        found = lambda rules, strength: [F.when(tail.rlike(f"^({p})$"), F.struct(F.lit(c).alias("category"), F.lit(strength).alias("strength"))) for c, p in rules]
        nothing = F.struct(F.lit(None).cast("string").alias("category"), F.lit("none").alias("strength"))
        ambiguous = F.coalesce(*found(AMBIGUOUS, "ambiguous"))
        stop = (F.size(rest) > 1) & F.element_at(rest, 1).isin(NOT_A_PERSON)
        return F.coalesce(*found(DIRECT, "direct"), F.when(stop, nothing), F.when(ambiguous.isNotNull(), F.when(k == 0, ambiguous).otherwise(nothing)))

    first = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.size(part) - 1), judge), lambda x: x.isNotNull()), F.lit(0))
    return F.when(name.isNotNull() & (snake(name) != "") & (first["strength"] != "none"), first)


def is_relation(type_name: Column, known: Column) -> Column:
    """Whether a field's type, without list marks and one wrapper, is among the names (an array in lower case)."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(type_name, r"[\[\]?!\s]", ""), "^(Array|List|list|Optional|Mapped)<", ""), ">$", "")
    return (bare != "") & F.array_contains(known, F.lower(bare))


def retirement(path: Column, zone: Column, summary: Column) -> Column:
    """struct(evidence, says) of a file that declares itself retired, by a folder of its path or by its own first line; null
    for others and for tests."""
    segment = F.get(F.filter(F.split(path, "/"), lambda s: s.rlike(PARKED)), F.lit(0))
    opening = F.trim(F.regexp_replace(F.regexp_extract(summary, r"(?m)^[ \t]*(\S.*?)\r?$", 1), r"^[\s*#/\-]+", ""))
    opens = opening.rlike(r"(?i)^(deprecated|obsolete|retired|superseded|do not use)\b")
    tagged = summary.rlike(r"(?i)(^|\s)@deprecated\b")
    said = F.when(opens, F.substring(opening, 1, 160)).when(tagged, "@deprecated")
    return F.when(F.coalesce(zone, F.lit("")) != "test", F.when(segment.isNotNull(), F.struct(F.lit("path").alias("evidence"), segment.alias("says"))).when(said.isNotNull(), F.struct(F.lit("docstring").alias("evidence"), said.alias("says"))))


def route_segment(segment: Column) -> Column:
    """A folder's part of a route: groups and slots have none (null), [x] is :x and [...x] is *."""
    return (
        F.when((segment == "") | (segment.startswith("(") & segment.endswith(")")) | segment.startswith("@"), None)
        .when(segment.rlike(r"^\[\[?\.\.\..+?\]?\]$"), "*")
        .when(segment.rlike(r"^\[.+\]$"), F.concat(F.lit(":"), F.regexp_extract(segment, r"^\[(.+)\]$", 1)))
        .otherwise(segment)
    )


def file_route(rest: Column, whole_file: bool = False) -> Column:
    """The route of a file below a routes folder: of its folders, or with ``whole_file`` of its name too, where index is none."""
    bare = F.regexp_replace(F.regexp_replace(rest, r"\.[cm]?[jt]sx?$", ""), r"(^|/)index$", "") if whole_file else F.regexp_replace(rest, r"(^|/)[^/]*$", "")
    parts = F.filter(F.transform(F.split(bare, "/"), route_segment), lambda s: s.isNotNull())
    return F.when(rest.isNotNull(), F.concat(F.lit("/"), F.array_join(parts, "/")))


def matcher_regex(matcher: Column) -> Column:
    """A route matcher as an anchored regular expression: ``/:x*`` is anything below, ``:x`` one segment, ``*`` anything."""
    tail = F.regexp_replace(F.regexp_replace(matcher, r"/:\w+\*", "(?:/.~)?"), r"/:\w+\+", "/.~")  # ~ keeps stars made here from the last step
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, r":\w+", "[^/]+"), r"(?<![.\])])\*", ".*"), "~", "*"), F.lit("$"))


def resolve_specifier(specifier: Column, from_path: Column) -> Column:
    """The path that an import names, without extension: relative ones folded, @/, ~/ and # taken from the top; else null."""
    base = F.slice(F.split(from_path, "/"), F.lit(1), F.size(F.split(from_path, "/")) - 1)
    step = lambda acc, s: F.when(s.isin(".", ""), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s))
    relative = F.array_join(F.aggregate(F.split(specifier, "/"), base, step), "/")
    named = F.when(specifier.startswith("./") | specifier.startswith("../"), relative).when(specifier.rlike("^[@~]/"), F.substr(specifier, F.lit(3))).when(specifier.startswith("#"), F.substr(specifier, F.lit(2)))
    return F.regexp_replace(named, r"\.[cm]?[jt]sx?$", "")


def catalog_of(table: Column) -> Column:
    """The catalogue that a table belongs to (of a database itself); null for tables of an application."""
    part = F.transform(F.split(F.lower(table), r"\."), lambda s: F.regexp_replace(F.trim(s), r"[\"`\[\]]", ""))
    name, schema = F.element_at(part, -1), F.when(F.size(part) > 1, F.get(part, F.size(part) - 2))
    return F.when(schema.isin(CATALOGS), schema).when(name.startswith("pg_"), "pg_catalog").when(name.startswith("sqlite_"), "sqlite").when(name.isin(DICTIONARY), "oracle dictionary")


def sends_data(call: Column, category: Column) -> Column:
    """Whether a call sends data, by its last name or by what the service is for."""
    last = F.substring_index(call, ".", -1)
    return F.coalesce(last.rlike("(?i)^(send|create|post|upload|track|capture|identify|charge|publish|emit|log)"), F.lit(False)) | F.coalesce(category.isin("email", "sms", "analytics", "payments"), F.lit(False))


def door_label(method: Column, route: Column, name: Column) -> Column:
    """``METHOD route``, else the route, else the name."""
    return F.coalesce(F.when(F.coalesce(route, F.lit("")) != "", F.concat_ws(" ", F.when(method != "", method), route)), name)


def arrow_kind(kinds: Column) -> Column:
    """both, reads, writes or uses, of an array of edge kinds."""
    reads, writes = F.array_contains(kinds, "reads-from"), F.array_contains(kinds, "writes-to")
    return F.when(reads & writes, "both").when(reads, "reads").when(writes, "writes").otherwise("uses")


def edge_label(kinds: Column, weight: Column) -> Column:
    """The number on an arrow with what it counts."""
    one = weight == 1
    noun = (
        F.when(arrow_kind(kinds) == "reads", F.when(one, "read").otherwise("reads")).when(arrow_kind(kinds) == "writes", F.when(one, "write").otherwise("writes"))
        .when(arrow_kind(kinds) == "both", F.when(one, "query").otherwise("queries")).when((F.size(kinds) == 1) & (F.get(kinds, F.lit(0)) == "imports"), F.when(one, "import").otherwise("imports"))
        .otherwise(F.when(one, "use").otherwise("uses"))
    )
    return F.concat_ws(" ", weight.cast("string"), noun)


def count_of(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many or one + "s"))


def listed(items: Column) -> Column:
    """a, b and c; empty and null items are left out."""
    kept = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    n = F.size(kept)
    return F.when(n <= 1, F.array_join(kept, "")).otherwise(F.concat(F.array_join(F.slice(kept, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(kept, -1)))


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def is_built_adapter(path: Column) -> Column:
    """Whether an entry point lies in a folder that a build writes."""
    return path.rlike(r"(^|/)(\.open-next|\.svelte-kit|\.next|\.output|\.vercel|dist|build|out)/")


def node_id(kind: Column, path: Column, name: Column) -> Column:
    """The id of a node by its kind: of modules and files by path, of functions and types by path and name, else by name."""
    return (
        F.when(kind == "module", F.concat(F.lit("module:"), F.when(path == "", ".").otherwise(path))).when(kind == "file", F.concat(F.lit("file:"), path))
        .when(kind == "function", F.concat(F.lit("func:"), path, F.lit("#"), name)).when(kind == "type", F.concat(F.lit("type:"), path, F.lit("#"), name))
        .when(kind.isin("service", "store"), F.concat(kind, F.lit(":"), F.lower(name))).otherwise(F.concat(kind, F.lit(":"), name))
    )
