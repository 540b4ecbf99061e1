"""Scalar functions of text, paths, addresses and SQL as column expressions, all within code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of sha256 over a text with LF line ends and no spaces or tabs before them."""
    return F.substring(F.sha2(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"[ \t]+(?=\n|\z)", ""), 256), 1, 16)


def parts_hash(*parts: Column) -> Column:
    """The first 16 hex digits of sha256 over parts joined by NUL; a null part is an empty one."""
    return F.substring(F.sha2(F.concat_ws("\0", *(F.coalesce(p, F.lit("")) for p in parts)), 256), 1, 16)


def folder_of(path: Column) -> Column:
    """The path without its last segment; empty at the top."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.when(path.isNotNull(), ""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension_of(path: Column) -> Column:
    """The extension with its dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def module_of(path: Column) -> Column:
    """The path without its extension and without a last segment index or __init__."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), r"(^|/)(index|__init__)$", "")


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without user, password and port; null without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.when(host != "", host)


def is_internal(host: Column) -> Column:
    """Local names and addresses written as four numbers."""
    return (host == "localhost") | host.endswith(".local") | host.endswith(".internal") | host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")


def path_pattern(raw: Column) -> Column:
    """A path for comparison: no query or fragment, parameters as {}, lower case, no slash at the end."""
    bare = F.regexp_replace(raw, r"[?#].*$", "")
    named = F.regexp_replace(F.regexp_replace(bare, r"/(?::[^/]+|\{[^/}]*\}|\[[^/\]]*\]|<[^/>]*>)", "/{}"), r"/\d+(?=/|$)", "/{}")
    return F.lower(F.regexp_replace(named, r"(.)/+$", "$1"))


def first_sentence(text: Column, limit: int = 160) -> Column:
    """The text on one line up to and with its first end mark that a space or the end follows, at most ``limit`` characters;
    all of it without such a mark. No space at either end."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.rtrim(F.substring(F.coalesce(F.nullif(F.regexp_extract(flat, r"^(.*?[.!?])(?: |$)", 1), F.lit("")), flat), 1, limit))


def clip(text: Column, limit: int) -> Column:
    """One line of at most ``limit`` characters, the last an ellipsis if it was longer."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage; 0 of nothing."""
    return F.when(whole == 0, 0).otherwise(F.floor(part * 100 / whole + 0.5)).cast("int")


def sql_operation(sql: Column) -> Column:
    """read, write or null by the first verb of a statement, comments left out."""
    verb = F.lower(F.regexp_extract(F.regexp_replace(sql, r"(?s)/\*.*?\*/|--[^\n]*", " "), r"^\s*\(?\s*([A-Za-z]+)", 1))
    return F.when(verb.isin("select", "with"), "read").when(verb.isin("insert", "update", "delete", "replace", "create", "drop", "alter", "truncate"), "write")


def sql_table(sql: Column) -> Column:
    """The first table of a statement, without quotes and the schemas public, dbo and main; null if there is none."""
    bare = F.regexp_replace(sql, r"(?s)/\*.*?\*/|--[^\n]*", " ")
    name = F.regexp_extract(bare, r"(?i)\b(?:from|into|update|join|table(?:\s+if\s+(?:not\s+)?exists)?)\s+([\"`\[]?[A-Za-z_][\w.\"`\]\[]*)", 1)
    plain = F.regexp_replace(F.regexp_replace(name, r"[\"`\[\]]", ""), r"(?i)^(?:public|dbo|main)\.", "")
    return F.when(plain != "", plain)


def env_name_kind(name: Column) -> Column:
    """secret, public or plain: what the name of a variable promises."""
    return F.when(name.rlike(r"^(NEXT_PUBLIC|VITE|REACT_APP|PUBLIC|EXPO_PUBLIC|NUXT_PUBLIC)_"), "public").when(name.rlike(r"(?i)(secret|token|password|passwd|pwd|api_?key|private_?key|credential)"), "secret").otherwise("plain")
