"""Endpoint paths as Columns: the keys that consumers and providers are matched on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of a bound path segment in the frameworks' syntaxes.
PARAM_SEGMENT = r"^(?:\{[^}]*\}|:[A-Za-z_][\w-]*|\$\{[^}]*\}|<[^>]*>|\d+|[0-9a-fA-F-]{16,})\z"
HOLE = r"\$?\{[^}]*\}"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_path(path: Column) -> Column:
    """/v1/Orders/:id?x=1 -> /v1/orders/{}; null and empty -> /."""
    bare = F.regexp_replace(text(path), r"(?i)^[a-z]+://[^/]+", "")
    bare = F.substring_index(F.substring_index(bare, "?", 1), "#", 1)
    parts = F.filter(F.split(bare, "/"), lambda s: s != "")
    folded = F.transform(parts, lambda s: F.when(s.rlike(PARAM_SEGMENT) | s.rlike(HOLE), F.lit("{}")).otherwise(F.lower(s)))
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def endpoint_key(method: Column, path: Column) -> Column:
    verb = F.when(text(method) == "", F.lit("ANY")).otherwise(method)
    return F.concat_ws(" ", F.upper(F.trim(verb)), normalize_path(path))


def split_host_path(url: Column) -> Column:
    """struct(host, path) of a call's target."""
    u = text(url)
    env, scheme, hole = r"^\$ENV:([^/]+)(/.*)?$", r"(?i)^[a-z]+://([^/]+)(/.*)?$", r"^\$?\{[^}]*\}(/.*)?$"
    head = F.substring_index(u, "/", 1)
    rest = F.when(F.instr(u, "/") > 0, F.substr(u, F.instr(u, "/"))).otherwise(F.lit("/"))
    or_root = lambda c: F.when(c == "", F.lit("/")).otherwise(c)
    pair = lambda host, path: F.struct(host.alias("host"), path.alias("path"))
    return (
        F.when(u.rlike(env), pair(F.regexp_extract(u, env, 1), or_root(F.regexp_extract(u, env, 2))))
        .when(u.rlike(scheme), pair(F.regexp_extract(u, scheme, 1), or_root(F.regexp_extract(u, scheme, 2))))
        .when(u.rlike(hole), pair(F.lit(""), or_root(F.regexp_extract(u, hole, 1))))
        .when(u.startswith("/"), pair(F.lit(""), u))
        .when(head.contains(".") | head.contains(":"), pair(head, rest))
        .otherwise(pair(F.lit(""), F.concat(F.lit("/"), u)))
    )


def join_prefix(a: Column, b: Column) -> Column:
    """Two path prefixes with one slash between them."""
    left, right = F.rtrim(F.trim(text(a)), F.lit("/")), F.trim(text(b))
    return F.concat(left, F.when((right != "") & ~right.startswith("/"), F.concat(F.lit("/"), right)).otherwise(right))


def basename(path: Column) -> Column:
    return F.substring_index(F.translate(text(path), "\\", "/"), "/", -1)


def evidence(ref: Column) -> Column:
    """struct(file, line) of a file:line reference; what isn't one has line 0."""
    line = F.regexp_extract(ref, r":(\d+)$", 1)
    return F.struct(
        F.when(line != "", F.regexp_extract(ref, r"^(.*):\d+$", 1)).otherwise(ref).alias("file"),
        F.when(line != "", line.cast("int")).otherwise(F.lit(0)).alias("line"),
    )
