"""Configuration files: properties as Columns, YAML, JSON and TOML by table functions."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.functions.predicates import is_namespace_noise, looks_like_http_target
from meshlens.operators.resolve import first_per

#: Kinds of configuration files in the order in which they are read.
GLOBS = (r"^application.*\.properties\z", r"^application.*\.yml\z", r"^application.*\.yaml\z", r"^bootstrap.*\.yml\z", r"^bootstrap.*\.yaml\z", r"^\.env\z", r"^\.env\.")
PROPERTY = r"^([\w.\-/${}]+)\s*[=:]\s*(.+)$"


def property_of(line: Column) -> Column:
    """struct(key, value) of a line of a properties or .env file; null for comments and other lines."""
    t = F.trim(line)
    return F.when(~t.rlike("^[#!]") & t.rlike(PROPERTY), F.struct(F.regexp_extract(t, PROPERTY, 1).alias("key"), F.trim(F.regexp_extract(t, PROPERTY, 2)).alias("value")))


def properties(files: DataFrame) -> DataFrame:
    """files (repo, path, content) -> (repo, path, key, value, line)."""
    lines = files.select("repo", "path", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "text"))
    p = property_of(F.col("text"))
    return lines.select("repo", "path", p["key"].alias("key"), p["value"].alias("value"), (F.col("pos") + 1).alias("line")).where("key is not null")


def targets(files: DataFrame) -> DataFrame:
    """files (repo, path, content) of configurations -> (repo, path, line, target): HTTP targets, of a repository the first
    one of each by kind of file, path and line."""
    name, yaml = F.regexp_extract("path", r"([^/]*)\z", 1), F.col("path").rlike(r"\.ya?ml\z")
    plain = properties(files.where(~yaml)).withColumn("value", F.regexp_replace("value", r"""^["']+|["']+$""", ""))
    rows = plain.unionByName(yaml_properties(files.where(yaml))).where(looks_like_http_target(F.col("key"), F.col("value")))
    rows = rows.withColumn("target", F.when(F.col("value").contains("://"), F.col("value")).otherwise(F.concat(F.lit("http://"), "value"))).where(~is_namespace_noise(F.col("target")))
    rank = F.lit(len(GLOBS))
    for i, pattern in reversed(list(enumerate(GLOBS))):
        rank = F.when(name.rlike(pattern), i).otherwise(rank)
    return first_per(rows.withColumn("glob", rank), ["repo", "target"], "glob", "path", "line").select("repo", "path", "line", "target")


def yaml_properties(files: DataFrame) -> DataFrame:
    """files (repo, path, content) -> (repo, path, key, value, line 0): string scalars under dotted keys, lists under their
    parent's key. A syntax error ends the file, what came before it stays."""

    def flat(prefix: str, node) -> Iterator[tuple[str, str]]:
        if isinstance(node, dict):
            for k, v in node.items():
                yield from flat(f"{prefix}.{k}" if prefix else str(k), v)
        elif isinstance(node, list):
            for v in node:
                yield from flat(prefix, v)
        elif isinstance(node, str):
            yield prefix, node

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for frame in frames:
            out = []
            for repo, path, content in zip(frame["repo"], frame["path"], frame["content"]):
                try:
                    for doc in yaml.safe_load_all(content or ""):
                        out += [(repo, path, k, v, 0) for k, v in flat("", doc)]
                except yaml.YAMLError:
                    pass
            yield pd.DataFrame(out, columns=["repo", "path", "key", "value", "line"])

    return files.select("repo", "path", "content").mapInPandas(run, "repo string, path string, key string, value string, line int")


def documents(files: DataFrame) -> DataFrame:
    """files (repo, path, content) of YAML, JSON and TOML by their endings -> (repo, path, whole, bodies): the documents of a
    file as JSON, in order. Where a document can't be read, whole is false and bodies holds those before it.

    Dates and other values that JSON doesn't have are text; null content is an empty file, which as YAML has no document."""

    def each(path: str, content: str) -> Iterator:
        import yaml

        if path.endswith(".json"):
            yield json.loads(content)
        elif path.endswith(".toml"):
            yield tomllib.loads(content)
        else:
            yield from yaml.safe_load_all(content)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                bodies, whole = [], True
                try:
                    for body in each(path, content or ""):
                        bodies.append(json.dumps(body, default=str, skipkeys=True))
                except (yaml.YAMLError, ValueError, RecursionError):  # a value that holds itself is a ValueError, too
                    whole = False
                out.append((whole, bodies))
            yield pd.DataFrame({"repo": frame["repo"], "path": frame["path"], "whole": [w for w, _ in out], "bodies": [b for _, b in out]})

    return files.select("repo", "path", "content").mapInPandas(run, "repo string, path string, whole boolean, bodies array<string>")


def text_at(document: Column, path: str) -> Column:
    """The string at a path of a variant; null for numbers, other values, and where nothing is."""
    return F.when(F.schema_of_variant(F.try_variant_get(document, path, "variant")) == "STRING", F.try_variant_get(document, path, "string"))
