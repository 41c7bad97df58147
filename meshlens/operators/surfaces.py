"""Matching consumers' calls with providers' routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.functions import paths as P


def route_verbs(routes: DataFrame) -> DataFrame:
    """(repo, path, verbs): the verbs that a repository serves a normalized path with."""
    verb = F.when(F.coalesce("method", F.lit("")) == "", "ANY").otherwise(F.upper("method"))
    return routes.groupBy("repo", P.normalize_path(F.col("path")).alias("path")).agg(F.array_sort(F.collect_set(verb)).alias("verbs"))


def _suffixes(path: str) -> Column:
    """All segment suffixes of a normalized path, itself first: /a/b -> /a/b, /b."""
    parts = F.split(F.substr(F.col(path), F.lit(2)), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))


def match_surfaces(surfaces: DataFrame, routes: DataFrame) -> DataFrame:
    """surfaces (id, repo, method, path, ...) with match_kind: exact, prefix or none.

    Exact: the same normalized path and a compatible verb. Prefix: one path is a suffix of the other at a
    segment boundary, neither of them /. The suffixes of either side are exploded, so both directions are equi-joins
    on (repo, path), not a comparison of all paths of a repository."""
    served = route_verbs(routes).where("path <> '/'")
    verb = F.upper(F.when(F.coalesce("method", F.lit("")) == "", "ANY").otherwise(F.col("method")))
    asked = surfaces.select("id", "repo", verb.alias("verb"), P.normalize_path(F.col("path")).alias("asked"))
    fits = (F.col("verb") == "ANY") | F.array_contains("verbs", "ANY") | F.array_contains(F.col("verbs"), F.col("verb"))
    exact = asked.join(route_verbs(routes).withColumnRenamed("path", "asked"), ["repo", "asked"]).where(fits).select("id", F.lit(2).alias("kind"))
    open_ = asked.where("asked <> '/'").join(exact, "id", "left_anti")
    shorter = open_.withColumn("path", F.explode(_suffixes("asked"))).join(served, ["repo", "path"]).where(fits).select("id", F.lit(1).alias("kind"))
    tails = served.withColumn("asked", F.explode(_suffixes("path")))
    longer = open_.join(tails.drop("path"), ["repo", "asked"]).where(fits).select("id", F.lit(1).alias("kind"))
    kinds = exact.union(shorter).union(longer).groupBy("id").agg(F.max("kind").alias("kind"))
    return surfaces.join(kinds, "id", "left").withColumn("match_kind", F.when(F.col("kind") == 2, "exact").when(F.col("kind") == 1, "prefix").otherwise("none")).drop("kind")


def match_stats(matched: DataFrame) -> DataFrame:
    kind = F.col("match_kind")
    return matched.agg(F.count("*").alias("total"), F.count_if(kind != "none").alias("matched"), F.count_if(kind == "prefix").alias("prefix"), F.count_if(kind == "none").alias("unmatched"))


def provides(routes: DataFrame) -> DataFrame:
    return routes.select("repo", "method", P.normalize_path(F.col("path")).alias("path"), "framework", P.basename(F.col("file")).alias("file"), "line")


def consumes(matched: DataFrame) -> DataFrame:
    return matched.select("from_repo", F.col("repo").alias("target"), F.coalesce("method", F.lit("ANY")).alias("method"), P.normalize_path(F.col("path")).alias("path"), P.endpoint_key(F.col("method"), F.col("path")).alias("key"), (F.col("match_kind") != "none").alias("matched"), "match_kind")


def consumed_routes(routes: DataFrame, matched: DataFrame) -> DataFrame:
    """Routes with consumed: whether a matched consumer has exactly their key. A consumer that matched by prefix has another key."""
    used = matched.where("match_kind <> 'none'").select("repo", P.endpoint_key(F.col("method"), F.col("path")).alias("key")).distinct().withColumn("used", F.lit(True))
    keyed = routes.select("repo", P.endpoint_key(F.col("method"), F.col("path")).alias("key")).distinct()
    return keyed.join(used, ["repo", "key"], "left").select("repo", "key", F.col("used").isNotNull().alias("consumed"))


def called_by(matched: DataFrame) -> DataFrame:
    """(repo, method, path, callers): who calls an endpoint."""
    return matched.groupBy("repo", F.coalesce("method", F.lit("ANY")).alias("method"), P.normalize_path(F.col("path")).alias("path")).agg(F.array_sort(F.collect_set("from_repo")).alias("callers"))


def fold_base_paths(routes: DataFrame, bases: DataFrame) -> DataFrame:
    """routes with their framework's base prefix (framework, base, and repo where it differs between them) put before the path."""
    joined = routes.join(bases, ["repo", "framework"] if "repo" in bases.columns else ["framework"], "left")
    folded = P.normalize_path(F.concat_ws("/", F.col("base"), F.ltrim(F.col("path"), F.lit("/"))))
    return joined.withColumn("path", F.when(F.coalesce("base", F.lit("/")).isin("", "/"), F.col("path")).otherwise(folded)).drop("base")
