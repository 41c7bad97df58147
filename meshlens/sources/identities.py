"""What repositories call themselves, and the base paths that their configuration declares."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.functions import identity as I
from meshlens.functions import paths as P
from meshlens.functions.predicates import resolve_placeholder
from meshlens.operators.resolve import first_per
from meshlens.sources.configs import documents, properties, text_at, yaml_properties

# Files that declare a name, in the order in which they count.
SPRING_FILES = ("src/main/resources/application.yml", "src/main/resources/application.yaml", "application.yml", "application.yaml")
SPRING_PROPERTIES = "src/main/resources/application.properties"
OPENAPI_FILES = ("openapi.yaml", "openapi.yml", "openapi.json", "swagger.yaml", "swagger.json")

# Base configuration files in order, the keys of each role, and the folders that are skipped.
BASE_FILES = ("application.properties", "application.yml", "application.yaml", "bootstrap.properties", "bootstrap.yml", "bootstrap.yaml")
CONTEXT_KEYS = ("server.servlet.context-path", "server.context-path")
INNER_KEYS = ("spring.mvc.servlet.path", "spring.webflux.base-path")


def identities(repos: DataFrame, files: DataFrame) -> DataFrame:
    """repos (name), files (repo, path, content) -> aliases (repo, alias, raw, source, confidence, ord).

    Declared names of package files, Spring, Kubernetes services, OpenAPI and the git remote, with the repository's own
    name; of equal aliases the most confident one stays, then the first in this order. Documents are read as such: a
    name that isn't a string is none, and a broken file counts up to where it breaks for Kubernetes, and not at all
    elsewhere. Spring's name is that of the first YAML file of one document that has one, else that of its properties;
    OpenAPI's are those of the first file that can be read. The remote is read from the checkout's config file."""
    c, at = F.col("content"), F.col("path")
    line = lambda pattern: F.regexp_extract(c, pattern, 1)
    last = lambda x: F.regexp_extract(x, r"([^/]*)/*\z", 1)
    fact = lambda raw, source, confidence, ord, place=F.lit(0): (F.col("repo"), raw.alias("raw"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), F.lit(ord).alias("ord"), F.col("path"), place.alias("place"))

    service = at.rlike(r"\.ya?ml\z") & ~at.rlike(r"(?:^|/)(?:node_modules|\.git|vendor)/") & c.rlike("kind: ?Service")
    # each file is read for one kind of fact only, so none is parsed twice
    one = lambda *paths: documents(files.where(at.isin(*paths))).where("whole and size(bodies) <= 1").withColumn("body", F.try_parse_json(F.get("bodies", F.lit(0))))
    name = text_at(F.col("body"), "$.name")
    parts = [
        repos.select(F.col("name").alias("repo"), F.col("name").alias("raw"), F.lit("config").alias("source"), F.lit(1.0).alias("confidence"), F.lit(0).alias("ord"), F.lit("").alias("path"), F.lit(0).alias("place")),
        one("package.json").select(*fact(F.substring_index(name, "/", -1), "package", 0.9, 1)),
        one("pyproject.toml").select(*fact(text_at(F.col("body"), "$.project.name"), "package", 0.9, 2)),
        files.where(at == "go.mod").select(*fact(last(line(r"(?m)^module\s+(\S+)")), "go", 0.9, 3)),
    ]
    rank = F.array_position(F.array(*[F.lit(n) for n in (*SPRING_FILES, SPRING_PROPERTIES)]), at).cast("int")
    spring = one(*SPRING_FILES).select(*fact(text_at(F.col("body"), "$.spring.application.name"), "spring", 0.95, 4, rank))
    plain = files.where(at == SPRING_PROPERTIES).select(*fact(line(r"spring\.application\.name\s*=\s*(\S+)"), "spring", 0.95, 4, rank))
    parts.append(first_per(spring.union(plain).where("raw <> ''"), ["repo"], "place"))
    docs = documents(files.where(service)).select("repo", "path", F.posexplode("bodies").alias("place", "text")).withColumn("body", F.try_parse_json("text"))
    kept = docs.where(text_at(F.col("body"), "$.kind") == "Service")
    parts.append(kept.select(*fact(text_at(F.col("body"), "$.metadata.name"), "k8s", 0.9, 5, F.col("place"))))
    rank = F.array_position(F.array(*[F.lit(n) for n in OPENAPI_FILES]), at)
    api = first_per(one(*OPENAPI_FILES).select("repo", "path", "body", rank.alias("rank")), ["repo"], "rank")
    stated = lambda raw, confidence, ord: F.struct(raw.alias("raw"), F.lit("openapi").alias("source"), F.lit(confidence).alias("confidence"), F.lit(ord).alias("ord"))
    servers = F.transform(F.try_variant_get("body", "$.servers", "array<variant>"), lambda server: stated(text_at(server, "$.url"), 0.85, 7))
    facts = F.flatten(F.array_compact(F.array(F.array(stated(text_at(F.col("body"), "$.info.title"), 0.7, 6)), F.filter(servers, lambda x: x["raw"].contains("://")))))
    parts.append(api.select("repo", "path", F.posexplode(facts).alias("place", "fact")).select("repo", "fact.*", "path", "place"))
    parts.append(files.where(at == ".git/config").select(*fact(last(F.regexp_replace(line(r"(?m)^\s*url\s*=\s*(\S+)"), r"\.git\z", "")), "git", 0.85, 8)))
    rows = functools.reduce(DataFrame.unionByName, parts).withColumn("alias", I.normalize_identity(F.col("raw"))).where("alias <> ''")
    return first_per(rows, ["repo", "alias"], F.desc("confidence"), "ord", "path", "place", "raw").select("repo", "alias", "raw", "source", "confidence", "ord")


def base_paths(files: DataFrame) -> DataFrame:
    """files (repo, path, content) -> (repo, framework, base): the prefix that Spring's configuration puts before all routes.

    The first definition of a key wins, by file kind and path; a key that is there but can't be resolved gives no
    prefix and ends the search within its role."""
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    kept = files.where(name.isin(*BASE_FILES) & ~F.col("path").rlike(r"(?:^|/)(?:node_modules|\.git|vendor|target|build|dist|\.venv|venv)/"))
    rank = F.array_position(F.array(*[F.lit(n) for n in BASE_FILES]), name)
    pairs = properties(kept.where(name.endswith(".properties"))).unionByName(yaml_properties(kept.where(~name.endswith(".properties"))))
    first = first_per(pairs.withColumn("rank", rank), ["repo", "key"], "rank", "path", "line")
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    keys = (*CONTEXT_KEYS, *INNER_KEYS)
    wide = first.where(F.col("key").isin(*keys)).groupBy("repo").agg(*[value(k).alias(f"k{i}") for i, k in enumerate(keys)])
    context = resolve_placeholder(F.coalesce("k0", "k1"))
    servlet, flux = resolve_placeholder(F.col("k2")), resolve_placeholder(F.col("k3"))
    joined = P.join_prefix(context, F.when(servlet != "", servlet).otherwise(flux))
    based = wide.select("repo", F.when(joined == "", "/").otherwise(P.normalize_path(joined)).alias("base")).where("base <> '/'")
    return based.select("repo", F.explode(F.array(F.lit("spring"), F.lit("jaxrs"))).alias("framework"), "base")
