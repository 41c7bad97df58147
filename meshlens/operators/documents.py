"""The nested dependency document of each repository: written by executors, read back, and held against its constraints."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.operators.checkpoints import written
from meshlens.operators.exports import _place

_SURFACE = "struct<channel:string,method:string,path:string,key:string,matched:boolean,match_kind:string,evidence:string>"
_DEPENDENCY = f"struct<`from`:string,`to`:string,types:array<string>,confidence:double,tier:string,evidence:array<struct<file:string,line:int,snippet:string>>,surfaces:array<{_SURFACE}>,metadata:map<string,string>>"
DOCUMENT = f"version string, scanned_at string, repo struct<name:string,path:string,primary_language:string>, dependencies array<{_DEPENDENCY}>, summary struct<total_deps:bigint,high_confidence:bigint,services_called:array<string>,services_calling_me:array<string>>"

# The document's fields, what kind each must be, which must be there, and the words that some may hold.
TYPES = ["import", "http", "soap", "feign", "grpc", "kafka", "rabbitmq", "db"]
TIERS = ["call-site", "config", "inferred", "import", ""]
RULES = {  # place: field, kind, must be there, words
    "": [("version", "string", True, None), ("scanned_at", "string", True, None), ("repo", "object", True, None), ("dependencies", "array", True, None), ("summary", "object", True, None)],
    "repo": [("name", "string", True, None), ("path", "string", True, None), ("primary_language", "string", False, None)],
    "summary": [("total_deps", "integer", False, None), ("high_confidence", "integer", False, None), ("services_called", "array", False, None), ("services_calling_me", "array", False, None)],
    "dependencies": [("from", "string", True, None), ("to", "string", True, None), ("types", "array", True, None), ("confidence", "number", True, None), ("evidence", "array", True, None), ("tier", "string", False, TIERS), ("surfaces", "array", False, None), ("metadata", "object", False, None)],
    "evidence": [("file", "string", False, None), ("line", "integer", False, None), ("snippet", "string", False, None)],
    "surfaces": [("channel", "string", False, None), ("method", "string", False, None), ("path", "string", False, None), ("key", "string", False, None), ("matched", "boolean", False, None), ("match_kind", "string", False, ["exact", "prefix", "none"]), ("evidence", "string", False, None)],
}
_KINDS = {"string": "^STRING", "integer": "^BIGINT", "number": "^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)", "array": "^ARRAY", "object": "^OBJECT", "boolean": "^BOOLEAN"}


def documents(deps: DataFrame, repos: DataFrame, scanned_at: str, surfaces: DataFrame | None = None) -> DataFrame:
    """deps (from_repo, to_repo, dep_types, confidence, evidence, tier [, ord]), repos (name, path), surfaces (from_repo, repo,
    method, path, key, match_kind, file, line) -> (repo, document): one JSON text a repository. Dependencies stand by ord, else by
    name; services_called are the first five of the graph's names by how often they are called: the targets, then the repository."""
    order = "ord" if "ord" in deps.columns else "to_repo"
    rows = deps.select("from_repo", "to_repo", "dep_types", "confidence", "tier", "evidence", F.col(order).alias("order"))
    none = F.array().cast(f"array<{_SURFACE}>")
    if surfaces is not None:
        seen = F.struct(F.lit("http").alias("channel"), "method", "path", "key", (F.col("match_kind") != "none").alias("matched"), "match_kind", F.concat_ws(":", F.substring_index("file", "/", -1), "line").alias("evidence"))
        by = surfaces.groupBy("from_repo", F.col("repo").alias("to_repo")).agg(F.array_sort(F.collect_set(seen)).alias("surfaces"))
        rows = rows.join(by, ["from_repo", "to_repo"], "left").withColumn("surfaces", F.coalesce("surfaces", none))
    else:
        rows = rows.withColumn("surfaces", none)
    one = F.struct(
        F.col("from_repo").alias("from"), F.col("to_repo").alias("to"), F.col("dep_types").alias("types"), "confidence", F.coalesce("tier", F.lit("")).alias("tier"),
        F.transform("evidence", _place).alias("evidence"), "surfaces",
    )
    grouped = rows.groupBy(F.col("from_repo").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "to_repo", one.alias("d")))), lambda s: s["d"].withField("metadata", F.create_map().cast("map<string,string>"))).alias("dependencies"))
    all_ = repos.select("name", "path").join(grouped, "name", "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast(f"array<{_DEPENDENCY}>")))
    called = F.when(F.size("dependencies") > 0, F.slice(F.concat(F.transform("dependencies", lambda d: d["to"]), F.array("name")), 1, 5)).otherwise(F.array().cast("array<string>"))
    summary = F.struct(F.size("dependencies").alias("total_deps"), F.size(F.filter("dependencies", lambda d: d["confidence"] >= 0.8)).alias("high_confidence"), called.alias("services_called"), F.array().cast("array<string>").alias("services_calling_me"))
    repo = F.struct("name", "path", F.lit("").alias("primary_language"))
    return all_.select(F.col("name").alias("repo"), F.to_json(F.struct(F.lit("1.0").alias("version"), F.lit(scanned_at).alias("scanned_at"), repo.alias("repo"), "dependencies", summary.alias("summary"))).alias("document"))


def interfaces_documents(manifest: DataFrame) -> DataFrame:
    """exports.interfaces' rows -> (repo, document): what each repository provides and consumes, as JSON."""
    own = F.create_map("repo", F.struct("provides", "consumes"))
    return manifest.select("repo", F.to_json(F.struct(F.lit("1.0").alias("version"), own.alias("repos"))).alias("document"))


def write_documents(docs: DataFrame, folder: str) -> None:
    """A folder for each repository that holds its document."""
    docs.select("document", "repo").repartition("repo").write.mode("overwrite").partitionBy("repo").text(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(repo, document) of written documents, whole texts."""
    return spark.read.option("wholetext", True).schema("value string, repo string").text(folder).select("repo", F.rtrim("value", F.lit("\n")).alias("document"))


def parsed(docs: DataFrame) -> DataFrame:
    """docs with doc, the document's fields, and corrupt, the text where it isn't one."""
    doc = F.from_json("document", DOCUMENT + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return docs.withColumn("doc", doc).withColumn("corrupt", F.col("doc._corrupt_record"))


def dependencies(docs: DataFrame) -> DataFrame:
    """The dependencies of parsed documents, in their order: what reading an export takes up."""
    rows = parsed(docs).where("corrupt is null").select(F.posexplode("doc.dependencies").alias("ord", "d"))
    text = F.transform("d.evidence", lambda e: F.when(e["line"] > 0, F.concat_ws(":", e["file"], e["line"])).otherwise(e["file"]))
    return rows.select(F.col("d.from").alias("from_repo"), F.col("d.to").alias("to_repo"), F.col("d.types").alias("dep_types"), "d.confidence", text.alias("evidence"), F.coalesce("d.tier", F.lit("")).alias("tier"), F.coalesce("d.surfaces", F.array().cast(f"array<{_SURFACE}>")).alias("surfaces"), F.col("ord").cast("long").alias("ord"))


def _problem(value: Column, kind: str, needed: bool, words: list[str] | None) -> Column:
    is_kind = F.schema_of_variant(value).rlike(_KINDS[kind])
    told = F.when(value.isNull(), F.lit("is missing") if needed else F.lit(None)).when(~is_kind, f"is not of kind {kind}")
    if words:
        told = told.when(~F.try_variant_get(value, "$", "string").isin(words), "is none of its words")
    return told


def _broken(rows: DataFrame, place: str) -> DataFrame:
    """(repo, path, rule) of rows (repo, path, v) whose fields break the place's rules."""
    problems = [F.struct(F.concat("path", F.lit(f".{name}")).alias("path"), _problem(F.try_variant_get("v", f"$.{name}", "variant"), kind, needed, words).alias("rule")) for name, kind, needed, words in RULES[place]]
    if place == "dependencies":
        c = F.try_variant_get("v", "$.confidence", "double")
        problems.append(F.struct(F.concat("path", F.lit(".confidence")).alias("path"), F.when((c < 0) | (c > 1), "is out of range").alias("rule")))
    return rows.where(F.schema_of_variant("v").rlike(_KINDS["object"])).select("repo", F.explode(F.filter(F.array(*problems), lambda p: p["rule"].isNotNull())).alias("p")).select("repo", "p.path", "p.rule")


def violations(docs: DataFrame) -> DataFrame:
    """docs (repo, document) -> (repo, path, rule): what breaks the document's constraints, by JSON path; $ where it isn't JSON.

    Each kind of constraint reads the documents, which are therefore written once instead of being made anew for each."""
    root = written(docs.select("repo", "document")).select("repo", F.lit("$").alias("path"), F.try_parse_json("document").alias("v"))
    under = lambda rows, name: rows.select("repo", F.concat("path", F.lit(f".{name}")).alias("path"), F.try_variant_get("v", f"$.{name}", "variant").alias("v")).where("v is not null")

    def each(rows: DataFrame, name: str) -> DataFrame:
        items = rows.select("repo", "path", F.posexplode(F.try_variant_get("v", f"$.{name}", "array<variant>")).alias("i", "v"))
        return items.select("repo", F.concat("path", F.lit(f".{name}["), "i", F.lit("]")).alias("path"), "v")

    items = each(root, "dependencies")
    words = each(items, "types").select("repo", "path", _problem(F.col("v"), "string", True, TYPES).alias("rule")).where("rule is not null")
    loose = items.where(~F.schema_of_variant("v").rlike(_KINDS["object"])).select("repo", "path", F.lit("is not of kind object").alias("rule"))
    parts = [root.where("v is null").select("repo", "path", F.lit("is not JSON").alias("rule")), _broken(root, ""), _broken(under(root, "repo"), "repo"), _broken(under(root, "summary"), "summary"), loose, _broken(items, "dependencies"), words, _broken(each(items, "evidence"), "evidence"), _broken(each(items, "surfaces"), "surfaces")]
    return functools.reduce(DataFrame.union, parts)
