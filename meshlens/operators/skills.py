"""A document for each repository that an agent reads before it works there, and their registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.functions.identity import slug
from meshlens.operators import lookups

SYMBOLS = 30  # a document lists so many symbols of its repository: a feature, not a bound of the data


def _lines(rows: DataFrame, repo: str, line, *order, limit: int | None = None) -> DataFrame:
    """(name, text): a repository's lines in order, one a row of rows."""
    listed = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line"))))
    listed = F.slice(listed, 1, limit) if limit else listed
    return rows.groupBy(F.col(repo).alias("name")).agg(F.array_join(F.transform(listed, lambda s: s["line"]), "\n").alias("text"))


def descriptions(deps: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, slug, description): up to three services that a repository calls, by confidence, and how many call it."""
    called = deps.where(~F.array_contains("dep_types", "kafka"))
    first = F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "to_repo"))), lambda s: s["to_repo"]), 1, 3)
    calls = called.groupBy(F.col("from_repo").alias("name")).agg(F.array_join(first, ", ").alias("calls"))
    callers = deps.groupBy(F.col("to_repo").alias("name")).agg(F.count("*").alias("callers"))
    text = F.concat(
        F.lit("How to work in "), F.col("name"), F.when(F.col("calls") != "", F.concat(F.lit(" — calls "), "calls")).otherwise(F.lit("")),
        F.when(F.col("callers") > 0, F.concat(F.lit("; called by "), "callers", F.lit(" repo(s)"))).otherwise(F.lit("")), F.lit("."),
    )
    rows = repos.select("name").distinct().join(calls, "name", "left").join(callers, "name", "left")
    return rows.select(F.col("name").alias("repo"), F.concat(F.lit("work-in-"), slug(F.col("name"))).alias("slug"), text.alias("description"))


def registry(deps: DataFrame, repos: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, slug, description, version, languages): the index; version changes with the symbols and dependencies."""
    version = lookups.snapshot_hash(symbols, deps).withColumnRenamed("hash", "version")
    return descriptions(deps, repos).join(version, "repo", "left").join(lookups.languages(symbols), "repo", "left").withColumn("languages", F.coalesce("languages", F.lit("")))


def documents(deps: DataFrame, repos: DataFrame, symbols: DataFrame, memory: DataFrame) -> DataFrame:
    """(repo, document): one text a repository, from rows grouped by repository."""
    types = F.array_join("dep_types", ", ")
    percent = F.concat(F.round(F.col("confidence") * 100).cast("int"), F.lit("%"))
    worst = -F.col("confidence")
    sections = {
        "Calls": _lines(deps.where(~F.array_contains("dep_types", "kafka")), "from_repo", F.concat(F.lit("- "), "to_repo", F.lit(" ("), types, F.lit(", "), percent, F.lit(")")), worst, F.col("to_repo")),
        "Called by": _lines(deps, "to_repo", F.concat(F.lit("- "), "from_repo", F.lit(" ("), types, F.lit(")")), worst, F.col("from_repo")),
        "Events": _lines(deps.where(F.array_contains("dep_types", "kafka")), "from_repo", F.concat(F.lit("- "), "to_repo"), F.col("to_repo")),
        "Symbols": _lines(symbols, "repo", F.concat(F.lit("- ["), "kind", F.lit("] "), F.coalesce(F.nullif("signature", F.lit("")), "name"), F.lit(" at "), "file", F.lit(":"), "start_line"), F.col("file"), F.col("start_line"), F.col("ord"), limit=SYMBOLS),
        "Notes": _lines(memory, "repo", F.concat(F.lit("- ("), "kind", F.lit(") "), "note"), F.col("id")),
    }
    out = registry(deps, repos, symbols).withColumn("document", F.concat(F.lit("---\nname: "), "slug", F.lit("\ndescription: "), "description", F.lit("\nversion: "), F.coalesce("version", F.lit("")), F.lit("\n---\n\n# "), "repo", F.lit("\n")))
    for title, rows in sections.items():
        out = out.join(rows.select(F.col("name").alias("repo"), "text"), "repo", "left")
        empty = F.lit("") if title in ("Events", "Notes") else F.lit(f"\n## {title}\n- none known\n")
        out = out.withColumn("document", F.concat("document", F.when(F.col("text").isNull(), empty).otherwise(F.concat(F.lit(f"\n## {title}\n"), "text", F.lit("\n"))))).drop("text")
    return out.select("repo", "document")


def write_registry(deps: DataFrame, repos: DataFrame, symbols: DataFrame, memory: DataFrame, folder: str) -> None:
    """folder/index (JSON lines) and folder/documents (by repository)."""
    registry(deps, repos, symbols).write.mode("overwrite").json(f"{folder}/index")
    documents(deps, repos, symbols, memory).write.mode("overwrite").json(f"{folder}/documents")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("repo string, slug string, description string, version string, languages string").json(f"{folder}/index")


def read_skill(spark: SparkSession, folder: str, repo: str) -> str | None:
    row = spark.read.schema("repo string, document string").json(f"{folder}/documents").where(F.col("repo") == repo).first()
    return row.document if row else None
