"""Exports of the graph as JSON, one line a dependency, written and read by all executors; and their summaries."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.functions import paths as P
from meshlens.operators import surfaces as S
from meshlens.operators import traversal
from meshlens.operators.checkpoints import written

PLACE = "struct<file:string,line:int,snippet:string>"
EXPORT = f"from_repo string, to_repo string, types array<string>, confidence double, tier string, evidence array<{PLACE}>"


def _place(text):
    """'file:line' as a place; without a number behind the last colon the line is 0."""
    tail = F.regexp_extract(text, r":([^:]*)\z", 1)
    return F.struct(
        F.regexp_replace(text, r":[^:]*\z", "").alias("file"),
        F.when(tail.rlike(r"\A\d+\z"), tail.cast("int")).otherwise(F.lit(0)).alias("line"), F.lit("").alias("snippet"),
    )


def export_rows(deps: DataFrame, repo: str | None = None) -> DataFrame:
    """The dependencies of one repository or of all of them, in EXPORT's shape."""
    rows = deps if repo is None else deps.where(F.col("from_repo") == repo)
    return rows.select("from_repo", "to_repo", F.col("dep_types").alias("types"), "confidence", "tier", F.transform("evidence", _place).alias("evidence"))


def write_export(deps: DataFrame, folder: str, repo: str | None = None) -> None:
    export_rows(deps, repo).write.mode("overwrite").json(folder)


def load_export(spark: SparkSession, folder: str) -> DataFrame:
    """A written export as dependencies again: places become 'file:line'."""
    rows = spark.read.schema(EXPORT).json(folder)
    return as_dependencies(rows)


def as_dependencies(rows: DataFrame) -> DataFrame:
    text = F.transform("evidence", lambda e: F.when(e["line"] > 0, F.concat_ws(":", e["file"], e["line"])).otherwise(e["file"]))
    return rows.select("from_repo", "to_repo", F.col("types").alias("dep_types"), "confidence", text.alias("evidence"), "tier")


def export_summary(deps: DataFrame, top: int = 5) -> DataFrame:
    """One row: total_deps, high_confidence (0.8 or more), and the graph's most depended-on nodes."""
    d = written(traversal.degrees(deps, total_deps=F.lit(1), high_confidence=(F.col("confidence") >= 0.8).cast("int")))
    counts = d.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_deps", "high_confidence")])
    best = traversal.most_depended(d, top)
    return counts.withColumn("k_", F.lit(1)).join(best.withColumn("k_", F.lit(1)), "k_").select("total_deps", "high_confidence", F.col("most_depended").alias("services_called"))  # one row each


def group_map(deps: DataFrame) -> DataFrame:
    """(from_repo, targets): each repository's targets with their confidence as a percentage, by name."""
    told = F.transform(F.array_sort(F.collect_list(F.struct("to_repo", "confidence"))), lambda t: F.concat(t["to_repo"], F.lit(" "), F.round(t["confidence"] * 100).cast("int"), F.lit("%")))
    return deps.groupBy("from_repo").agg(F.array_join(told, ", ").alias("targets"))


def interfaces_name(export: str) -> str:
    """deps.json -> interfaces.json; a name without 'deps' gets -interfaces behind its stem."""
    path = PurePosixPath(export)
    stem = path.stem.replace("deps", "interfaces") if "deps" in path.stem else f"{path.stem}-interfaces"
    return str(path.with_name(stem + path.suffix))


def interfaces(routes: DataFrame, matched: DataFrame) -> DataFrame:
    """(repo, provides, consumes): a repository's endpoints and the calls that it makes, each sorted."""
    given = S.provides(routes).groupBy("repo").agg(F.array_sort(F.collect_set(P.endpoint_key(F.col("method"), F.col("path")))).alias("provides"))
    taken = S.consumes(matched).groupBy(F.col("from_repo").alias("repo")).agg(F.array_sort(F.collect_set(F.concat_ws(" ", "target", "key"))).alias("consumes"))
    none = F.array().cast("array<string>")
    return given.join(taken, "repo", "full").select("repo", F.coalesce("provides", none).alias("provides"), F.coalesce("consumes", none).alias("consumes"))


def scan_summary(deps: DataFrame, matched: DataFrame, top: int = 3) -> DataFrame:
    """One row on a scan: nodes, edges, matched calls, and the first few most depended-on nodes and orphans."""
    one = lambda df: df.withColumn("k_", F.lit(1))
    first = lambda df, name: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "node"))), lambda s: s["node"]), ",").alias(name))
    d = traversal.degrees(deps)
    best = first(d.withColumn("k", -F.col("in_degree")).orderBy("k", "node").limit(top), "most_depended")
    alone = first(d.where("in_degree = 0").withColumn("k", F.lit(0)).orderBy("node").limit(top), "orphans")
    counts = d.agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"))
    return one(counts).join(one(S.match_stats(matched).select(F.col("total").alias("calls"), "matched")), "k_").join(one(best), "k_").join(one(alone), "k_").drop("k_")  # one row each
