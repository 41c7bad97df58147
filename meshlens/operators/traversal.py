"""Walks over the dependency graph, level by level: narrow rows, one join and one anti-join a level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.operators.checkpoints import checkpointed, written


def reached(edges: DataFrame, start: DataFrame, hops: int | None = None, forward: bool = False) -> DataFrame:
    """start (origin) -> (origin, node, hops): the fewest hops to every node, the origin itself with 0.

    edges (from_repo, to_repo) are walked against their direction, or along it if forward; without a bound
    on the hops until no node is new. Each level is cut with a checkpoint when there is no bound."""
    a, b = ("from_repo", "to_repo") if forward else ("to_repo", "from_repo")
    steps = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node <> next").distinct()
    seen = frontier = start.select("origin", F.col("origin").alias("node"), F.lit(0).alias("hops"))
    level = 0
    if hops is None:
        steps = checkpointed(steps)
    while hops is None or level < hops:
        level += 1
        found = frontier.join(steps, "node").select("origin", F.col("next").alias("node")).distinct().join(seen.select("origin", "node"), ["origin", "node"], "left_anti")
        frontier = found.withColumn("hops", F.lit(level))
        if hops is None:
            frontier = checkpointed(frontier)
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen


def blast_radius(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """(origin, node) that a change of origin reaches: distances 1 to depth - 1, as the reference counts."""
    return reached(edges, start, max(0, depth - 1)).where("hops > 0").select("origin", "node")


def affected(edges: DataFrame, deps: DataFrame, repo: str, depth: int | None = None, with_dependencies: bool = False) -> DataFrame:
    """(repo, ord): the repository, then its dependents by confidence, or its blast radius by name, then its
    dependencies; each once, where it comes first. deps (from_repo, to_repo, confidence)."""
    spark = edges.sparkSession
    first = spark.createDataFrame([(repo, 0.0, "")], "repo string, a double, b string").withColumn("part", F.lit(0))
    if depth is None:
        second = deps.where(F.col("to_repo") == repo).select(F.col("from_repo").alias("repo"), (-F.col("confidence")).alias("a"), F.col("from_repo").alias("b"))
    else:
        start = spark.createDataFrame([(repo,)], "origin string")
        second = blast_radius(edges, start, depth).select(F.col("node").alias("repo"), F.lit(0.0).alias("a"), F.col("node").alias("b"))
    parts = first.unionByName(second.withColumn("part", F.lit(1)))
    if with_dependencies:
        third = deps.where(F.col("from_repo") == repo).select(F.col("to_repo").alias("repo"), (-F.col("confidence")).alias("a"), F.col("to_repo").alias("b"))
        parts = parts.unionByName(third.withColumn("part", F.lit(2)))
    return parts.groupBy("repo").agg(F.min(F.struct("part", "a", "b")).alias("ord"))


def degrees(edges: DataFrame, **sums: Column) -> DataFrame:
    """(node, in_degree, out_degree) of every node of the graph; with first, where it first appears, if edges have ord; and with
    what sums tell of edges, added up over those that leave the node.

    Edges are read once for both of their ends, and all that a node keeps are numbers, so that hashing groups it without a sort."""
    place = F.min("ord") if "ord" in edges.columns else F.lit(0)
    once = edges.groupBy("from_repo", "to_repo").agg(place.alias("ord"), *[F.sum(c).alias(name) for name, c in sums.items()])
    end = lambda node, i, o: F.struct(F.col(node).alias("node"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = once.select("ord", *sums, F.explode(F.array(end("from_repo", 0, 1), end("to_repo", 1, 0))).alias("end")).select("end.*", "ord", *sums)
    leaving, arriving = F.min(F.when(F.col("o") == 1, F.col("ord"))), F.min(F.when(F.col("i") == 1, F.col("ord")))
    out = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), leaving.alias("leaving"), arriving.alias("arriving"), *[F.sum(F.col(name) * F.col("o")).alias(name) for name in sums])
    first = F.struct(F.least("leaving", "arriving").alias("ord"), F.when(F.col("leaving") <= F.coalesce("arriving", "leaving"), 0).otherwise(1).alias("i"))
    return out.select("node", "in_degree", "out_degree", *([first.alias("first")] if "ord" in edges.columns else []), *sums)


def most_depended(d: DataFrame, top: int = 5) -> DataFrame:
    """One row: of the nodes of degrees, those of highest in-degree, as in summary."""
    d = d if "first" in d.columns else d.withColumn("first", F.lit(0))
    return d.orderBy(F.desc("in_degree"), "first", "node").limit(top).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("in_degree")).alias("k"), "first", "node"))), lambda s: s["node"]), ",").alias("most_depended"))


def summary(edges: DataFrame, top: int = 5) -> DataFrame:
    """One row: nodes, edges, the nodes of highest in-degree, and how many have none. Ties go to the node that appears
    first, where edges have ord, else by name."""
    d = written(degrees(edges))
    best = most_depended(d, top)
    counts = d.agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.count_if(F.col("in_degree") == 0).alias("orphans"))
    return counts.withColumn("k_", F.lit(1)).join(best.withColumn("k_", F.lit(1)), "k_").drop("k_")  # one row each
