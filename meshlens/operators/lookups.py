"""The stored graph's queries: lookups, searches, reports."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.functions.identity import slug
from meshlens.functions.paths import endpoint_key
from meshlens.functions.predicates import confidence_label
from meshlens.operators import traversal


def dependencies_of(deps: DataFrame, repo: str) -> DataFrame:
    return deps.where(F.col("from_repo") == repo).orderBy(F.desc("confidence"), "to_repo")


def dependents_of(deps: DataFrame, repo: str) -> DataFrame:
    return deps.where(F.col("to_repo") == repo).orderBy(F.desc("confidence"), "from_repo")


def _best_names(found: DataFrame, query: str, limit: int) -> DataFrame:
    return found.where(F.col("name").ilike(f"%{query}%")).orderBy(F.desc(F.col("name") == query), F.length("name"), "name", "repo", "file", "start_line", "ord").limit(limit)


def search_symbols(symbols: DataFrame, query: str, limit: int = 50, repo: str | None = None) -> DataFrame:
    """Names that contain query (% and _ are wildcards, case doesn't count): equal ones first, then shorter ones; of one
    repository or of all."""
    return _best_names(symbols if repo is None else symbols.where(F.col("repo") == repo), query, limit)


def _grams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substr(text, i, F.lit(3))))


def name_postings(symbols: DataFrame) -> DataFrame:
    """(gram, name): the distinct names in which three letters, in lower case, stand side by side. Sorted by gram, so that a
    reader of a few grams skips the rest. A common gram lies in as many tasks as it needs."""
    names = symbols.select("name").distinct().withColumn("low", F.lower("name")).where(F.length("low") >= 3)
    return names.select(F.explode(_grams(F.col("low"))).alias("gram"), "name").repartitionByRange("gram", "name").sortWithinPartitions("gram", "name")


def search_postings(symbols: DataFrame, postings: DataFrame, query: str, limit: int = 50, repo: str | None = None) -> DataFrame:
    """search_symbols by way of postings: only names that hold all of the query's grams are compared with it. A query
    without three letters side by side is looked for among all names."""
    grams = sorted({part[i : i + 3] for part in re.split(r"[%_]|\\.", query.lower()) for i in range(len(part) - 2)})
    rows = symbols if repo is None else symbols.where(F.col("repo") == repo)
    if not grams:
        return _best_names(rows, query, limit)
    names = postings.where(F.col("gram").isin(grams)).groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("name").where(F.col("name").ilike(f"%{query}%"))
    return _best_names(rows.join(names, "name", "left_semi"), query, limit)


def callers(calls: DataFrame, name: str, limit: int = 100, repo: str | None = None) -> DataFrame:
    rows = calls.where(F.col("callee_name") == name)
    return (rows if repo is None else rows.where(F.col("repo") == repo)).orderBy("repo", "file", "line", "ord").limit(limit)


def impact_of_symbol(symbols: DataFrame, calls: DataFrame, repo: str, symbol: str) -> DataFrame:
    """(kind, repo, file, line, name): the definitions that a search for the symbol finds, and of its call sites those of other
    repositories; each is as long a report as the search's and the callers' own."""
    defined = search_symbols(symbols, symbol).select(F.lit("definition").alias("kind"), "repo", "file", F.col("start_line").alias("line"), F.col("qualified_name").alias("name"))
    called = callers(calls, symbol).where(F.col("repo") != repo).select(F.lit("caller"), "repo", "file", "line", F.col("callee_name"))
    return defined.union(called)


def symbols_for(symbols: DataFrame, repo: str, kinds: list[str] | None = None, limit: int = 200) -> DataFrame:
    rows = symbols.where(F.col("repo") == repo)
    return (rows.where(F.col("kind").isin(kinds)) if kinds else rows).orderBy("file", "start_line", "ord").limit(limit)


def aliases_of(aliases: DataFrame, repo: str) -> DataFrame:
    return aliases.where(F.col("repo") == repo).orderBy(F.desc("confidence"), "alias", "raw")


def aliases_by_repo(aliases: DataFrame) -> DataFrame:
    """(repo, names): each repository's aliases in the order of the catalog."""
    return aliases.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "alias", "raw", "source"))), lambda a: F.struct(a["alias"].alias("alias"), a["raw"].alias("raw"), a["source"].alias("source"))).alias("names"))


def repos_by_name(repos: DataFrame) -> DataFrame:
    return repos.select("name", "path").distinct().orderBy("name", "path")


def routes_of(routes: DataFrame, repo: str) -> DataFrame:
    return routes.where(F.col("repo") == repo).orderBy("path", "method", "file", "line")


def cross_repo_call_sites(symbols: DataFrame, calls: DataFrame, repo: str, limit: int = 25) -> DataFrame:
    """Calls elsewhere of names that repo defines, each site once."""
    names = symbols.where(F.col("repo") == repo).select(F.col("name").alias("callee_name")).distinct()
    sites = calls.where(F.col("repo") != repo).join(names, "callee_name").select("callee_name", "repo", "file", "line").distinct()
    return sites.orderBy("callee_name", "repo", "file", "line").limit(limit)


def impact(edges: DataFrame, deps: DataFrame, repo: str, depth: int = 3) -> DataFrame:
    """One row: direct dependents, blast radius, events emitted, and whether the blast exceeds the direct ones."""
    spark = deps.sparkSession
    direct = deps.where(F.col("to_repo") == repo).agg(F.array_sort(F.collect_set("from_repo")).alias("d"))
    blast = traversal.blast_radius(edges, spark.createDataFrame([(repo,)], "origin string"), depth).agg(F.array_sort(F.collect_set("node")).alias("b"))
    events = deps.where((F.col("from_repo") == repo) & F.array_contains("dep_types", "kafka")).agg(F.array_sort(F.collect_set("to_repo")).alias("e"))
    one = lambda df: df.withColumn("k_", F.lit(1))
    return one(direct).join(one(blast), "k_").join(one(events), "k_").select(
        F.lit(repo).alias("repo"), F.size("d").cast("long").alias("n_dependents"), F.size("b").cast("long").alias("n_blast"), F.array_join("d", ",").alias("dependents"),
        F.array_join("b", ",").alias("blast"), F.array_join("e", ",").alias("events"), (F.size("b") > F.size("d")).alias("transitive"),
    )


def impact_of_endpoint(edges: DataFrame, deps: DataFrame, surfaces: DataFrame, repo: str, endpoint: str | None = None, depth: int = 3) -> DataFrame:
    """(from_repo, confidence, endpoints, in_blast): the direct dependents with the keys they use, those alone that use
    exactly the endpoint's if one is given; in_blast tells which of them the blast radius holds. With an endpoint, that is
    all of the radius that counts: it is cut to the direct dependents that are left."""
    direct = scoped_dependents(deps, surfaces, repo, endpoint)
    blast = traversal.blast_radius(edges, deps.sparkSession.createDataFrame([(repo,)], "origin string"), depth).select(F.col("node").alias("from_repo"), F.lit(True).alias("in_blast"))
    return direct.join(blast, "from_repo", "left").withColumn("in_blast", F.coalesce("in_blast", F.lit(False))).orderBy(F.desc("confidence"), "from_repo")


def parse_endpoint(spec: str) -> tuple[str, str]:
    """'get /v1/x' -> ('GET', '/v1/x'); a bare path has any verb."""
    head, _, rest = spec.strip().partition(" ")
    return (head.upper(), rest.strip()) if rest and not head.startswith("/") else ("ANY", spec.strip())


def endpoint_users(surfaces: DataFrame, repo: str | None = None) -> DataFrame:
    """(repo, from_repo, endpoints): the distinct keys of each provider that each consumer uses."""
    rows = surfaces if repo is None else surfaces.where(F.col("repo") == repo)
    return rows.groupBy("repo", "from_repo").agg(F.array_sort(F.collect_set(endpoint_key(F.col("method"), F.col("path")))).alias("endpoints"))


def scoped_dependents(deps: DataFrame, surfaces: DataFrame, repo: str, endpoint: str | None = None) -> DataFrame:
    """Direct dependents with the distinct keys they use, those alone that use exactly the endpoint's key if one is given.
    A dependent that matches by prefix or with any verb has another key."""
    rows = deps.where(F.col("to_repo") == repo).select("from_repo", "confidence").join(endpoint_users(surfaces, repo).drop("repo"), "from_repo", "left")
    rows = rows.withColumn("endpoints", F.coalesce("endpoints", F.array().cast("array<string>")))
    if endpoint:
        verb, path = parse_endpoint(endpoint)
        rows = rows.where(F.array_contains("endpoints", endpoint_key(F.lit(verb), F.lit(path))))
    return rows.orderBy(F.desc("confidence"), "from_repo")


def events_emitted(deps: DataFrame) -> DataFrame:
    return deps.where(F.array_contains("dep_types", "kafka")).select("from_repo", F.col("to_repo").alias("topic"))


def confidence_buckets(deps: DataFrame) -> DataFrame:
    return deps.groupBy(confidence_label(F.col("confidence")).alias("label")).agg(F.count("*").alias("n"))


def snapshot_hash(symbols: DataFrame, deps: DataFrame) -> DataFrame:
    """(repo, hash): twelve hex digits over the ordered symbols and dependencies of each repository.

    A repository's lines are sorted where they are and run through one hash, which is all that is held of them."""
    quoted = F.concat(F.lit("["), F.array_join(F.transform("dep_types", lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", "), F.lit("]"))
    lines = symbols.select("repo", F.lit(0).alias("part"), F.concat_ws("|", "qualified_name", "signature").alias("line")).union(deps.select(F.col("from_repo"), F.lit(1), F.concat(F.lit("->"), F.col("to_repo"), F.lit(":"), quoted)))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, state, done = None, None, []
        for batch in batches:
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or name != repo:
                    if state is not None:
                        done.append((repo, state.hexdigest()[:12]))
                    repo, state = name, hashlib.sha256(line.encode())
                else:
                    state.update(f"\n{line}".encode())
            if len(done) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["repo", "hash"])
                done = []
        if state is not None:
            done.append((repo, state.hexdigest()[:12]))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["repo", "hash"])

    ordered = lines.where(F.col("line").isNotNull()).repartition("repo").sortWithinPartitions("repo", "part", "line")
    return ordered.select("repo", "line").mapInArrow(digests, "repo string, hash string")


def ui_nodes(deps: DataFrame, repos: DataFrame) -> DataFrame:
    known = repos.select(F.col("name").alias("node")).distinct().withColumn("known", F.lit(True))
    return traversal.degrees(deps).join(known, "node", "left").select("node", F.col("known").isNull().alias("external"), "in_degree", "out_degree")


def ui_edges(deps: DataFrame) -> DataFrame:
    only = F.forall("dep_types", lambda t: t == "import")
    return deps.select("from_repo", "to_repo", F.array_join("dep_types", ",").alias("types"), F.round("confidence", 2).alias("confidence"), only.alias("import_only"), "tier")


def neighbourhood(edges: DataFrame, focus: str) -> DataFrame:
    """(node): a repository and what an edge joins it with."""
    touching = edges.where((F.col("from_repo") == focus) | (F.col("to_repo") == focus))
    return edges.sparkSession.createDataFrame([(focus,)], "node string").union(touching.select("from_repo")).union(touching.select("to_repo")).distinct()


def visible_nodes(edges: DataFrame, nodes: DataFrame, search: str = "", external: bool = True) -> DataFrame:
    """nodes that visible edges leave: an external one only with an edge. found: whether its name holds the search text."""
    joined = edges.select(F.col("from_repo").alias("node")).union(edges.select("to_repo")).distinct().withColumn("joined", F.lit(True))
    rows = nodes.join(joined, "node", "left").where(~F.col("external") | F.lit(external) & F.col("joined").isNotNull())
    return rows.drop("joined").withColumn("found", F.contains(F.lower("node"), F.lit(search.strip().lower())))


def visible_graph(edges: DataFrame, nodes: DataFrame, least: float = 0.0, external: bool = True, import_only: bool = False, focus: str | None = None) -> DataFrame:
    """Edges that the filters leave; external nodes go with their edges. With a focus: edges within its neighbourhood."""
    rows = edges.where(F.col("confidence") >= least)
    rows = rows if import_only else rows.where(~F.col("import_only"))
    if focus is not None:
        near = neighbourhood(rows, focus)
        rows = rows.join(near.withColumnRenamed("node", "from_repo"), "from_repo", "left_semi").join(near.withColumnRenamed("node", "to_repo"), "to_repo", "left_semi")
    if not external:
        inside = nodes.where("not external").select("node")
        rows = rows.join(inside.withColumnRenamed("node", "from_repo"), "from_repo", "left_semi").join(inside.withColumnRenamed("node", "to_repo"), "to_repo", "left_semi")
    return rows


def skill_metadata(deps: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, slug, callees): up to three callees by confidence go into a repository's description."""
    callees = F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "to_repo"))), lambda s: s["to_repo"]), 1, 3)
    by = deps.groupBy(F.col("from_repo").alias("name")).agg(F.array_join(callees, ", ").alias("callees"))
    return repos.join(by, "name", "left").select(F.col("name").alias("repo"), slug(F.col("name")).alias("slug"), F.coalesce("callees", F.lit("")).alias("callees"))


def ui_payload(deps: DataFrame, repos: DataFrame, aliases: DataFrame, routes_calls: DataFrame) -> DataFrame:
    """(node, payload): a JSON object for every node: whether it is external, its degrees, aliases, and endpoints with their calls."""
    provides = routes_calls.groupBy(F.col("repo").alias("node")).agg(F.array_sort(F.collect_list(F.struct("ep_key", F.size("calls").alias("calls")))).alias("provides"))
    rows = ui_nodes(deps, repos).join(aliases_by_repo(aliases).withColumnRenamed("repo", "node"), "node", "left").join(provides, "node", "left")
    return rows.select("node", F.to_json(F.struct("external", "in_degree", "out_degree", "names", "provides")).alias("payload"))


def languages(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
