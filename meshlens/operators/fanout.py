"""Which outbound calls an endpoint's handler reaches."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlens.functions import paths as P
from meshlens.functions.predicates import fanout_confidence
from meshlens.operators.checkpoints import written


def enclosing(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """points (id, repo, file, line) -> (id, qualified_name): the innermost method or function around the line, by the base
    name of the file; the shortest span wins, then the first symbol.

    Spans fall apart into aligned blocks of lines, at most two of each power of two, and each block keeps its best span; a
    line then looks up the blocks that it lies in. So ten thousand files of one name cost their lines, not their product."""
    place = F.struct((F.col("end_line") - F.col("start_line")).alias("length"), "ord", "qualified_name")
    spans = symbols.where(F.col("kind").isin("method", "function") & (F.col("end_line") >= F.col("start_line"))).select("repo", P.basename(F.col("file")).alias("base"), F.greatest("start_line", F.lit(1)).cast("long").alias("first"), (F.col("end_line") + 1).cast("long").alias("behind"), place.alias("span"))
    blocks = F.expr("""flatten(transform(sequence(0, 31), k -> filter(array(
        named_struct('level', k, 'block', (first + shiftleft(1L, k) - 1) div shiftleft(1L, k), 'taken', (first + shiftleft(1L, k) - 1) div shiftleft(1L, k) < behind div shiftleft(1L, k) AND (first + shiftleft(1L, k) - 1) div shiftleft(1L, k) % 2 = 1),
        named_struct('level', k, 'block', behind div shiftleft(1L, k) - 1, 'taken', (first + shiftleft(1L, k) - 1) div shiftleft(1L, k) < behind div shiftleft(1L, k) AND behind div shiftleft(1L, k) % 2 = 1)), b -> b.taken)))""")
    best = spans.select("repo", "base", F.explode(blocks).alias("b"), "span").groupBy("repo", "base", "b.level", "b.block").agg(F.min("span").alias("span"))
    at = points.select("id", "repo", P.basename(F.col("file")).alias("base"), F.col("line").cast("long").alias("line")).where("line >= 1")
    lines = at.select("repo", "base", "line").distinct().withColumn("level", F.explode(F.expr("sequence(0, cast(floor(log2(line)) as int))"))).withColumn("block", F.expr("shiftright(line, level)"))
    found = lines.join(best, ["repo", "base", "level", "block"]).groupBy("repo", "base", "line").agg(F.min("span").alias("span"))
    return at.join(found, ["repo", "base", "line"]).select("id", F.col("span.qualified_name").alias("qualified_name"))


def _callable(symbols: DataFrame) -> DataFrame:
    """(repo, name, qualified_name) of methods and functions, each once."""
    return symbols.where(F.col("kind").isin("method", "function")).select("repo", "name", "qualified_name").distinct()


def call_graph(symbols: DataFrame, calls: DataFrame, partitions: int | None = None) -> DataFrame:
    """(repo, caller, callee): caller and callee by qualified name, callees looked up by name within the repository.

    A name stands for every symbol that bears it, so there are far more pairs than calls and symbols: pairs aren't dealt anew. They
    are distinct as they come, for calls and named symbols are; but a symbol of several names is first given those that call it.
    Calls are dealt once, by the name that they call, in so many partitions, and merged with its symbols: each caller then stands
    beside the same callees in the same order, and a file of pairs, with few callers and callees in it, takes a fraction of a byte a row."""
    named = _callable(symbols).withColumn("names", F.count("*").over(Window.partitionBy("repo", "qualified_name")))
    called = calls.select("repo", "caller", F.col("callee_name").alias("name"))
    called = called.repartition(*([] if partitions is None else [partitions]), "repo", "name").distinct()
    pairs = lambda rows: called.join(rows.select("repo", "name", F.col("qualified_name").alias("callee")).hint("merge"), ["repo", "name"]).where("caller <> callee").select("repo", "caller", "callee")
    return pairs(named.where("names = 1")).union(pairs(named.where("names > 1")).distinct())


def call_reach(symbols: DataFrame, calls: DataFrame, start: DataFrame, max_hops: int) -> DataFrame:
    """start (repo, node) -> (repo, node, hops): the fewest calls to each symbol by qualified name, 0 to the start itself.

    Walks from symbols to the names that they call and on to the symbols of these, so the call graph's pairs are never made."""
    named, called = _callable(symbols), calls.select("repo", F.col("caller").alias("node"), F.col("callee_name").alias("name")).distinct()
    seen = frontier = written(start.select("repo", "node", F.lit(0).alias("hops")).distinct())
    for hops in range(1, max_hops + 1):
        names = frontier.join(called, ["repo", "node"]).select("repo", "name").distinct()
        found = names.join(named, ["repo", "name"]).select("repo", F.col("qualified_name").alias("node")).distinct()
        frontier = written(found.join(seen.select("repo", "node"), ["repo", "node"], "left_anti").withColumn("hops", F.lit(hops)))
        seen = seen.union(frontier)
    return seen


def endpoint_fanout(routes: DataFrame, symbols: DataFrame, calls: DataFrame, surfaces: DataFrame, max_hops: int = 4) -> DataFrame:
    """routes (repo, method, path, file, line), surfaces (repo, target, method, path, key, matched, file, line) ->
    (repo, ep_key, target, key, hops, confidence, via): for each endpoint and outbound call the fewest hops.

    A call names its callee, and all symbols of that name are reached at once and from the same caller. So a level holds, for each
    endpoint, the names first called there, not their symbols, which are many times as many; of a name's symbols only the first
    that calls a further name, or that holds a sink, can lie on a smallest path. (A symbol reached before, as a handler or by another
    name, may be taken for it: but what that one calls has been reached before, too.) With each name goes the symbol that calls it
    on the smallest path by names, and that path's rank among the endpoint's of the level: a smaller rank before makes a smaller
    path, so no path is carried along. The paths told are put together from the levels at the end. The tables that are read
    at every level, and each level, are written, so no level computes the ones before it anew."""
    at = routes.select(F.xxhash64("repo", "method", "path", "file", "line").alias("id"), "repo", "file", "line", P.endpoint_key(F.col("method"), F.col("path")).alias("ep_key")).distinct()
    handlers = written(enclosing(at, symbols).join(at, "id").select("repo", "ep_key", F.col("qualified_name").alias("node")).distinct())
    out = surfaces.withColumn("id", F.xxhash64("repo", "file", "line"))
    sinks = written(enclosing(out.select("id", "repo", "file", "line").distinct(), symbols).join(out, "id").select("repo", F.col("qualified_name").alias("node"), "target", "key").distinct())
    named = written(_callable(symbols).withColumnRenamed("qualified_name", "node"))
    known = named.select("repo", F.col("name").alias("callee")).distinct()
    called = written(calls.select("repo", F.col("caller").alias("node"), F.col("callee_name").alias("callee")).distinct().join(known, ["repo", "callee"], "left_semi"))
    by_name = written(called.join(named, ["repo", "node"]).groupBy("repo", "name", "callee").agg(F.min("node").alias("node")))
    first_sinks = written(sinks.join(named, ["repo", "node"]).groupBy("repo", "name", "target", "key").agg(F.min("node").alias("node")))
    ranked = F.dense_rank().over(Window.partitionBy("repo", "ep_key").orderBy("from.rank", "from.node"))
    step = handlers.join(called, ["repo", "node"]).select("repo", "ep_key", "callee", F.struct(F.lit(0).alias("rank"), "node", F.lit(None).cast("string").alias("name")).alias("from"))
    levels = []
    for hops in range(1, max_hops + 1):
        new = step.groupBy("repo", "ep_key", F.col("callee").alias("name")).agg(F.min("from").alias("from"))
        for level in levels:
            new = new.join(level.select("repo", "ep_key", "name"), ["repo", "ep_key", "name"], "left_anti")
        levels.append(written(new.select("repo", "ep_key", "name", F.col("from.node").alias("before"), F.col("from.name").alias("name_before"), ranked.alias("rank"), F.lit(hops).alias("hops"))))
        step = levels[-1].join(by_name, ["repo", "name"]).select("repo", "ep_key", "callee", F.struct("rank", "node", "name").alias("from"))
    keys, place = ["repo", "ep_key", "target", "key"], F.struct("hops", "rank", "node", "name")
    own = handlers.join(sinks, ["repo", "node"]).select(*keys, F.struct(F.lit(0).alias("hops"), F.lit(0).alias("rank"), "node", F.lit(None).cast("string").alias("name")).alias("place"))
    reached = [level.join(first_sinks, ["repo", "name"]).select(*keys, place.alias("place")) for level in levels]
    told = functools.reduce(DataFrame.union, reached, own).groupBy(*keys).agg(F.min("place").alias("place")).select(*keys, "place.hops", "place.name", F.array("place.node").alias("via"))
    for hops in range(max_hops, 0, -1):
        here = levels[hops - 1].select("repo", "ep_key", "name", "before", "name_before", F.lit(True).alias("found"))
        told = told.join(here, ["repo", "ep_key", "name"], "left").withColumns({"via": F.when(F.col("found"), F.concat(F.array("before"), "via")).otherwise(F.col("via")), "name": F.when(F.col("found"), F.col("name_before")).otherwise(F.col("name"))}).drop("before", "name_before", "found")
    return told.select("repo", "ep_key", "target", "key", "hops", fanout_confidence(F.col("hops")).alias("confidence"), F.transform("via", lambda q: F.substring_index(q, ".", -1)).alias("via"))


def route_calls(fanned: DataFrame, repo: str | None = None) -> DataFrame:
    """Stored fan-out in the order of its display: endpoint, then hops, target and key."""
    rows = fanned if repo is None else fanned.where(F.col("repo") == repo)
    return rows.orderBy("repo", F.substring_index("ep_key", " ", -1), F.substring_index("ep_key", " ", 1), "hops", "target", "key")


def routes_with_calls(routes: DataFrame, fanned: DataFrame) -> DataFrame:
    """(repo, ep_key, calls): every endpoint with what it fans out to, nearest first; none where it calls nothing."""
    keyed = routes.select("repo", P.endpoint_key(F.col("method"), F.col("path")).alias("ep_key")).distinct()
    each = F.struct("hops", "target", "key", "confidence", "via")
    calls = fanned.groupBy("repo", "ep_key").agg(F.array_sort(F.collect_list(each)).alias("calls"))
    return keyed.join(calls, ["repo", "ep_key"], "left").withColumn("calls", F.coalesce("calls", F.array().cast(calls.schema["calls"].dataType)))


def top_rows(df: DataFrame, n: int, *order, per: list[str] | None = None) -> DataFrame:
    """The first n rows in an order, in all or per group."""
    if per is None:
        return df.orderBy(*order).limit(n)
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("rank_") <= n).drop("rank_")
