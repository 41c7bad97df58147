"""Operators whose plans are linear where a plain one compares pairs: each against the plain one, with a hot key."""

import hashlib
import random

from pyspark.sql import functions as F

from meshlens.operators import documents, exports, fanout, lookups, partitions, reconcile, traversal
from meshlens.plans import workload
from meshlens.sources import code
from meshlens.sources.heads import heads


def test_enclosing(spark):
    rng = random.Random(4)
    schema = "repo string, file string, kind string, qualified_name string, start_line int, end_line int, ord int"
    spans = [(f"r{rng.randint(0, 1)}", f"d{k % 50}/{rng.choice(['index.ts', 'a.ts'])}", rng.choice(["method", "function", "class"]), f"q{k}", s := rng.randint(1, 300), s + rng.choice([0, 1, 2, 7, 30, 200, -1]), k) for k in range(400)]
    points = [(k, f"r{rng.randint(0, 1)}", f"d/{rng.choice(['index.ts', 'a.ts', 'b.ts'])}", rng.randint(0, 400)) for k in range(600)]
    got = {r.id: r.qualified_name for r in fanout.enclosing(spark.createDataFrame(points, "id int, repo string, file string, line int"), spark.createDataFrame(spans, schema)).collect()}
    want = {}
    for i, repo, file, line in points:
        hits = [(e - s, o, q) for r, f, kind, q, s, e, o in spans if r == repo and f.split("/")[-1] == file.split("/")[-1] and kind != "class" and s <= line <= e]
        if hits:
            want[i] = min(hits)[2]
    assert got == want and len(want) > 200


def test_enclosing_stays_linear(spark):
    """10,000 files of one name, 20,000 spans and as many points: all in one group of (repository, base name)."""
    spans = spark.range(20_000).select(F.lit("r").alias("repo"), F.concat("id", F.lit("/index.ts")).alias("file"), F.lit("method").alias("kind"), F.concat(F.lit("q"), "id").alias("qualified_name"), (F.col("id") % 900 + 1).cast("int").alias("start_line"), (F.col("id") % 900 + 40).cast("int").alias("end_line"), F.col("id").alias("ord"))
    points = spark.range(20_000).select("id", F.lit("r").alias("repo"), F.lit("x/index.ts").alias("file"), (F.col("id") % 900 + 1).cast("int").alias("line"))
    found = fanout.enclosing(points, spans)
    assert found.count() == 20_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_fanout_tells_the_smallest_path(spark):
    rng = random.Random(6)
    names = [f"C.m{k}" for k in range(14)]
    symbols = [("r", "f.java", "method", n.split(".")[1], n, 10 * k + 1, 10 * k + 9, k) for k, n in enumerate(names)]
    calls = [("r", a, b.split(".")[1]) for a in names for b in rng.sample(names, 3)]
    routes = [("r", "GET", f"/e{k}", "f.java", 10 * k + 2) for k in range(4)] + [("r", "GET", "/e0", "f.java", 52)]
    out = [("r", f"t{k % 3}", f"GET /k{k % 2}", "f.java", 10 * k + 3) for k in range(5, 14)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = fanout.endpoint_fanout(
        frame(routes, "repo string, method string, path string, file string, line int"), frame(symbols, "repo string, file string, kind string, name string, qualified_name string, start_line int, end_line int, ord int"),
        frame(calls, "repo string, caller string, callee_name string"), frame(out, "repo string, target string, key string, file string, line int"), 3)
    graph = {a: {names[int(b[1:])] for r, c, b in calls if c == a and names[int(b[1:])] != a} for a in names}
    want = {}
    for ep in {p for _, _, p, _, _ in routes}:
        first = {(names[line // 10],) for _, _, p, _, line in routes if p == ep}
        best, level = {p[0]: p for p in first}, {p[0]: p for p in first}
        for _ in range(3):
            new = {}
            for p in level.values():
                for b in graph[p[-1]]:
                    if b not in best:
                        new[b] = min(new.get(b, (*p, b)), (*p, b))
            best, level = best | new, new
        for _, target, key, _, line in out:
            node = names[line // 10]
            if node in best:
                k = (f"GET {ep}", target, key)
                want[k] = min(want.get(k, (len(best[node]), best[node])), (len(best[node]), best[node]))
    assert {(r.ep_key, r.target, r.key): (r.hops + 1, tuple(f"C.{v}" for v in r.via)) for r in got.collect()} == want


def _namesakes():
    """Forty symbols bear each of six names, one symbol has two names; calls name a few."""
    rng = random.Random(7)
    symbols = [("r", "f.java", "method", f"n{k % 6}", f"C{k:03}.n{k % 6}", 10 * k + 1, 10 * k + 9, k) for k in range(240)] + [("r", "f.java", "method", "n5", "C001.n1", 9001, 9009, 999)]
    calls = [("r", s[4], f"n{b}") for s in symbols[:240] for b in rng.sample(range(6), 2) if rng.random() < 0.05]
    return symbols, calls


SYMBOLS = "repo string, file string, kind string, name string, qualified_name string, start_line int, end_line int, ord int"


def test_call_graph_deals_no_pairs(spark):
    symbols, calls = _namesakes()
    got = fanout.call_graph(spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(calls, "repo string, caller string, callee_name string"))
    assert sorted((r.caller, r.callee) for r in got.collect()) == sorted({(a, s[4]) for _, a, b in calls for s in symbols if s[3] == b and s[4] != a})
    assert got._jdf.queryExecution().optimizedPlan().toString().startswith("Union")  # no aggregate over the pairs of single names


def test_call_graph_puts_a_names_pairs_together(spark, tmp_path):
    """Files of pairs take under a byte a row, and a name's calls are dealt once, by the name, in as many partitions as are asked for."""
    symbols = spark.range(2000).select(F.lit("r").alias("repo"), F.lit("method").alias("kind"), F.concat(F.lit("n"), F.col("id") % 40).alias("name"), F.concat(F.sha1(F.col("id").cast("string")), F.lit(".q")).alias("qualified_name"))
    calls = spark.range(6000).select(F.lit("r").alias("repo"), F.sha1((F.col("id") % 3000).cast("string")).alias("caller"), F.concat(F.lit("n"), F.col("id") * 7 % 40).alias("callee_name"))
    got = fanout.call_graph(symbols, calls.union(calls), 7)  # calls found twice make no pairs more
    got.write.parquet(path := str(tmp_path / "pairs"))
    pairs = spark.read.parquet(path)
    assert pairs.count() == pairs.distinct().count() == 150_000  # 3000 calls, 50 symbols of each name
    files = [p for p in (tmp_path / "pairs").iterdir() if p.suffix == ".parquet"]
    assert sum(p.stat().st_size for p in files) - 41 * 5000 < 150_000  # but for each caller's and callee's own name
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "hashpartitioning(repo" in plan and ", 7)" in plan


def test_found_calls_hold_the_calls(spark):
    """Names are looked up before callers: the same calls as by pairs of parts."""
    sf = "/root/testdata/sf0.001"
    sym = workload.symbols(spark, sf).select("repo", "qualified_name", "name", F.concat(F.lit("p"), "ord").alias("node"))
    callers, callees = sym.select("repo", F.col("qualified_name").alias("caller"), F.col("node").alias("from_repo")), sym.select(F.col("name").alias("callee_name"), F.col("node").alias("to_repo"))
    want = workload.edges(spark, sf).join(callers, "from_repo").join(callees, "to_repo").select("repo", "caller", "callee_name").distinct()
    assert sorted(map(tuple, workload.part_calls(spark, sf).collect())) == sorted(map(tuple, want.collect())) == sorted(map(tuple, workload.found_calls(spark, sf).distinct().collect()))


def test_walks_go_from_name_to_name(spark, monkeypatch):
    """Fan-out and reach of namesakes are right, and no call graph is made for them."""
    symbols, calls = _namesakes()
    graph = {}
    for _, a, b in calls:
        graph.setdefault(a, set()).update(s[4] for s in symbols if s[3] == b and s[4] != a)
    monkeypatch.setattr(fanout, "call_graph", None)
    frames = spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(calls, "repo string, caller string, callee_name string")
    starts = [a for _, a, _ in calls][:3]
    best, level = {}, {}
    for a in starts:
        best[a], level[a] = {a: (a,)}, {a: (a,)}
        for _ in range(4):
            new = {}
            for p in level[a].values():
                for b in graph.get(p[-1], ()):
                    if b not in best[a]:
                        new[b] = min(new.get(b, (*p, b)), (*p, b))
            best[a], level[a] = best[a] | new, new
    got = fanout.call_reach(*frames, spark.createDataFrame([("r", starts[0])], "repo string, node string"), 4)
    assert {r.node: r.hops for r in got.collect()} == {b: len(p) - 1 for b, p in best[starts[0]].items()}
    lines = {s[4]: s[5] for s in symbols[:240]}
    routes = spark.createDataFrame([("r", "GET", f"/{'abc'[k]}", "f.java", lines[a] + 1) for k, a in enumerate(starts)], "repo string, method string, path string, file string, line int")
    out = spark.createDataFrame([("r", f"t{k % 7}", "GET /k", "f.java", line + 2) for k, line in enumerate(lines.values())], "repo string, target string, key string, file string, line int")
    want = {}
    for k, a in enumerate(starts):
        for j, node in enumerate(lines):
            if node in best[a]:
                key, p = (f"GET /{'abc'[k]}", f"t{j % 7}"), best[a][node]
                want[key] = min(want.get(key, (len(p), p)), (len(p), p))
    told = fanout.endpoint_fanout(routes, *frames, out)
    assert {(r.ep_key, r.target): (r.hops + 1, tuple(r.via)) for r in told.collect()} == {k: (n, tuple(v.split(".")[-1] for v in p)) for k, (n, p) in want.items()}


def test_violations_make_the_documents_once(spark):
    rows = spark.createDataFrame([("a", '{"version":'), ("a", '{"version":'), ("b", '{"dependencies": [1]}')], "repo string, document string")
    got = documents.violations(rows.groupBy("repo", "document").agg(F.count("*").alias("n")))
    assert ("a", "$", "is not JSON") in [tuple(r) for r in got.collect()] and ("b", "$.dependencies[0]", "is not of kind object") in [tuple(r) for r in got.collect()]
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_degrees_hash_without_a_sort(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randint(0, 30)}", f"n{rng.randint(0, 30)}", rng.choice([0.5, 0.8, 0.9, None]), k) for k in rng.sample(range(900), 200)]
    frame = spark.createDataFrame(edges, "from_repo string, to_repo string, confidence double, ord long")
    got = traversal.degrees(frame)
    pairs = {(a, b) for a, b, _, _ in edges}
    first = lambda n: min([(o, 0) for a, _, _, o in edges if a == n] + [(o, 1) for _, b, _, o in edges if b == n])
    assert {r.node: (r.in_degree, r.out_degree, tuple(r.first)) for r in got.collect()} == {n: (sum(b == n for _, b in pairs), sum(a == n for a, _ in pairs), first(n)) for p in pairs for n in p}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Union" not in plan
    summary = exports.export_summary(frame).first()
    nodes = sorted({n for p in pairs for n in p}, key=lambda n: (-sum(b == n for _, b in pairs), first(n)))
    assert tuple(summary) == (200, sum((c or 0) >= 0.8 for _, _, c, _ in edges), ",".join(nodes[:5]))
    assert tuple(exports.export_summary(frame.where("false")).first()) == (0, 0, "")


def test_large_tables_are_dealt_in_partitions_of_their_size(spark, monkeypatch):
    """What the session's number of partitions says doesn't bound what a task holds of a large table."""
    sf = "/root/testdata/sf0.001"
    assert partitions.partitions_for(spark.range(4000), 1000) is None and partitions.partitions_for(spark.range(4001), 1000) == 5
    views = {"lines": workload.lines, "edges": workload.edges, "dependencies": workload.dependencies, "part_calls": workload.part_calls}
    plain = {name: view(spark, sf) for name, view in views.items()}
    monkeypatch.setattr(workload, "partitions_for", lambda rows: 11)
    for name, view in views.items():
        wide = view(spark, sf)
        assert sorted(map(str, wide.collect())) == sorted(map(str, plain[name].collect())), name
        assert wide.groupBy(F.spark_partition_id()).count().count() == 11, name


def test_lines_of_many_files_are_dealt_by_their_number(spark):
    files = workload.code_files(spark, "/root/testdata/sf0.001")
    wide, plain = code.routes(code.lines(files, 13), heads(files)), code.routes(code.lines(files), heads(files))
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, plain.collect())) and plain.count() > 50
    rows = code.lines(files, 13)
    assert rows.groupBy(F.spark_partition_id()).count().count() == 13
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # files, once; their lines are not dealt again


def plain_binding(norm, exclude, aliases):
    """The cascade over the whole catalog, in its order."""
    stem = lambda x: x[:-1] if len(x.rsplit("-", 1)[-1]) > 3 and x.endswith("s") else x
    tokens = lambda x: {t for t in x.split("-") if len(t) >= 3}
    ok = [a for a in aliases if a[0] != exclude]
    for same, most, factor, reason in ((lambda a: a == norm, 1.0, 1.0, "exact"), (lambda a: stem(a) == stem(norm), 0.95, 0.95, "stem")):
        hits = [a for a in ok if same(a[1])]
        if hits:
            repo, _, source, c, _ = max(hits, key=lambda a: (a[3], -a[4]))
            return repo, min(most, c * factor), source, reason
    best = None
    for alias in dict.fromkeys(a[1] for a in aliases):
        a, b = tokens(alias), tokens(norm)
        hits = [x for x in ok if x[1] == alias]
        if a and b and hits and (a <= b or b <= a):
            repo, _, source, c, _ = max(hits, key=lambda x: (x[3], -x[4]))
            if best is None or c > best[1]:
                best = (repo, min(0.7, c * 0.75), source, "subset")
    return best


def test_bind_against_the_whole_catalog(spark):
    rng = random.Random(12)
    words = ["order", "billing", "users", "user", "stock", "cart", "mail", "tax"]
    name = lambda: "-".join(rng.sample(words, rng.randint(1, 3)))
    aliases = [(f"r{rng.randint(0, 9)}", name() if k % 3 else f"order-{name()}", rng.choice("ab"), rng.choice([0.3, 0.5, 0.6, 0.7, 0.72, 0.8, 0.9, 1.0]), k) for k in range(120)]
    refs = list({(name(), rng.choice([None, "r0", "r1", "r2", "r3"])) for _ in range(300)})
    got = reconcile.bind(spark.createDataFrame(refs, "ref string, exclude string"), spark.createDataFrame(aliases, "repo string, alias string, source string, confidence double, ord int"))
    rows = got.collect()
    assert {(r.ref, r.exclude) for r in rows} == set(refs)
    kinds = set()
    for r in rows:
        want = plain_binding(r.ref, r.exclude, aliases)
        assert (tuple(r.match) if r.match else None) == want, (r, want)
        own = plain_binding(r.ref, "", aliases)
        assert r.self_match == (own and own[0])
        kinds.add(r.match and r.match.reason)
    assert {"exact", "subset"} <= kinds


def test_search_by_postings(spark, tmp_path):
    rng = random.Random(3)
    names = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(3000)] + ["Order", "orders", "reorder", "an_order", "50%order"]
    symbols = spark.createDataFrame([(f"r{k % 7}", f"f{k % 11}", n, k, k) for k, n in enumerate(names)], "repo string, file string, name string, start_line int, ord int").cache()
    lookups.name_postings(symbols).write.parquet(f"{tmp_path}/p")
    postings = spark.read.parquet(f"{tmp_path}/p")
    key = ["name", "repo", "file", "start_line", "ord"]
    for query in ("order", "abc", "ab", "a%cde", "_abc_", "bcdé", "zzz", "ORDER", ""):
        assert [r[:] for r in lookups.search_postings(symbols, postings, query).select(key).collect()] == [r[:] for r in lookups.search_symbols(symbols, query).select(key).collect()], query
    assert lookups.search_postings(symbols, postings, "abc", repo="r1").count() == lookups.search_symbols(symbols, "abc", repo="r1").count()
    compared = postings.where("gram = 'ord'").count()
    assert compared <= 10 and symbols.count() > 3000  # what is compared with the query, of all


def test_snapshot_hash(spark):
    symbols = [("a", f"Q.m{k}", f"m{k}(x)") for k in range(2000)] + [("b", "q", "s")]
    deps = [("a", "b", ["http", "import"]), ("c", "a", ["kafka"])]
    got = {r.repo: r.hash for r in lookups.snapshot_hash(spark.createDataFrame(symbols, "repo string, qualified_name string, signature string").repartition(5), spark.createDataFrame(deps, "from_repo string, to_repo string, dep_types array<string>")).collect()}
    told = {"a": [*sorted(f"{q}|{s}" for r, q, s in symbols if r == "a"), '->b:["http", "import"]'], "b": ["q|s"], "c": ['->a:["kafka"]']}
    assert got == {r: hashlib.sha256("\n".join(lines).encode()).hexdigest()[:12] for r, lines in told.items()}
