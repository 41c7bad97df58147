import random

import pytest
from pyspark.sql import functions as F

from meshlens.operators import fanout, lookups, reconcile, resolve, store, surfaces, traversal
from meshlens.plans import queries

ALIAS = "repo string, alias string, source string, confidence double, ord long"
DEP = "from_repo string, to_repo string, dep_types array<string>, confidence double, evidence array<string>, tier string, ord long"


def binding(spark, ref, aliases, exclude="other"):
    refs = spark.createDataFrame([(ref, exclude)], "ref string, exclude string")
    return reconcile.bind(refs, spark.createDataFrame(aliases, ALIAS)).first().match


def test_bind_cascade(spark):
    aliases = [("pay", "payment", "spring", 0.95, 1)]
    assert binding(spark, "payment-service", aliases).reason == "exact"
    hit = binding(spark, "payments", aliases)
    assert (hit.reason, round(hit.confidence, 4)) == ("stem", 0.9025)
    assert binding(spark, "payment", aliases, "pay") is None
    assert binding(spark, "inventory", aliases) is None
    hit = binding(spark, "core-payment", aliases)
    assert (hit.reason, hit.confidence) == ("subset", 0.7)


def test_subset_fold_prefers_later_alias(spark):
    """Raw confidence against the scaled one: among equals the later alias wins."""
    aliases = [("a", "x-order", "s", 0.8, 1), ("b", "y-order", "s", 0.8, 2)]
    assert binding(spark, "order", aliases).repo == "b"


def test_reconcile_merges(spark):
    aliases = spark.createDataFrame([("pay", "payment", "config", 1.0, 1)], ALIAS)
    deps = spark.createDataFrame([("order", "payments", ["http"], 0.7, ["a"], "inferred", 1), ("order", "payment-service", ["feign"], 0.95, ["b"], "call-site", 2), ("order", "requests2", ["import"], 0.3, ["c"], "import", 3), ("order", "https://outside.io", ["http"], 1.0, ["d"], "call-site", 4)], DEP)
    got = {r.to_repo: r for r in reconcile.reconcile(deps, aliases).collect()}
    assert set(got) == {"pay", "https://outside.io"}
    assert got["pay"].dep_types == ["http", "feign"] and got["pay"].tier == "call-site" and got["pay"].confidence == 1.0
    assert got["pay"].evidence == ["a", "resolved:stem(config)", "b", "resolved:exact(config)"]
    assert reconcile.stats(deps, aliases).first().asDict() == {"resolved": 2, "dropped_self": 0, "merged": 1, "unresolved": 2}


def kinds(spark, method, path, routes):
    s = spark.createDataFrame([(1, "web", "pss", method, path)], "id long, from_repo string, repo string, method string, path string")
    r = spark.createDataFrame(routes, "repo string, method string, path string")
    return surfaces.match_surfaces(s, r).first().match_kind


@pytest.mark.parametrize("method,path,routes,want", [
    ("POST", "/pss/create-pnr", [("pss", "POST", "/create-pnr")], "prefix"), ("POST", "/create-pnr", [("pss", "POST", "/pss/create-pnr")], "prefix"), ("POST", "/x-create-pnr", [("pss", "POST", "/create-pnr")], "none"),
    ("GET", "/create-pnr", [("pss", "POST", "/create-pnr")], "none"), ("POST", "/create-pnr", [("web", "POST", "/create-pnr")], "none"), ("GET", "/o/7", [("pss", "", "/o/{id}")], "exact"), ("", "/o", [("pss", "PUT", "/o")], "exact"), ("GET", "/", [("pss", "GET", "/a")], "none"),
])
def test_match_kinds(spark, method, path, routes, want):
    assert kinds(spark, method, path, routes) == want


def test_match_against_all_pairs(spark):
    rng = random.Random(4)
    path = lambda: "/" + "/".join(rng.choices("ab", k=rng.randint(0, 4)))
    routes = [(rng.choice("xy"), rng.choice(["GET", "POST", "ANY"]), path()) for _ in range(25)]
    asked = [(i, "w", rng.choice("xy"), rng.choice(["GET", "POST", "ANY"]), path()) for i in range(120)]
    got = {r.id: r.match_kind for r in surfaces.match_surfaces(spark.createDataFrame(asked, "id long, from_repo string, repo string, method string, path string"), spark.createDataFrame(routes, "repo string, method string, path string")).collect()}
    fits = lambda a, b: "ANY" in (a, b) or a == b
    for i, _, repo, m, p in asked:
        p = p.rstrip("/") or "/"
        own = [(v, q.rstrip("/") or "/") for r, v, q in routes if r == repo and fits(v, m)]
        want = "exact" if any(q == p for _, q in own) else "prefix" if p != "/" and any(q != "/" and (q.endswith(p) or p.endswith(q)) for _, q in own) else "none"
        assert got[i] == want, (i, p, own)


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "from_repo string, to_repo string")


def test_blast_radius_counts_like_the_reference(spark):
    e = edges(spark, ("order", "payment"), ("checkout", "order"), ("web", "checkout"), ("payment", "web"))
    start = spark.createDataFrame([("payment",)], "origin string")
    nodes = lambda d: sorted(r.node for r in traversal.blast_radius(e, start, d).collect())
    assert nodes(1) == [] and nodes(2) == ["order"] and nodes(3) == ["checkout", "order"] and nodes(9) == ["checkout", "order", "web"]
    assert {(r.node, r.hops) for r in traversal.reached(e, start).collect()} == {("payment", 0), ("order", 1), ("checkout", 2), ("web", 3)}


def test_affected(spark):
    e = edges(spark, ("a", "t"), ("b", "t"), ("t", "c"))
    deps = e.withColumn("confidence", F.when(F.col("from_repo") == "b", 0.9).otherwise(0.5))
    got = [r.repo for r in traversal.affected(e, deps, "t", None, True).orderBy("ord").collect()]
    assert got == ["t", "b", "a", "c"]


def test_fanout(spark):
    sym = spark.createDataFrame([("r", "C.java", "method", "create", "C.create", 10, 20, 1), ("r", "S.java", "method", "save", "S.save", 1, 30, 2), ("r", "D.java", "method", "post", "D.post", 5, 9, 3)], "repo string, file string, kind string, name string, qualified_name string, start_line int, end_line int, ord long")
    calls = spark.createDataFrame([("r", "C.create", "save"), ("r", "S.save", "post")], "repo string, caller string, callee_name string")
    routes = spark.createDataFrame([("r", "POST", "/pnr", "src/C.java", 11)], "repo string, method string, path string, file string, line int")
    out = spark.createDataFrame([("r", "doli", "POST /v1/x", "D.java", 7)], "repo string, target string, key string, file string, line int")
    got = fanout.endpoint_fanout(routes, sym, calls, out).collect()
    assert [(r.ep_key, r.target, r.hops, r.confidence, r.via) for r in got] == [("POST /pnr", "doli", 2, 0.6, ["create", "save", "post"])]
    assert fanout.endpoint_fanout(routes, sym, calls, out, 1).count() == 0


def test_whole_depth_queries(spark, monkeypatch):
    """A chain of calls, each in its file: the queries go 4 calls deep, and no further."""
    from meshlens.plans import queries
    from meshlens.plans import workload as W

    sym = spark.createDataFrame([("s", f"F{i}.java", "java", "method", f"f{i}", f"A.f{i}", "", 1, 9, i) for i in range(1, 8)], "repo string, file string, language string, kind string, name string, qualified_name string, signature string, start_line int, end_line int, ord long")
    views = {
        "symbols": sym, "part_calls": spark.createDataFrame([("s", f"A.f{i}", f"f{i + 1}") for i in range(1, 7)], "repo string, caller string, callee_name string"),
        "part_routes": spark.createDataFrame([("s", "GET", "/a", "F1.java", 2)], "repo string, method string, path string, file string, line int"),
        "part_surfaces": spark.createDataFrame([("s", f"t{i}", "GET /k", f"F{i}.java", 3) for i in range(1, 8)], "repo string, target string, key string, file string, line int"),
    }
    for name, df in views.items():
        monkeypatch.setattr(W, name, lambda spark, sf, df=df: df)
    got = {r.target: (r.hops, r.confidence) for r in queries.QUERIES["endpoint_fanout_whole"](spark, "").collect()}
    assert got == {"t1": (0, 0.9), "t2": (1, 0.75), "t3": (2, 0.6), "t4": (3, 0.45), "t5": (4, 0.4)}
    assert {r.node: r.hops for r in queries.QUERIES["callgraph_reach_whole"](spark, "").collect()} == {f"s/A.f{i}": i - 1 for i in range(1, 6)}


def test_types_of_one_ord(spark):
    """Types that begin at one ord stand by the least evidence of all their signals, then by place, then by name."""
    rows = [("a", "b", t, 0.5, e, "config", o, p) for t, e, o, p in [("http", "o10:1", 101, 1), ("import", "o10:1", 101, 2), ("import", "o100:1", 1001, 3), ("x", "o10:1", 101, 0)]]
    schema = "from_repo string, to_repo string, dep_type string, confidence double, evidence string, tier string, ord long, place long"
    signals = spark.createDataFrame(rows, schema)
    assert resolve.resolve(signals).first().dep_types == ["import", "x", "http"]
    assert resolve.resolve(signals.drop("place")).first().dep_types == ["import", "http", "x"]


def test_lines_of_one_number_stand_by_their_place(spark, tmp_path):
    """Two lines of one number call one part: the type of the line that stands first in the table comes first."""
    lines = [(order, number, part, flag) for order, flags in ((1, "RA"), (2, "NR"), (3, "AN"), (4, "RN")) for number, part, flag in [(1, order * 10, flags[0]), (1, order * 10, flags[1]), (2, 99, "R")]]
    table = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").withColumns({"l_discount": F.lit(0.05), "l_linestatus": F.lit("O")})
    table.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.from_repo: r.types for r in queries.resolve_edges(spark, str(tmp_path)).collect()}
    assert got == {"p10": "import,http", "p20": "kafka,import", "p30": "http,kafka", "p40": "import,kafka"}


def test_resolve_keeps_order(spark):
    rows = [("a", "b", "http", 0.4, "x:2", "inferred", 2), ("a", "b", "feign", 0.9, "x:1", "config", 1), ("a", "b", "http", 0.4, "x:2", "inferred", 3), ("a", "a", "http", 1.0, "s", "config", 4)]
    got = resolve.resolve(spark.createDataFrame(rows, "from_repo string, to_repo string, dep_type string, confidence double, evidence string, tier string, ord long")).collect()
    assert [(r.dep_types, r.confidence, r.evidence, r.tier) for r in got] == [(["feign", "http"], 0.9, ["x:1", "x:2", "x:2"], "config")]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.update("deps", edges(spark, ("a", "b")).withColumn("c", F.lit(1)), ["from_repo", "to_repo"])
    s.update("deps", edges(spark, ("a", "b"), ("a", "c")).withColumn("c", F.lit(2)), ["from_repo", "to_repo"])
    assert sorted(map(tuple, s.read("deps").collect())) == [("a", "b", 2), ("a", "c", 2)]
    old = spark.createDataFrame([("r", "x", "manual"), ("r", "y", "git"), ("q", "z", "git")], "repo string, alias string, source string")
    new = spark.createDataFrame([("r", "w", "git")], old.schema)
    got = store.replace_aliases(old, new, spark.createDataFrame([("r",)], "name string"))
    assert sorted(map(tuple, got.collect())) == [("q", "z", "git"), ("r", "w", "git"), ("r", "x", "manual")]


def test_search_is_case_insensitive(spark):
    sym = spark.createDataFrame([("r", "f", 1, 1, n) for n in ("getUser", "user", "USERS", "other")], "repo string, file string, start_line int, ord long, name string")
    assert [r.name for r in lookups.search_symbols(sym, "user").collect()] == ["user", "USERS", "getUser"]
