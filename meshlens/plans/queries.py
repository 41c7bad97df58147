"""The queries over the driver's tables, one per operator or small family of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlens.functions import identity as I
from meshlens.functions import paths as P
from meshlens.functions import predicates as R
from meshlens.operators.checkpoints import written
from meshlens.operators import documents, exports, fanout, lookups, memory, reconcile, resolve, skills, store, surfaces, traversal
from meshlens.plans import workload as W
from meshlens.sources import calls, code, configs, identities
from meshlens.sources.heads import heads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
START = "p1"  # the part whose surroundings the graph queries walk


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _urls(spark, sf):
    return W.table(spark, sf, "pages").select("page_id", "url")


def _start(spark):
    return spark.createDataFrame([(START,)], "origin string")


@query
def normalize_path(spark, sf):
    return _urls(spark, sf).select("page_id", P.normalize_path(F.col("url")).alias("path"))


@query
def endpoint_key(spark, sf):
    return W.routes(spark, sf).select("repo", P.endpoint_key(F.col("method"), F.col("path")).alias("key")).groupBy("repo", "key").agg(F.count("*").alias("n"))


@query
def split_host_path(spark, sf):
    s = P.split_host_path(F.col("url"))
    return _urls(spark, sf).select("page_id", s["host"].alias("host"), s["path"].alias("path"))


@query
def normalize_identity(spark, sf):
    return _urls(spark, sf).select("page_id", I.normalize_identity(F.col("url")).alias("identity"))


@query
def stem_identity(spark, sf):
    return W.references(spark, sf).select("ord", I.stem(I.normalize_identity(F.col("to_repo"))).alias("stem"))


@query
def service_from_url(spark, sf):
    return _urls(spark, sf).select("page_id", I.service_from_url(F.col("url")).alias("service"))


@query
def import_name_normalize(spark, sf):
    dotted = F.concat_ws(".", F.lit("com"), F.regexp_replace("p_name", " ", "."), F.lower("p_type"), F.lit("Client"))
    return W.table(spark, sf, "part").select("p_partkey", I.import_name(dotted).alias("name"))


@query
def value_holder_filter(spark, sf):
    module = F.concat(F.lit("com.shop."), F.regexp_replace("p_name", " ", "/"), F.when(F.col("p_size") > 25, "Config").otherwise("Client"))
    return W.table(spark, sf, "part").select("p_partkey", module.alias("module")).where(~R.is_value_holder(F.col("module")))


@query
def namespace_noise_filter(spark, sf):
    url = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("http://www.w3.org/"), "page_id")).when(F.col("page_id") % 5 == 1, F.concat(F.lit("$ENV:http://schemas.xmlsoap.org/soap/"), "page_id")).otherwise(F.col("url"))
    return _urls(spark, sf).select("page_id", R.is_namespace_noise(url).alias("noise"))


@query
def target_scoring(spark, sf):
    kind = F.col("page_id") % 4
    target = F.when(kind == 0, F.col("url")).when(kind == 1, F.concat(F.lit("$ENV:HOST_"), "page_id")).when(kind == 2, F.concat(F.lit("os.getenv('URL_"), "page_id", F.lit("')"))).otherwise(F.concat(F.lit("base/"), "page_id"))
    s = R.score_target(target)
    return _urls(spark, sf).select("page_id", s["target"].alias("target"), s["confidence"].alias("confidence"), s["tier"].alias("tier"))


@query
def config_properties_parse(spark, sf):
    """Pages' URLs as lines of a properties file: parsed, kept where they look like HTTP targets."""
    line = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("svc.url = "), "url")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("db.host: jdbc:x//"), "page_id")).when(F.col("page_id") % 4 == 2, F.concat(F.lit("# "), "url")).otherwise(F.concat(F.lit("api.host="), "page_id", F.lit(".internal:80")))
    from meshlens.sources.configs import property_of

    p = property_of(line)
    rows = _urls(spark, sf).select("page_id", p["key"].alias("key"), p["value"].alias("value"))
    return rows.where(R.looks_like_http_target(F.col("key"), F.col("value")))


@query
def placeholder_resolve(spark, sf):
    kind = F.col("n_nationkey") % 3
    value = F.when(kind == 0, F.concat(F.lit("${CTX:/"), F.lower("n_name"), F.lit("}"))).when(kind == 1, F.lit("${CTX}")).otherwise(F.concat(F.lit("'/"), F.lower("n_name"), F.lit("'")))
    return W.table(spark, sf, "nation").select("n_nationkey", R.resolve_placeholder(value).alias("value"))


@query
def base_path_fold(spark, sf):
    bases = spark.createDataFrame([("spring", "/api/v2")], "framework string, base string")
    return surfaces.fold_base_paths(W.routes(spark, sf), bases).groupBy("repo", "method", "path").agg(F.count("*").alias("n"))


def _flat(deps):
    return deps.select("from_repo", "to_repo", F.array_join("dep_types", ",").alias("types"), "confidence", F.array_join("evidence", ",").alias("evidence"), "tier")


@query
def resolve_edges(spark, sf):
    return _flat(W.dependencies(spark, sf))


@query
def config_first_wins(spark, sf):
    return resolve.first_per(W.lines(spark, sf).select("from_repo", "to_repo", "evidence", "ord"), ["from_repo", "to_repo"], "ord", "evidence").select("from_repo", "to_repo", "evidence")


@query
def identity_dedupe(spark, sf):
    return resolve.first_per(W.aliases(spark, sf), ["repo", "alias"], F.desc("confidence"), "ord").select("repo", "alias", "raw", "source", "confidence")


def _bound(spark, sf):
    refs = W.references(spark, sf).select(F.col("to_repo").alias("ref"), F.col("from_repo").alias("exclude"))
    return reconcile.bind(refs, W.aliases(spark, sf)).select("ref", "exclude", "match.repo", "match.confidence", "match.source", "match.reason")


@query
def reconcile_exact(spark, sf):
    return _bound(spark, sf).where("reason = 'exact'")


@query
def reconcile_stem(spark, sf):
    return _bound(spark, sf).where("reason = 'stem'")


@query
def reconcile_subset(spark, sf):
    return _bound(spark, sf).where("reason = 'subset'")


@query
def reconcile_cascade(spark, sf):
    return _bound(spark, sf)


@query
def reconcile_merge(spark, sf):
    return _flat(reconcile.reconcile(W.references(spark, sf), W.aliases(spark, sf)))


@query
def reconcile_stats(spark, sf):
    return reconcile.stats(W.references(spark, sf), W.aliases(spark, sf))


def _matched(spark, sf):
    return surfaces.match_surfaces(W.surfaces(spark, sf), W.routes(spark, sf))


@query
def surface_match(spark, sf):
    return _matched(spark, sf).select("id", "repo", "match_kind")


@query
def surface_match_stats(spark, sf):
    return surfaces.match_stats(_matched(spark, sf))


@query
def route_verbs(spark, sf):
    return surfaces.route_verbs(W.routes(spark, sf)).select("repo", "path", F.array_join("verbs", ",").alias("verbs"))


@query
def interface_provides(spark, sf):
    return surfaces.provides(W.routes(spark, sf))


@query
def interface_consumes(spark, sf):
    return surfaces.consumes(_matched(spark, sf))


@query
def consumed_flag(spark, sf):
    return surfaces.consumed_routes(W.routes(spark, sf), _matched(spark, sf))


@query
def called_by_endpoint(spark, sf):
    return surfaces.called_by(_matched(spark, sf)).select("repo", "method", "path", F.array_join("callers", ",").alias("callers"))


@query
def impact_endpoint_scoped(spark, sf):
    """Direct dependents of each repository that use exactly one of its keys."""
    used = lookups.endpoint_users(W.surfaces(spark, sf)).select("from_repo", "repo", F.explode("endpoints").alias("key"))
    served = W.routes(spark, sf).select("repo", P.endpoint_key(F.col("method"), F.col("path")).alias("key")).distinct()
    return used.join(served, ["repo", "key"], "left_semi").distinct()


@query
def impact_of_endpoint(spark, sf):
    """The dependents of the part START with the keys they use, those that use GET /k1 alone."""
    deps = W.dependencies(spark, sf)
    used = deps.select("from_repo", F.col("to_repo").alias("repo"), F.lit("GET").alias("method"), F.explode(F.transform("evidence", lambda e: F.concat(F.lit("/k"), F.substring_index(e, ":", -1)))).alias("path"))
    got = lookups.impact_of_endpoint(W.edges(spark, sf), deps, used, START, "get /k1")
    return got.select("from_repo", "confidence", F.array_join("endpoints", ",").alias("endpoints"), "in_blast")


@query
def enclosing_span(spark, sf):
    points = W.calls(spark, sf).select(F.col("ord").alias("id"), F.concat(F.lit("s"), F.col("ord") % 50 + 1).alias("repo"), "file", "line")
    return fanout.enclosing(points, W.symbols(spark, sf))


@query
def call_graph(spark, sf):
    return fanout.call_graph(W.symbols(spark, sf), W.found_calls(spark, sf), W.pair_partitions(spark, sf))


@query
def callgraph_reach(spark, sf):
    return traversal.reached(W.edges(spark, sf), _start(spark), 4, forward=True).select("node", "hops")


@query
def callgraph_reach_whole(spark, sf):
    """START's symbol and what it reaches in the call graph in up to 4 calls."""
    start = W.symbols(spark, sf).where(F.concat(F.lit("p"), "ord") == START).select("repo", F.col("qualified_name").alias("node"))
    return fanout.call_reach(W.symbols(spark, sf), W.part_calls(spark, sf), start, 4).select(F.concat_ws("/", "repo", "node").alias("node"), "hops")


@query
def endpoint_fanout(spark, sf):
    return W.fanned(spark, sf).select("repo", "ep_key", "target", "key", "hops", "confidence")


@query
def endpoint_fanout_whole(spark, sf):
    """As endpoint_fanout, with the shortest path, of equally short ones the first by names."""
    return W.fanned(spark, sf).select("repo", "ep_key", "target", "key", "hops", "confidence", F.array_join("via", ">").alias("via"))


@query
def route_calls(spark, sf):
    """The stored fan-out of one repository, in the order of its display."""
    got = fanout.route_calls(W.fanned(spark, sf), "s11")
    return got.select(F.row_number().over(Window.orderBy(F.substring_index("ep_key", " ", -1), F.substring_index("ep_key", " ", 1), "hops", "target", "key")).alias("place"), "ep_key", "target", "key", "hops")


@query
def routes_with_calls(spark, sf):
    got = fanout.routes_with_calls(W.part_routes(spark, sf), W.fanned(spark, sf))
    return got.select("repo", "ep_key", F.size("calls").cast("long").alias("n"), F.array_join(F.transform("calls", lambda c: F.concat_ws(" ", c["hops"], c["target"], c["key"])), ",").alias("calls"))


@query
def dependencies_of(spark, sf):
    return lookups.dependencies_of(W.dependencies(spark, sf), START).select("to_repo", "confidence")


@query
def dependents_of(spark, sf):
    return lookups.dependents_of(W.dependencies(spark, sf), START).select("from_repo", "confidence")


@query
def blast_radius_d3(spark, sf):
    return traversal.blast_radius(W.edges(spark, sf), _start(spark), 3).select("node")


@query
def blast_radius_d2(spark, sf):
    return traversal.blast_radius(W.edges(spark, sf), _start(spark), 2).select("node")


@query
def blast_by_hop(spark, sf):
    """Everything that depends on START at any distance, by the fewest hops."""
    return traversal.reached(W.edges(spark, sf), _start(spark)).select("node", "hops")


@query
def affected_repos(spark, sf):
    got = traversal.affected(W.edges(spark, sf), W.dependencies(spark, sf).select("from_repo", "to_repo", "confidence"), START, None, True)
    return got.select("repo", F.col("ord.part").alias("part"))


@query
def graph_summary(spark, sf):
    return traversal.summary(W.lines(spark, sf))


@query
def degree(spark, sf):
    return traversal.degrees(W.edges(spark, sf))


@query
def orphans(spark, sf):
    """Nodes that no message reaches, among the messages' senders and topics."""
    return traversal.degrees(W.lines(spark, sf).where("dep_type = 'kafka'")).where("in_degree = 0").select("node")


@query
def search_symbols(spark, sf):
    return lookups.search_symbols(W.symbols(spark, sf), "Ring").select("name", "repo", "file", "start_line", "qualified_name")


@query
def search_symbol_postings(spark, sf):
    """The same search by way of the names' postings."""
    symbols = W.symbols(spark, sf)
    return lookups.search_postings(symbols, lookups.name_postings(symbols), "Ring").select("name", "repo", "file", "start_line", "qualified_name")


@query
def get_callers(spark, sf):
    return lookups.callers(W.calls(spark, sf), "click").select("repo", "file", "line", "ord")


@query
def symbols_for_repo(spark, sf):
    return lookups.symbols_for(W.symbols(spark, sf), "s11", ["method"]).select("file", "start_line", "qualified_name")


@query
def cross_repo_call_sites(spark, sf):
    calls = W.part_calls(spark, sf).select("repo", F.col("caller").alias("file"), "callee_name", F.length("caller").alias("line"))
    return lookups.cross_repo_call_sites(W.symbols(spark, sf), calls, "s11")


@query
def impact_report(spark, sf):
    return lookups.impact(W.edges(spark, sf), W.dependencies(spark, sf), START)


@query
def events_emitted(spark, sf):
    return lookups.events_emitted(W.dependencies(spark, sf))


@query
def snapshot_hash(spark, sf):
    sym = W.symbols(spark, sf).select(F.concat(F.lit("p"), "ord").alias("repo"), "qualified_name", "signature")
    return lookups.snapshot_hash(sym, W.dependencies(spark, sf))


@query
def recall_memory(spark, sf):
    return memory.recall(W.notes(spark, sf), "c3", "gotcha").select("id", "note")


@query
def remember_notes(spark, sf):
    """Users' turns are there; the others' come behind them, of no known kind."""
    rows = W.notes(spark, sf)
    new = rows.where("kind <> 'gotcha'").withColumn("at", F.col("id"))
    return memory.remember(rows.where("kind = 'gotcha'"), new.drop("id"), "at").select("id", "repo", "kind")


@query
def forget_notes(spark, sf):
    return memory.forget(W.notes(spark, sf), W.notes(spark, sf).where("id % 7 = 0").select("id")).select("id", "kind")


@query
def alias_replace_keep_manual(spark, sf):
    old = W.aliases(spark, sf).withColumn("source", F.when(F.col("ord") % 6 < 2, "manual").otherwise(F.col("source"))).select("repo", "alias", "source").distinct()
    new = W.aliases(spark, sf).where("source = 'package'").select("repo", "alias", "source").distinct()
    return store.replace_aliases(old, new, W.pages(spark, sf).select(F.col("word").alias("name")))


@query
def dependency_upsert(spark, sf):
    deps = W.dependencies(spark, sf).select("from_repo", "to_repo", "confidence", "tier")
    new = W.lines(spark, sf).groupBy("from_repo", "to_repo").agg(F.min("confidence").alias("confidence"), F.lit("config").alias("tier")).where("confidence >= 0.7")
    return store.upsert(deps, new, ["from_repo", "to_repo"])


@query
def confidence_labels(spark, sf):
    return lookups.confidence_buckets(W.dependencies(spark, sf))


@query
def ui_nodes(spark, sf):
    return lookups.ui_nodes(W.references(spark, sf).select("from_repo", "to_repo"), W.pages(spark, sf).select(F.col("word").alias("name")))


@query
def ui_edges(spark, sf):
    return lookups.ui_edges(W.dependencies(spark, sf))


def _seen(spark, sf):
    nodes = lookups.ui_nodes(W.calls_between(spark, sf), W.pages(spark, sf).select(F.col("word").alias("name")).union(spark.createDataFrame([("front0",), ("front1",)], "name string")))
    return W.calls_between(spark, sf), nodes


@query
def visible_graph(spark, sf):
    edges, nodes = _seen(spark, sf)
    return lookups.visible_graph(edges, nodes, 0.2, external=False)


@query
def visible_neighbours(spark, sf):
    """Edges within the neighbourhood of one repository, imports and weak ones left out."""
    edges, nodes = _seen(spark, sf)
    return lookups.visible_graph(edges, nodes, 0.5, focus="front2").groupBy("from_repo", "to_repo").agg(F.count("*").alias("n"))


@query
def visible_nodes(spark, sf):
    edges, nodes = _seen(spark, sf)
    return lookups.visible_nodes(lookups.visible_graph(edges, nodes, 0.8), nodes, " ION").select("node", "external", "found")


@query
def neighbourhood(spark, sf):
    return lookups.neighbourhood(W.edges(spark, sf), START)


@query
def aliases_of_repo(spark, sf):
    return lookups.aliases_of(W.aliases(spark, sf), "tionsh").select("alias", "raw", "source", "confidence")


@query
def aliases_by_repo(spark, sf):
    return lookups.aliases_by_repo(W.aliases(spark, sf)).select("repo", F.array_join(F.transform("names", lambda n: F.concat_ws(":", n["source"], n["alias"])), ",").alias("names"))


@query
def alias_remove(spark, sf):
    """Every word loses the alias of its name with -service, and its host's by the raw value on some pages."""
    gone = W.pages(spark, sf).select(F.col("word").alias("repo"), F.when(F.col("page_id") % 2 == 0, F.concat("word", F.lit("-service"))).otherwise(F.col("host")).alias("name")).where("page_id % 3 = 0").distinct()
    return store.remove_aliases(W.aliases(spark, sf), gone).select("repo", "alias", "raw", "ord")


@query
def repos_by_name(spark, sf):
    return lookups.repos_by_name(W.repos(spark, sf))


@query
def routes_of_repo(spark, sf):
    return lookups.routes_of(W.routes(spark, sf), "tionsh").select("path", "method", "framework", "file", "line")


@query
def export_round_trip(spark, sf):
    """Dependencies as lines of JSON and back."""
    text = exports.export_rows(W.dependencies(spark, sf)).select(F.to_json(F.struct("*")).alias("line"))
    rows = text.select(F.from_json("line", exports.EXPORT).alias("r")).select("r.*")
    return _flat(exports.as_dependencies(rows))


def _documents(spark, sf):
    return documents.documents(W.dependencies(spark, sf), W.repos(spark, sf), "2024-01-01T00:00:00")


@query
def document_round_trip(spark, sf):
    """The nested documents, read back as dependencies."""
    return _flat(documents.dependencies(_documents(spark, sf)))


@query
def document_summaries(spark, sf):
    got = documents.parsed(_documents(spark, sf))
    return got.select("repo", F.col("doc.repo.path").alias("path"), "doc.summary.total_deps", "doc.summary.high_confidence", F.array_join("doc.summary.services_called", ",").alias("services_called"), F.col("corrupt").isNull().alias("whole"))


@query
def document_violations(spark, sf):
    """Documents of which a fourth names an unknown tier, a fourth lacks its version, and a fourth is cut off."""
    k = F.substring("repo", 2, 20).cast("long") % 4
    text = F.when(k == 1, F.regexp_replace("document", '"tier":"call-site"', '"tier":"certain"')).when(k == 2, F.replace("document", F.lit('"version":"1.0",'), F.lit(""))).when(k == 3, F.substr("document", F.lit(1), F.lit(40))).otherwise(F.col("document"))
    return documents.violations(_documents(spark, sf).select("repo", text.alias("document")))


@query
def impact_of_symbol(spark, sf):
    """Where a name is defined, and which other repositories call it."""
    return lookups.impact_of_symbol(W.symbols(spark, sf), W.calls(spark, sf).withColumn("callee_name", F.when(F.col("callee_name") == "click", "Ring").otherwise(F.col("callee_name"))), "u7", "Ring")


@query
def export_evidence(spark, sf):
    rows = exports.export_rows(W.dependencies(spark, sf), START)
    return rows.select("to_repo", F.explode("evidence").alias("e")).select("to_repo", "e.file", "e.line")


@query
def export_summary(spark, sf):
    return exports.export_summary(W.dependencies(spark, sf))


@query
def group_map(spark, sf):
    return exports.group_map(W.dependencies(spark, sf))


@query
def interfaces_manifest(spark, sf):
    got = exports.interfaces(W.routes(spark, sf), _matched(spark, sf))
    return got.select("repo", F.array_join("provides", ",").alias("provides"), F.array_join("consumes", ",").alias("consumes"))


@query
def scan_summary(spark, sf):
    return exports.scan_summary(W.calls_between(spark, sf), _matched(spark, sf))


@query
def top_targets(spark, sf):
    return fanout.top_rows(W.dependencies(spark, sf).select("from_repo", "to_repo", "confidence"), 3, F.desc("confidence"), "to_repo", per=["from_repo"])


@query
def skill_descriptions(spark, sf):
    return skills.descriptions(W.dependencies(spark, sf), W.repos(spark, sf))


@query
def skill_registry(spark, sf):
    return skills.registry(W.dependencies(spark, sf), W.repos(spark, sf), W.part_symbols(spark, sf)).select("repo", "version", "languages")


@query
def skill_documents(spark, sf):
    notes = W.notes(spark, sf).withColumn("repo", F.concat(F.lit("p"), F.col("id") % 97))
    return skills.documents(W.dependencies(spark, sf), W.repos(spark, sf), W.part_symbols(spark, sf), notes)


@query
def ui_payload(spark, sf):
    """One JSON object a node, taken apart again for the comparison."""
    words = W.pages(spark, sf).select(F.col("word").alias("name")).distinct()
    routes = W.routes(spark, sf).select("repo", P.endpoint_key(F.col("method"), F.col("path")).alias("ep_key")).distinct().withColumn("calls", F.array().cast("array<int>"))
    payload = lookups.ui_payload(W.calls_between(spark, sf), words, W.aliases(spark, sf), routes)
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    return payload.select("node", field("external").alias("external"), field("in_degree").cast("long").alias("in_degree"), field("names[0].alias").alias("alias"), field("provides[0].ep_key").alias("endpoint"))


@query
def skill_metadata(spark, sf):
    return lookups.skill_metadata(W.dependencies(spark, sf), W.repos(spark, sf))


@query
def languages(spark, sf):
    return lookups.languages(W.symbols(spark, sf))


@query
def evidence_parse(spark, sf):
    e = P.evidence(F.col("evidence"))
    return W.lines(spark, sf).select("evidence").distinct().select("evidence", e["file"].alias("file"), e["line"].alias("line"))


@query
def import_only_filter(spark, sf):
    return resolve.without_import_only(W.dependencies(spark, sf)).select("from_repo", "to_repo")


@query
def fuzzy_cross_resolve(spark, sf):
    """References whose name holds a repository's or lies within it, both without hyphens and underscores: bound to the first
    such repository by name, 0.2 more confident."""
    return reconcile.contained_names(W.references(spark, sf).select("to_repo", "confidence", "ord"), W.pages(spark, sf).select(F.col("word").alias("repo")).distinct())


@query
def code_statements(spark, sf):
    """Lines outside comments, each with the rest of its statement."""
    return W.code_lines(spark, sf).where("trim(text) <> ''").groupBy("language", "line").agg(F.count("*").alias("n"), F.max(F.length("more") > F.length("text")).alias("goes_on"))


@query
def code_imports(spark, sf):
    return code.imports(W.code_lines(spark, sf))


@query
def code_http_calls(spark, sf):
    return calls.http_calls(W.code_heads(spark, sf), code.variables(W.code_lines(spark, sf))).select("repo", "path", "line", "method", "target", "confidence", "tier")


@query
def code_varied_calls(spark, sf):
    """Calls of files that differ: several on a line, commas and brackets in arguments, texts, comments and patterns that look like calls."""
    files = W.varied_files(spark, sf)
    return calls.http_calls(written(heads(files)), code.variables(code.lines(files, W.file_partitions(spark, sf)))).select("repo", "path", "line", "method", "target", "confidence", "tier")


@query
def code_mounted_routes(spark, sf):
    """Express routes of the same files, below what they are mounted at, or known by their handlers."""
    return calls.express_routes(written(heads(W.varied_files(spark, sf))))


@query
def code_feign_surfaces(spark, sf):
    """What declared clients' methods ask for."""
    files = W.varied_files(spark, sf).where("language = 'java'")
    return calls.feign_surfaces(written(heads(files)), code.symbols(code.lines(files, W.file_partitions(spark, sf))))


@query
def code_wrapped_axios(spark, sf):
    return calls.wrapped_axios(W.code_heads(spark, sf), code.variables(W.code_lines(spark, sf)))


@query
def code_soap_calls(spark, sf):
    return calls.soap_calls(W.code_heads(spark, sf), code.variables(W.code_lines(spark, sf)))


@query
def code_web_client_calls(spark, sf):
    return calls.web_client_calls(W.code_heads(spark, sf))


@query
def code_messages(spark, sf):
    return calls.messages(W.code_heads(spark, sf), code.imports(W.code_lines(spark, sf)))


@query
def code_feign_clients(spark, sf):
    return calls.feign_clients(W.code_heads(spark, sf)).select("repo", "path", "line", "target")


@query
def code_routes(spark, sf):
    return code.routes(W.code_lines(spark, sf), W.code_heads(spark, sf)).select("repo", "path", "line", "method", "route", "framework")


@query
def code_symbols(spark, sf):
    return code.symbols(W.code_lines(spark, sf)).select("repo", "file", "kind", "qualified_name", "signature", "start_line", "end_line")


@query
def code_call_sites(spark, sf):
    """Calls of a file's own functions, with the symbol around them."""
    rows = W.code_lines(spark, sf)
    return code.call_sites(rows, code.symbols(rows)).where("callee_name in ('one', 'load')").select("repo", "file", "caller", "callee_name", "line")


@query
def config_targets(spark, sf):
    return configs.targets(W.config_files(spark, sf).where("path like '%.properties'")).select("repo", "line", "target")


@query
def declared_identities(spark, sf):
    named = W.pages(spark, sf).select(F.concat(F.lit("r"), "page_id").alias("name"))
    return identities.identities(named, W.config_files(spark, sf)).select("repo", "alias", "raw", "source", "confidence")


@query
def declared_documents(spark, sf):
    named = W.pages(spark, sf).select(F.concat(F.lit("d"), "page_id").alias("name"))
    return identities.identities(named, W.declared_files(spark, sf)).select("repo", "alias", "raw", "source", "confidence")


@query
def declared_base_paths(spark, sf):
    return identities.base_paths(W.config_files(spark, sf))
