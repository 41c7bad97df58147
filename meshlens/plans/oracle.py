"""The queries in DuckDB's SQL, written from the operators' definitions: the independent side of each comparison."""

from __future__ import annotations

from meshlens.functions.identity import GENERIC, IMPORT_STOPWORDS
from meshlens.functions.predicates import NAMESPACE_HOSTS, NAMESPACE_MARKERS, VALUE_HOLDERS


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def norm_path(x: str) -> str:
    param = r"(\{[^}]*\}|:[A-Za-z_][\w-]*|\$\{[^}]*\}|<[^>]*>|\d+|[0-9a-fA-F-]{16,})"
    bare = rf"split_part(split_part(regexp_replace(coalesce({x}, ''), '^[a-zA-Z]+://[^/]+', ''), '?', 1), '#', 1)"
    return rf"('/' || array_to_string([CASE WHEN regexp_full_match(s, '{param}') OR regexp_matches(s, '\$?\{{[^}}]*\}}') THEN '{{}}' ELSE lower(s) END FOR s IN string_split({bare}, '/') IF s <> ''], '/'))"


def key(method: str, path: str) -> str:
    return f"(upper(trim(CASE WHEN coalesce({method}, '') = '' THEN 'ANY' ELSE {method} END)) || ' ' || {norm_path(path)})"


def identity(x: str) -> str:
    s = rf"regexp_replace(regexp_replace(lower(trim({x})), '^\$env:', ''), '^https?://', '')"
    s = rf"split_part(split_part({s}, '/', 1), ':', 1)"
    s = rf"regexp_replace(regexp_replace({s}, '\.(internal|local|svc\.cluster\.local|cluster\.local|com|io|net|org|dev)$', ''), '[._\s]+', '-', 'g')"
    parts = f"[t FOR t IN string_split({s}, '-') IF t <> '']"
    core = f"[t FOR t IN string_split({s}, '-') IF t <> '' AND t NOT IN {_in(GENERIC)}]"
    return f"array_to_string(CASE WHEN len({core}) > 0 THEN {core} ELSE {parts} END, '-')"


def stem(x: str) -> str:
    return rf"regexp_replace({x}, '(^|-)([^-]{{3,}})s$', '\1\2')"


def tokens(x: str) -> str:
    return f"list_distinct([t FOR t IN string_split({x}, '-') IF length(t) >= 3])"


HOST = r"CASE WHEN regexp_matches(url, '^[a-zA-Z]+://') THEN regexp_extract(url, '^[a-zA-Z]+://([^/]+)', 1) ELSE '' END"
PATH = r"CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/]+(/.*)?$', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/]+(/.*)?$', 1) END"

VIEWS = {
    "lines": """SELECT 'p' || a.l_partkey AS from_repo, 'p' || b.l_partkey AS to_repo,
        CASE a.l_returnflag WHEN 'A' THEN 'http' WHEN 'N' THEN 'kafka' ELSE 'import' END AS dep_type,
        (CAST(round(a.l_discount * 100) AS INTEGER) * 5 + 50) / 100.0::DOUBLE AS confidence, 'o' || a.l_orderkey || ':' || a.l_linenumber AS evidence,
        CASE WHEN a.l_linestatus = 'O' THEN 'call-site' ELSE 'config' END AS tier, a.l_orderkey * 10 + a.l_linenumber AS ord
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey""",
    "edges": "SELECT DISTINCT from_repo, to_repo FROM lines",
    "types": "SELECT from_repo, to_repo, string_agg(dep_type, ',' ORDER BY o, e) AS types, list(dep_type ORDER BY o, e) AS type_list FROM (SELECT from_repo, to_repo, dep_type, min(ord) AS o, min(evidence) AS e FROM lines GROUP BY ALL) GROUP BY ALL",
    "deps": "SELECT l.*, t.types, t.type_list FROM (SELECT from_repo, to_repo, max(confidence) AS confidence, string_agg(evidence, ',' ORDER BY ord, evidence) AS evidence, CASE WHEN bool_or(tier = 'call-site') THEN 'call-site' ELSE 'config' END AS tier FROM lines GROUP BY ALL) l JOIN types t USING (from_repo, to_repo)",
    "pg": f"SELECT *, regexp_extract(host, '([a-z]+)\\.example', 1) AS word FROM (SELECT page_id, url, {HOST} AS host, {PATH} AS path FROM pages)",
    "aliases": f"SELECT word AS repo, {identity('host')} AS alias, host AS raw, 'k8s' AS source, CASE WHEN url LIKE 'https%' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence, page_id * 2 AS ord FROM pg UNION ALL SELECT word, {identity(chr(40) + chr(119) + 'ord || ' + chr(39) + '-service' + chr(39) + chr(41))}, word || '-service', 'package', 0.8::DOUBLE, page_id * 2 + 1 FROM pg",
    "refs": """SELECT CASE WHEN page_id % 5 = 0 THEN word ELSE 'front' END AS from_repo,
        CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN word || 's-svc' WHEN 2 THEN 'core-' || word ELSE 'zz' || page_id || '-external' END AS to_repo,
        CASE WHEN page_id % 3 = 0 THEN 'import' ELSE 'http' END AS dep_type, (page_id % 10) / 10.0::DOUBLE AS confidence, 'e' || page_id AS evidence,
        CASE WHEN page_id % 2 = 0 THEN 'call-site' ELSE 'config' END AS tier, page_id AS ord FROM pg""",
    "routes": "SELECT word AS repo, CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE '' END AS method, path, CASE WHEN page_id % 3 = 0 THEN 'spring' ELSE 'express' END AS framework, 'src/F' || (page_id % 7) || '.java' AS file, CAST(page_id % 100 AS INTEGER) AS line FROM pg",
    "surf": "SELECT page_id AS id, 'front' || (page_id % 5) AS from_repo, word AS repo, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, CASE page_id % 4 WHEN 1 THEN '/gw' || path WHEN 3 THEN '/none' || page_id ELSE path END AS path FROM pg",
    "served": f"SELECT DISTINCT repo, {norm_path('path')} AS path, CASE WHEN method = '' THEN 'ANY' ELSE upper(method) END AS verb FROM routes",
    "matched": f"""SELECT s.*, CASE WHEN bool_or(r.path = s.np AND (r.verb IN ('ANY', s.method))) THEN 'exact' WHEN bool_or(s.np <> '/' AND r.path <> '/' AND r.verb IN ('ANY', s.method) AND (ends_with(s.np, r.path) OR ends_with(r.path, s.np))) THEN 'prefix' ELSE 'none' END AS match_kind
        FROM (SELECT *, {norm_path('path')} AS np FROM surf) s LEFT JOIN served r ON r.repo = s.repo GROUP BY ALL""",
    "sym": "SELECT 's' || p_size AS repo, 'src/F' || (p_partkey % 50) || '.java' AS file, 'java' AS language, CASE WHEN p_partkey % 6 = 0 THEN 'class' ELSE 'method' END AS kind, p_name AS name, p_brand || '.' || p_name || '_' || p_partkey AS qualified_name, p_type AS signature, CAST(p_partkey * 7 % 400 + 1 AS INTEGER) AS start_line, CAST(p_partkey * 7 % 400 + 1 + p_size AS INTEGER) AS end_line, p_partkey AS ord FROM part",
    "part_calls": "SELECT DISTINCT a.repo, a.qualified_name AS caller, b.name AS callee_name FROM edges e JOIN sym a ON 'p' || a.ord = e.from_repo JOIN sym b ON 'p' || b.ord = e.to_repo",
    "cg": "SELECT DISTINCT c.repo, c.caller, s.qualified_name AS callee FROM part_calls c JOIN sym s ON s.repo = c.repo AND s.name = c.callee_name AND s.kind IN ('method', 'function') WHERE c.caller <> s.qualified_name",
    "deg": "SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT from_repo AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT to_repo, 1, 0 FROM edges) GROUP BY node",
    "norm": f"SELECT DISTINCT to_repo AS ref, from_repo AS exclude, {identity('to_repo')} AS norm FROM refs",
    "norm0": f"SELECT DISTINCT to_repo AS ref, '' AS exclude, {identity('to_repo')} AS norm FROM refs",
}

#: Views that each view reads, in order.
NEEDS = {"edges": ["lines"], "types": ["lines"], "deps": ["lines", "types"], "aliases": ["pg"], "refs": ["pg"], "routes": ["pg"], "surf": ["pg"], "served": ["pg", "routes"], "matched": ["pg", "routes", "surf", "served"], "part_calls": ["lines", "edges", "sym"], "cg": ["lines", "edges", "sym", "part_calls"], "deg": ["lines", "edges"], "norm": ["pg", "refs"], "norm0": ["pg", "refs"]}


def with_views(views: str, sql: str, recursive: bool = False, extra: dict[str, str] | None = None) -> str:
    names: list[str] = []
    for v in views.split():
        names += [x for x in [*NEEDS.get(v, []), v] if x not in names]
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {sql}"


def _tier(name: str, alias: str, norm: str, left: str, right: str, scaled: str) -> str:
    return f"SELECT n.ref, n.exclude, arg_max(struct_pack(repo := a.repo, confidence := {scaled}, source := a.source, reason := '{name}'), struct_pack(c := a.confidence, o := -a.ord)) AS m FROM {norm} n JOIN {alias} a ON {left} = {right} WHERE a.repo <> n.exclude AND n.norm <> '' AND a.alias <> '' GROUP BY ALL"


def _bound(norm: str, tag: str) -> dict[str, str]:
    """The cascade as views: exact, stem, then the ordered fold over containment candidates as a recursion."""
    contained = f"(list_has_all({tokens('a.alias')}, {tokens('n.norm')}) OR list_has_all({tokens('n.norm')}, {tokens('a.alias')}))"
    return {
        f"exact{tag}": _tier("exact", "aliases", norm, "n.norm", "a.alias", "least(1.0::DOUBLE, a.confidence)"),
        f"stem{tag}": _tier("stem", "aliases", norm, stem("n.norm"), stem("a.alias"), "least(0.95::DOUBLE, a.confidence * 0.95::DOUBLE)"),
        f"cand{tag}": f"SELECT n.ref, n.exclude, a.alias, p.place, arg_max(struct_pack(repo := a.repo, confidence := a.confidence, source := a.source), struct_pack(c := a.confidence, o := -a.ord)) AS c FROM {norm} n JOIN aliases a ON len({tokens('a.alias')}) > 0 AND len({tokens('n.norm')}) > 0 AND {contained} JOIN (SELECT alias, min(ord) AS place FROM aliases GROUP BY alias) p ON p.alias = a.alias WHERE a.repo <> n.exclude AND n.norm <> '' AND a.alias <> '' GROUP BY ALL",
        f"num{tag}": f"SELECT *, row_number() OVER (PARTITION BY ref, exclude ORDER BY place, alias) AS k FROM cand{tag}",
        f"fold{tag}": f"SELECT ref, exclude, k, c.repo AS repo, least(0.7::DOUBLE, c.confidence * 0.75::DOUBLE) AS confidence, c.source AS source FROM num{tag} WHERE k = 1 UNION ALL SELECT n.ref, n.exclude, n.k, CASE WHEN n.c.confidence > f.confidence THEN n.c.repo ELSE f.repo END, CASE WHEN n.c.confidence > f.confidence THEN least(0.7::DOUBLE, n.c.confidence * 0.75::DOUBLE) ELSE f.confidence END, CASE WHEN n.c.confidence > f.confidence THEN n.c.source ELSE f.source END FROM fold{tag} f JOIN num{tag} n ON n.ref = f.ref AND n.exclude = f.exclude AND n.k = f.k + 1",
        f"subset{tag}": f"SELECT ref, exclude, arg_max(struct_pack(repo := repo, confidence := confidence, source := source, reason := 'subset'), k) AS m FROM fold{tag} GROUP BY ALL",
        f"bound{tag}": f"SELECT n.ref, n.exclude, coalesce(e.m, s.m, u.m) AS m FROM {norm} n LEFT JOIN exact{tag} e USING (ref, exclude) LEFT JOIN stem{tag} s USING (ref, exclude) LEFT JOIN subset{tag} u USING (ref, exclude)",
    }


BOUND = _bound("norm", "") | _bound("norm0", "0")
BIND = "SELECT ref, exclude, m.repo AS repo, m.confidence AS confidence, m.source AS source, m.reason AS reason FROM bound"
DISPOSED = BOUND | {
    "disposed": "SELECT r.*, b.m AS m, CASE WHEN b.m IS NOT NULL THEN 'resolved' WHEN r.dep_type = 'import' THEN 'drop-import' WHEN coalesce(o.m.repo = r.from_repo, false) OR r.to_repo = r.from_repo THEN 'drop-self' ELSE 'keep' END AS disposition, coalesce(b.m.repo, r.to_repo) AS target FROM refs r JOIN bound b ON b.ref = r.to_repo AND b.exclude = r.from_repo JOIN bound0 o ON o.ref = r.to_repo",
    "kept": "SELECT from_repo, target AS to_repo, dep_type, tier, ord, to_repo AS old, least(1.0::DOUBLE, greatest(confidence, coalesce(m.confidence, 0.0::DOUBLE))) AS confidence, CASE WHEN m IS NULL THEN evidence ELSE evidence || ',resolved:' || m.reason || '(' || m.source || ')' END AS evidence FROM disposed WHERE disposition IN ('resolved', 'keep')",
    "kept_types": "SELECT from_repo, to_repo, string_agg(dep_type, ',' ORDER BY o) AS types FROM (SELECT from_repo, to_repo, dep_type, min(ord) AS o FROM kept GROUP BY ALL) GROUP BY ALL",
}


def _walk(limit: str, forward: bool = False) -> dict[str, str]:
    a, b = ("from_repo", "to_repo") if forward else ("to_repo", "from_repo")
    return {"walk": f"SELECT 'p1' AS node, 0 AS hops UNION SELECT e.{b}, w.hops + 1 FROM walk w JOIN edges e ON e.{a} = w.node WHERE w.hops < {limit}", "near": "SELECT node, min(hops) AS hops FROM walk GROUP BY node"}


_ROUTE_KEY = key("method", "path")
_SPANS = "SELECT repo, split_part(file, '/', -1) AS base, qualified_name, start_line, end_line, ord FROM sym WHERE kind IN ('method', 'function')"

_ENCLOSED = "arg_min(s.qualified_name, struct_pack(w := s.end_line - s.start_line, o := s.ord))"

#: What every endpoint's handler reaches in up to 4 calls, by the fewest.
FANNED = {
    "spans": _SPANS,
    "pts": "SELECT ord AS id, repo, split_part(file, '/', -1) AS base, start_line, end_line, 'GET /' || lower(replace(name, ' ', '-')) AS ep_key, 't' || (ord % 9) AS target, 'GET /k' || (ord % 5) AS key FROM sym",
    "handlers": f"SELECT DISTINCT repo, ep_key, q AS node FROM (SELECT p.id, p.repo, p.ep_key, {_ENCLOSED} AS q FROM pts p JOIN spans s ON s.repo = p.repo AND s.base = p.base AND p.start_line BETWEEN s.start_line AND s.end_line GROUP BY ALL)",
    "sinks": f"SELECT DISTINCT repo, q AS node, target, key FROM (SELECT p.id, p.repo, p.target, p.key, {_ENCLOSED} AS q FROM pts p JOIN spans s ON s.repo = p.repo AND s.base = p.base AND p.end_line BETWEEN s.start_line AND s.end_line GROUP BY ALL)",
    "reach": "SELECT repo, ep_key, node, 0 AS hops FROM handlers UNION SELECT r.repo, r.ep_key, c.callee, r.hops + 1 FROM reach r JOIN cg c ON c.repo = r.repo AND c.caller = r.node WHERE r.hops < 4",
    "fanned": "SELECT repo, ep_key, target, key, min(hops) AS hops FROM reach JOIN sinks USING (repo, node) GROUP BY repo, ep_key, target, key",
    "level0": "SELECT repo, ep_key, node, 0 AS hops, [node] AS path FROM handlers",
}
SEEN = {
    "between": "SELECT from_repo, repo AS to_repo, (id % 10) / 10.0::DOUBLE AS confidence, id % 3 = 0 AS import_only FROM surf",
    "known": "SELECT word AS node FROM pg UNION SELECT 'front0' UNION SELECT 'front1'",
    "shown": "SELECT * FROM between WHERE NOT import_only",
    "ends": "SELECT from_repo AS node FROM between UNION SELECT to_repo FROM between",
}
CALLED = "SELECT from_repo AS name, string_agg(to_repo, ', ' ORDER BY confidence DESC, to_repo) AS calls FROM (SELECT *, row_number() OVER (PARTITION BY from_repo ORDER BY confidence DESC, to_repo) AS k FROM deps WHERE NOT list_contains(type_list, 'kafka')) WHERE k <= 3 GROUP BY from_repo"
SKILLS = {
    "calls": CALLED,
    "callers": "SELECT to_repo AS name, count(*) AS n FROM deps GROUP BY to_repo",
    "described": "SELECT 'p' || p_partkey AS repo, 'work-in-p' || p_partkey AS slug, 'How to work in p' || p_partkey || coalesce(' — calls ' || calls, '') || coalesce('; called by ' || n || ' repo(s)', '') || '.' AS description FROM part LEFT JOIN calls c ON c.name = 'p' || p_partkey LEFT JOIN callers r ON r.name = 'p' || p_partkey",
    "psym": "SELECT * REPLACE ('p' || ord AS repo) FROM sym",
    "versions": "SELECT repo, substring(sha256(string_agg(line, chr(10) ORDER BY part, line)), 1, 12) AS version FROM (SELECT repo, 0 AS part, qualified_name || '|' || signature AS line FROM psym UNION ALL SELECT from_repo, 1, '->' || to_repo || ':[' || array_to_string(['\"' || t || '\"' FOR t IN type_list], ', ') || ']' FROM deps) GROUP BY repo",
}
NOTES = "SELECT conv_id * 100 + turn AS id, 'c' || (conv_id % 10) AS repo, CASE WHEN role = 'user' THEN 'gotcha' ELSE role END AS kind, text AS note FROM conversations"


def _section(title: str, rows: str, line: str, order: str, where: str = "true", empty: str = "- none known") -> str:
    none = f"chr(10) || '## {title}' || chr(10) || '{empty}' || chr(10)" if empty else "''"
    return f"coalesce((SELECT chr(10) || '## {title}' || chr(10) || string_agg({line}, chr(10) ORDER BY {order}) || chr(10) FROM {rows} WHERE {where}), {none})"


DOCUMENT = "'---' || chr(10) || 'name: ' || d.slug || chr(10) || 'description: ' || d.description || chr(10) || 'version: ' || coalesce(v.version, '') || chr(10) || '---' || chr(10) || chr(10) || '# ' || d.repo || chr(10)" + "".join(" || " + x for x in (
    _section("Calls", "deps x", "'- ' || x.to_repo || ' (' || array_to_string(x.type_list, ', ') || ', ' || CAST(round(x.confidence * 100) AS INTEGER) || '%)'", "x.confidence DESC, x.to_repo", "x.from_repo = d.repo AND NOT list_contains(x.type_list, 'kafka')"),
    _section("Called by", "deps x", "'- ' || x.from_repo || ' (' || array_to_string(x.type_list, ', ') || ')'", "x.confidence DESC, x.from_repo", "x.to_repo = d.repo"),
    _section("Events", "deps x", "'- ' || x.to_repo", "x.to_repo", "x.from_repo = d.repo AND list_contains(x.type_list, 'kafka')", ""),
    _section("Symbols", "psym x", "'- [' || x.kind || '] ' || coalesce(nullif(x.signature, ''), x.name) || ' at ' || x.file || ':' || x.start_line", "x.file, x.start_line, x.ord", "x.repo = d.repo"),
    _section("Notes", "pnotes x", "'- (' || x.kind || ') ' || x.note", "x.id", "x.repo = d.repo", ""),
))


def _code(sql: str, extra: dict[str, str] | None = None) -> str:
    """Facts of the source files that workload.code_files makes of the pages: the lines are those of its templates."""
    path = "CASE page_id % 3 WHEN 0 THEN 'src/C' || page_id || '.java' WHEN 1 THEN 'app/p' || page_id || '.py' ELSE 'web/t' || page_id || '.ts' END"
    return with_views("pg", sql, False, {"code": f"SELECT * EXCLUDE (path), page_id % 3 AS k, 'r' || (page_id % 20) AS repo, {path} AS path FROM pg"} | (extra or {}))


#: Where each node first appears.
PLACES = {"places": "SELECT node, min(place) AS place FROM (SELECT from_repo AS node, ord * 2 AS place FROM lines UNION ALL SELECT to_repo, ord * 2 + 1 FROM lines) GROUP BY node"}

#: The statements of workload.varied_files: the v-th of its kind at place i, behind two lines.
PLACED = {"placed": "SELECT *, (page_id * 7 + i * 5) % 6 AS v, CAST(i + 2 AS INTEGER) AS line FROM (SELECT * EXCLUDE (path), 'v' || page_id || CASE k WHEN 0 THEN '.java' WHEN 1 THEN '.py' ELSE '.ts' END AS path, unnest(range(1, page_id % 9 + 5)) AS i FROM code)"}

SQL: dict[str, str] = {
    "normalize_path": f"SELECT page_id, {norm_path('url')} AS path FROM pages",
    "endpoint_key": with_views("routes", f"SELECT repo, {_ROUTE_KEY} AS key, count(*) AS n FROM routes GROUP BY ALL"),
    "split_host_path": with_views("pg", "SELECT page_id, host, path FROM pg"),
    "normalize_identity": f"SELECT page_id, {identity('url')} AS identity FROM pages",
    "stem_identity": with_views("refs", f"SELECT ord, {stem(identity('to_repo'))} AS stem FROM refs"),
    "service_from_url": r"SELECT page_id, CASE WHEN h = '' THEN bare ELSE h END AS service FROM (SELECT page_id, bare, regexp_replace(split_part(split_part(bare, '/', 1), ':', 1), '\.(internal|local|svc\.cluster\.local)$', '') AS h FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '^\$ENV:', '') AS bare FROM pages))",
    "import_name_normalize": f"SELECT p_partkey, CASE WHEN len(kept) > 0 THEN kept[-1] ELSE parts[-1] END AS name FROM (SELECT p_partkey, parts, [p FOR p IN parts IF p NOT IN {_in(IMPORT_STOPWORDS)}] AS kept FROM (SELECT p_partkey, string_split(lower('com.' || replace(p_name, ' ', '.') || '.' || lower(p_type) || '.Client'), '.') AS parts FROM part))",
    "value_holder_filter": rf"SELECT * FROM (SELECT p_partkey, 'com.shop.' || replace(p_name, ' ', '/') || CASE WHEN p_size > 25 THEN 'Config' ELSE 'Client' END AS module FROM part) WHERE NOT regexp_matches(lower(regexp_extract(module, '([^./\\]*)$', 1)), '({'|'.join(VALUE_HOLDERS)})$')",
    "namespace_noise_filter": rf"SELECT page_id, (regexp_extract(u, '^[a-z]+://([^/:]+)', 1) IN {_in(NAMESPACE_HOSTS)} OR {' OR '.join(f'''contains(u, '{m}')''' for m in NAMESPACE_MARKERS)}) AS noise FROM (SELECT page_id, lower(regexp_replace(CASE page_id % 5 WHEN 0 THEN 'http://www.w3.org/' || page_id WHEN 1 THEN '$ENV:http://schemas.xmlsoap.org/soap/' || page_id ELSE url END, '^\$ENV:', '')) AS u FROM pages)",
    "target_scoring": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '$ENV:HOST_' || page_id WHEN 2 THEN '$ENV:URL_' || page_id ELSE 'base/' || page_id END AS target, CASE page_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 3 THEN 0.4::DOUBLE ELSE 0.7::DOUBLE END AS confidence, CASE page_id % 4 WHEN 3 THEN 'inferred' ELSE 'call-site' END AS tier FROM pages",
    "config_properties_parse": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'svc.url' ELSE 'api.host' END AS key, CASE page_id % 4 WHEN 0 THEN url ELSE page_id || '.internal:80' END AS value FROM pages WHERE page_id % 4 IN (0, 3)",
    "placeholder_resolve": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 1 THEN '' ELSE '/' || lower(n_name) END AS value FROM nation",
    "base_path_fold": with_views("routes", f"SELECT repo, method, CASE WHEN framework = 'spring' THEN {norm_path(chr(39) + '/api/v2/' + chr(39) + ' || ltrim(path, ' + chr(39) + '/' + chr(39) + ')')} ELSE path END AS path, count(*) AS n FROM routes GROUP BY ALL"),
    "resolve_edges": with_views("deps", "SELECT from_repo, to_repo, types, confidence, evidence, tier FROM deps"),
    "config_first_wins": with_views("lines", "SELECT from_repo, to_repo, arg_min(evidence, struct_pack(o := ord, e := evidence)) AS evidence FROM lines GROUP BY ALL"),
    "identity_dedupe": with_views("aliases", "SELECT repo, alias, raw, source, confidence FROM (SELECT *, row_number() OVER (PARTITION BY repo, alias ORDER BY confidence DESC, ord) AS k FROM aliases) WHERE k = 1"),
    "reconcile_exact": with_views("aliases norm norm0", f"SELECT * FROM ({BIND}) WHERE reason = 'exact'", True, BOUND),
    "reconcile_stem": with_views("aliases norm norm0", f"SELECT * FROM ({BIND}) WHERE reason = 'stem'", True, BOUND),
    "reconcile_subset": with_views("aliases norm norm0", f"SELECT * FROM ({BIND}) WHERE reason = 'subset'", True, BOUND),
    "reconcile_cascade": with_views("aliases norm norm0", BIND, True, BOUND),
    "reconcile_merge": with_views("aliases norm norm0", "SELECT k.from_repo, k.to_repo, t.types, max(k.confidence) AS confidence, string_agg(k.evidence, ',' ORDER BY k.ord) AS evidence, CASE WHEN bool_or(k.tier = 'call-site') THEN 'call-site' ELSE 'config' END AS tier FROM kept k JOIN kept_types t USING (from_repo, to_repo) GROUP BY ALL", True, DISPOSED),
    "reconcile_stats": with_views("aliases norm norm0", "SELECT count(*) FILTER (disposition = 'resolved') AS resolved, count(*) FILTER (disposition = 'drop-self') AS dropped_self, (SELECT count(*) - count(DISTINCT struct_pack(a := from_repo, b := to_repo)) FROM kept) AS merged, count(*) FILTER (disposition IN ('keep', 'drop-import')) AS unresolved FROM disposed", True, DISPOSED),
    "surface_match": with_views("matched", "SELECT id, repo, match_kind FROM matched"),
    "surface_match_stats": with_views("matched", "SELECT count(*) AS total, count(*) FILTER (match_kind <> 'none') AS matched, count(*) FILTER (match_kind = 'prefix') AS prefix, count(*) FILTER (match_kind = 'none') AS unmatched FROM matched"),
    "route_verbs": with_views("served", "SELECT repo, path, string_agg(verb, ',' ORDER BY verb) AS verbs FROM served GROUP BY ALL"),
    "interface_provides": with_views("routes", f"SELECT repo, method, {norm_path('path')} AS path, framework, split_part(file, '/', -1) AS file, line FROM routes"),
    "interface_consumes": with_views("matched", f"SELECT from_repo, repo AS target, method, np AS path, {key('method', 'path')} AS key, match_kind <> 'none' AS matched, match_kind FROM matched"),
    "consumed_flag": with_views("matched", f"SELECT DISTINCT repo, {_ROUTE_KEY} AS key, EXISTS (SELECT 1 FROM matched m WHERE m.repo = routes.repo AND m.match_kind <> 'none' AND {key('m.method', 'm.path')} = {key('routes.method', 'routes.path')}) AS consumed FROM routes"),
    "called_by_endpoint": with_views("matched", "SELECT repo, method, np AS path, string_agg(DISTINCT from_repo, ',' ORDER BY from_repo) AS callers FROM matched GROUP BY ALL"),
    "impact_endpoint_scoped": with_views("routes surf", f"SELECT DISTINCT from_repo, repo, key FROM (SELECT from_repo, repo, {_ROUTE_KEY} AS key FROM surf) SEMI JOIN (SELECT repo, {_ROUTE_KEY} AS key FROM routes) USING (repo, key)"),
    "impact_of_endpoint": with_views("deps edges", "SELECT d.from_repo, d.confidence, u.endpoints, d.from_repo IN (SELECT node FROM near WHERE node <> 'p1') AS in_blast FROM deps d JOIN used u USING (from_repo) WHERE d.to_repo = 'p1' AND list_contains(string_split(u.endpoints, ','), 'GET /k1')", True, _walk("2") | {"used": "SELECT from_repo, string_agg(DISTINCT k, ',' ORDER BY k) AS endpoints FROM (SELECT from_repo, 'GET /k' || split_part(evidence, ':', 2) AS k FROM lines WHERE to_repo = 'p1') GROUP BY from_repo"}),
    "enclosing_span": with_views("sym", f"SELECT e.event_id AS id, {_ENCLOSED} AS qualified_name FROM events e JOIN spans s ON s.repo = 's' || (e.event_id % 50 + 1) AND s.base = 'F' || (e.event_id % 50) || '.java' AND CAST(e.event_id % 400 AS INTEGER) BETWEEN s.start_line AND s.end_line GROUP BY e.event_id", False, {"spans": _SPANS}),
    "call_graph": with_views("cg", "SELECT * FROM cg"),
    "callgraph_reach": with_views("edges", "SELECT node, hops FROM near", True, _walk("4", True)),
    "callgraph_reach_whole": with_views("cg", "SELECT node, min(hops) AS hops FROM walk GROUP BY node", True, {
        "steps": "SELECT repo || '/' || caller AS a, repo || '/' || callee AS b FROM cg",
        "walk": "SELECT repo || '/' || qualified_name AS node, 0 AS hops FROM sym WHERE ord = 1 UNION SELECT s.b, w.hops + 1 FROM walk w JOIN steps s ON s.a = w.node WHERE w.hops < 4",
    }),
    "endpoint_fanout": with_views("cg", "SELECT repo, ep_key, target, key, hops, round(greatest(0.4, 0.9 - 0.15 * hops), 2)::DOUBLE AS confidence FROM fanned", True, FANNED),
    "endpoint_fanout_whole": with_views("cg", "SELECT repo, ep_key, target, key, min(w.hops) AS hops, round(greatest(0.4, 0.9 - 0.15 * min(w.hops)), 2)::DOUBLE AS confidence, arg_min(array_to_string([split_part(x, '.', -1) FOR x IN w.path], '>'), struct_pack(h := w.hops, p := w.path)) AS via FROM walks w JOIN sinks USING (repo, node) GROUP BY repo, ep_key, target, key", True, FANNED | {
        "level1": "SELECT repo, ep_key, c.callee AS node, 1 AS hops, min(list_append(w.path, c.callee)) AS path FROM level0 w JOIN cg c USING (repo) WHERE c.caller = w.node AND NOT EXISTS (SELECT 1 FROM level0 s WHERE s.repo = w.repo AND s.ep_key = w.ep_key AND s.node = c.callee) GROUP BY ALL",
        **{f"level{k}": f"SELECT w.repo, w.ep_key, c.callee AS node, {k} AS hops, min(list_append(w.path, c.callee)) AS path FROM level{k - 1} w JOIN cg c ON c.repo = w.repo AND c.caller = w.node WHERE NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(f'SELECT repo, ep_key, node FROM level{j}' for j in range(k))}) s WHERE s.repo = w.repo AND s.ep_key = w.ep_key AND s.node = c.callee) GROUP BY ALL" for k in (2, 3, 4)},
        "walks": " UNION ALL ".join(f"SELECT repo, ep_key, node, hops, path FROM level{k}" for k in range(5)),
    }),
    "route_calls": with_views("cg", "SELECT row_number() OVER (ORDER BY split_part(ep_key, ' ', -1), split_part(ep_key, ' ', 1), hops, target, key) AS place, ep_key, target, key, hops FROM fanned WHERE repo = 's11'", True, FANNED),
    "routes_with_calls": with_views("cg", "SELECT repo, ep_key, count(hops) AS n, coalesce(string_agg(hops || ' ' || target || ' ' || key, ',' ORDER BY hops, target, key), '') AS calls FROM (SELECT DISTINCT repo, ep_key FROM pts) LEFT JOIN fanned USING (repo, ep_key) GROUP BY repo, ep_key", True, FANNED),
    "dependencies_of": with_views("deps", "SELECT to_repo, confidence FROM deps WHERE from_repo = 'p1'"),
    "dependents_of": with_views("deps", "SELECT from_repo, confidence FROM deps WHERE to_repo = 'p1'"),
    "blast_radius_d3": with_views("edges", "SELECT node FROM near WHERE node <> 'p1'", True, _walk("2")),
    "blast_radius_d2": with_views("edges", "SELECT node FROM near WHERE node <> 'p1'", True, _walk("1")),
    "blast_by_hop": with_views("edges", "SELECT node, hops FROM near", True, _walk("12")),
    "affected_repos": with_views("deps", "SELECT repo, min(part) AS part FROM (SELECT 'p1' AS repo, 0 AS part UNION ALL SELECT from_repo, 1 FROM deps WHERE to_repo = 'p1' UNION ALL SELECT to_repo, 2 FROM deps WHERE from_repo = 'p1') GROUP BY repo"),
    "graph_summary": with_views("deg", "SELECT count(*) AS nodes, CAST(sum(out_degree) AS BIGINT) AS edges, count(*) FILTER (in_degree = 0) AS orphans, (SELECT string_agg(node, ',' ORDER BY in_degree DESC, place) FROM (SELECT * FROM deg JOIN places USING (node) ORDER BY in_degree DESC, place LIMIT 5)) AS most_depended FROM deg", False, PLACES),
    "degree": with_views("deg", "SELECT * FROM deg"),
    "orphans": with_views("lines", "SELECT DISTINCT from_repo AS node FROM lines WHERE dep_type = 'kafka' AND from_repo NOT IN (SELECT to_repo FROM lines WHERE dep_type = 'kafka')"),
    "search_symbols": with_views("sym", "SELECT name, repo, file, start_line, qualified_name FROM sym WHERE name ILIKE '%Ring%' ORDER BY (name = 'Ring') DESC, length(name), name, repo, file, start_line, ord LIMIT 50"),
    "get_callers": "SELECT 'u' || user_id AS repo, 'F' || (event_id % 50) || '.java' AS file, CAST(event_id % 400 AS INTEGER) AS line, event_id AS ord FROM events WHERE event_type = 'click' ORDER BY repo, file, line, ord LIMIT 100",
    "symbols_for_repo": with_views("sym", "SELECT file, start_line, qualified_name FROM sym WHERE repo = 's11' AND kind = 'method' ORDER BY file, start_line, ord LIMIT 200"),
    "cross_repo_call_sites": with_views("part_calls", "SELECT callee_name, repo, caller AS file, CAST(length(caller) AS INTEGER) AS line FROM part_calls WHERE repo <> 's11' AND callee_name IN (SELECT name FROM sym WHERE repo = 's11') GROUP BY ALL ORDER BY callee_name, repo, file LIMIT 25"),
    "impact_report": with_views("deps edges", "SELECT *, n_blast > n_dependents AS transitive FROM (SELECT 'p1' AS repo, (SELECT count(*) FROM deps WHERE to_repo = 'p1') AS n_dependents, (SELECT count(*) FROM near WHERE node <> 'p1') AS n_blast, coalesce((SELECT string_agg(from_repo, ',' ORDER BY from_repo) FROM deps WHERE to_repo = 'p1'), '') AS dependents, coalesce((SELECT string_agg(node, ',' ORDER BY node) FROM near WHERE node <> 'p1'), '') AS blast, coalesce((SELECT string_agg(to_repo, ',' ORDER BY to_repo) FROM deps WHERE from_repo = 'p1' AND list_contains(type_list, 'kafka')), '') AS events)", True, _walk("2")),
    "events_emitted": with_views("deps", "SELECT from_repo, to_repo AS topic FROM deps WHERE list_contains(type_list, 'kafka')"),
    "snapshot_hash": with_views("deps sym", "SELECT repo, substring(sha256(string_agg(line, chr(10) ORDER BY part, line)), 1, 12) AS hash FROM (SELECT 'p' || ord AS repo, 0 AS part, qualified_name || '|' || signature AS line FROM sym UNION ALL SELECT from_repo, 1, '->' || to_repo || ':[' || array_to_string(['\"' || t || '\"' FOR t IN type_list], ', ') || ']' FROM deps) GROUP BY repo"),
    "recall_memory": f"SELECT id, note FROM ({NOTES}) WHERE repo = 'c3' AND kind = 'gotcha'",
    "remember_notes": f"SELECT id, repo, kind FROM ({NOTES}) WHERE kind = 'gotcha' UNION ALL SELECT (SELECT max(id) FROM ({NOTES}) WHERE kind = 'gotcha') + row_number() OVER (ORDER BY id), repo, 'note' FROM ({NOTES}) WHERE kind <> 'gotcha'",
    "forget_notes": f"SELECT id, kind FROM ({NOTES}) WHERE id % 7 <> 0",
    "alias_replace_keep_manual": with_views("aliases", "SELECT * FROM (SELECT repo, alias, source FROM olds o WHERE NOT EXISTS (SELECT 1 FROM news n WHERE n.repo = o.repo AND n.alias = o.alias) AND source = 'manual' UNION ALL SELECT * FROM news)", False, {"olds": "SELECT DISTINCT repo, alias, CASE WHEN ord % 6 < 2 THEN 'manual' ELSE source END AS source FROM aliases", "news": "SELECT DISTINCT repo, alias, source FROM aliases WHERE source = 'package'"}),
    "dependency_upsert": with_views("deps", "SELECT from_repo, to_repo, confidence, tier FROM deps d WHERE NOT EXISTS (SELECT 1 FROM news n WHERE n.from_repo = d.from_repo AND n.to_repo = d.to_repo) UNION ALL SELECT * FROM news", False, {"news": "SELECT from_repo, to_repo, min(confidence) AS confidence, 'config' AS tier FROM lines GROUP BY ALL HAVING min(confidence) >= 0.7"}),
    "confidence_labels": with_views("deps", "SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS label, count(*) AS n FROM deps GROUP BY ALL"),
    "ui_nodes": with_views("refs", "SELECT node, node NOT IN (SELECT word FROM pg) AS external, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT from_repo AS node, 0 AS i, 1 AS o FROM pairs UNION ALL SELECT to_repo, 1, 0 FROM pairs) GROUP BY node", False, {"pairs": "SELECT DISTINCT from_repo, to_repo FROM refs"}),
    "ui_edges": with_views("deps", "SELECT from_repo, to_repo, types, round(confidence, 2) AS confidence, types = 'import' AS import_only, tier FROM deps"),
    "visible_graph": with_views("surf", "SELECT * FROM shown WHERE confidence >= 0.2 AND from_repo IN (SELECT node FROM known) AND to_repo IN (SELECT node FROM known)", False, SEEN),
    "visible_neighbours": with_views("surf", "SELECT from_repo, to_repo, count(*) AS n FROM strong WHERE from_repo IN (SELECT node FROM near) AND to_repo IN (SELECT node FROM near) GROUP BY ALL", False, SEEN | {"strong": "SELECT * FROM shown WHERE confidence >= 0.5", "near": "SELECT 'front2' AS node UNION SELECT from_repo FROM strong WHERE to_repo = 'front2' UNION SELECT to_repo FROM strong WHERE from_repo = 'front2'"}),
    "visible_nodes": with_views("surf", "SELECT node, node NOT IN (SELECT node FROM known) AS external, contains(lower(node), 'ion') AS found FROM ends WHERE node IN (SELECT node FROM known) OR node IN (SELECT from_repo FROM strong UNION SELECT to_repo FROM strong)", False, SEEN | {"strong": "SELECT * FROM shown WHERE confidence >= 0.8"}),
    "neighbourhood": with_views("edges", "SELECT 'p1' AS node UNION SELECT from_repo FROM edges WHERE to_repo = 'p1' UNION SELECT to_repo FROM edges WHERE from_repo = 'p1'"),
    "aliases_of_repo": with_views("aliases", "SELECT alias, raw, source, confidence FROM aliases WHERE repo = 'tionsh'"),
    "aliases_by_repo": with_views("aliases", "SELECT repo, string_agg(source || ':' || alias, ',' ORDER BY ord) AS names FROM aliases GROUP BY repo"),
    "alias_remove": with_views("aliases", f"SELECT repo, alias, raw, ord FROM aliases a WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo = a.repo AND (g.name = a.raw OR g.norm = a.alias))", False, {"gone": f"SELECT repo, name, {identity('name')} AS norm FROM (SELECT DISTINCT word AS repo, CASE WHEN page_id % 2 = 0 THEN word || '-service' ELSE host END AS name FROM pg WHERE page_id % 3 = 0)"}),
    "repos_by_name": "SELECT DISTINCT 'p' || p_partkey AS name, '/repos/' || p_brand AS path FROM part",
    "routes_of_repo": with_views("routes", "SELECT path, method, framework, file, line FROM routes WHERE repo = 'tionsh'"),
    "export_round_trip": with_views("deps", "SELECT from_repo, to_repo, types, confidence, evidence, tier FROM deps"),
    "export_evidence": with_views("lines", "SELECT to_repo, split_part(evidence, ':', 1) AS file, CAST(split_part(evidence, ':', 2) AS INTEGER) AS line FROM lines WHERE from_repo = 'p1'"),
    "export_summary": with_views("deps deg", "SELECT (SELECT count(*) FROM deps) AS total_deps, (SELECT count(*) FROM deps WHERE confidence >= 0.8) AS high_confidence, (SELECT string_agg(node, ',' ORDER BY in_degree DESC, place) FROM (SELECT * FROM deg JOIN places USING (node) ORDER BY in_degree DESC, place LIMIT 5)) AS services_called", False, PLACES),
    "group_map": with_views("deps", "SELECT from_repo, string_agg(to_repo || ' ' || CAST(round(confidence * 100) AS INTEGER) || '%', ', ' ORDER BY to_repo) AS targets FROM deps GROUP BY from_repo"),
    "interfaces_manifest": with_views("matched", f"SELECT coalesce(g.repo, t.repo) AS repo, coalesce(provides, '') AS provides, coalesce(consumes, '') AS consumes FROM (SELECT repo, string_agg(DISTINCT {_ROUTE_KEY}, ',' ORDER BY {_ROUTE_KEY}) AS provides FROM routes GROUP BY repo) g FULL JOIN (SELECT from_repo AS repo, string_agg(DISTINCT repo || ' ' || {_ROUTE_KEY}, ',' ORDER BY repo || ' ' || {_ROUTE_KEY}) AS consumes FROM matched GROUP BY from_repo) t ON g.repo = t.repo"),
    "scan_summary": with_views("matched", "SELECT count(*) AS nodes, CAST(sum(o) AS BIGINT) AS edges, (SELECT count(*) FROM matched) AS calls, (SELECT count(*) FROM matched WHERE match_kind <> 'none') AS matched, (SELECT string_agg(node, ',' ORDER BY i DESC, node) FROM (SELECT * FROM d ORDER BY i DESC, node LIMIT 3)) AS most_depended, (SELECT string_agg(node, ',' ORDER BY node) FROM (SELECT * FROM d WHERE i = 0 ORDER BY node LIMIT 3)) AS orphans FROM d", False, {"d": "SELECT node, sum(i) AS i, sum(o) AS o FROM (SELECT from_repo AS node, 0 AS i, 1 AS o FROM (SELECT DISTINCT from_repo, repo FROM surf) UNION ALL SELECT repo, 1, 0 FROM (SELECT DISTINCT from_repo, repo FROM surf)) GROUP BY node"}),
    "top_targets": with_views("deps", "SELECT from_repo, to_repo, confidence FROM (SELECT *, row_number() OVER (PARTITION BY from_repo ORDER BY confidence DESC, to_repo) AS k FROM deps) WHERE k <= 3"),
    "skill_descriptions": with_views("deps sym", "SELECT * FROM described", False, SKILLS),
    "skill_registry": with_views("deps sym", "SELECT d.repo, v.version, 'java' AS languages FROM described d LEFT JOIN versions v USING (repo)", False, SKILLS),
    "skill_documents": with_views("deps sym", f"SELECT d.repo, {DOCUMENT} AS document FROM described d LEFT JOIN versions v USING (repo)", False, SKILLS | {"pnotes": f"SELECT * REPLACE ('p' || (id % 97) AS repo) FROM ({NOTES})"}),
    "ui_payload": with_views("surf aliases routes", f"SELECT e.node, CASE WHEN e.node IN (SELECT word FROM pg) THEN 'false' ELSE 'true' END AS external, (SELECT count(DISTINCT from_repo) FROM between b WHERE b.to_repo = e.node) AS in_degree, (SELECT arg_min(alias, ord) FROM aliases a WHERE a.repo = e.node) AS alias, (SELECT min({_ROUTE_KEY}) FROM routes r WHERE r.repo = e.node) AS endpoint FROM ends e", False, SEEN),
    "skill_metadata": with_views("deps", "SELECT 'p' || p_partkey AS repo, 'p' || p_partkey AS slug, coalesce(callees, '') AS callees FROM part LEFT JOIN (SELECT from_repo, string_agg(to_repo, ', ' ORDER BY confidence DESC, to_repo) AS callees FROM (SELECT *, row_number() OVER (PARTITION BY from_repo ORDER BY confidence DESC, to_repo) AS k FROM deps) WHERE k <= 3 GROUP BY from_repo) ON from_repo = 'p' || p_partkey"),
    "languages": with_views("sym", "SELECT repo, 'java' AS languages FROM sym GROUP BY repo"),
    "evidence_parse": with_views("lines", "SELECT DISTINCT evidence, split_part(evidence, ':', 1) AS file, CAST(split_part(evidence, ':', 2) AS INTEGER) AS line FROM lines"),
    "import_only_filter": with_views("deps", "SELECT from_repo, to_repo FROM deps WHERE types <> 'import'"),
    "fuzzy_cross_resolve": with_views("refs", "SELECT r.ord, coalesce(f.repo, r.to_repo) AS to_repo, CASE WHEN f.repo IS NULL THEN r.confidence ELSE least(1.0::DOUBLE, r.confidence + 0.2::DOUBLE) END AS confidence FROM refs r LEFT JOIN (SELECT n.to_repo, min(w.word) AS repo FROM (SELECT DISTINCT to_repo, replace(replace(lower(to_repo), '-', ''), '_', '') AS bare FROM refs) n JOIN (SELECT DISTINCT word FROM pg WHERE word <> '') w ON contains(n.bare, w.word) OR contains(w.word, n.bare) GROUP BY n.to_repo) f USING (to_repo)"),
    "code_statements": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{lang}' AS language, CAST(line AS INTEGER) AS line, (SELECT count(*) FROM pages WHERE page_id % 3 = {k}) AS n, line IN ({more}) AS goes_on FROM (SELECT unnest([{kept}]) AS line)" for lang, k, kept, more in (("java", 0, "1, 2, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29", "10, 14, 15, 22, 26"), ("python", 1, "1, 2, 3, 8, 9, 10, 11, 13, 14, 15, 16, 17, 18", "10"), ("typescript", 2, "1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18", "1, 11"))) + ") WHERE n > 0",
    "code_imports": _code("SELECT repo, path, 2 AS line, 'com.' || word || '.Client' AS module FROM code WHERE k = 0 UNION ALL SELECT repo, path, 1, unnest(['os', 'sys']) FROM code WHERE k = 1 UNION ALL SELECT repo, path, 2, word || '.models' FROM code WHERE k = 1 UNION ALL SELECT repo, path, 1, word || '-sdk' FROM code WHERE k = 2"),
    "code_http_calls": _code("SELECT repo, path, 14 AS line, 'GET' AS method, 'https://' || host || '/a/' || page_id AS target, 1.0::DOUBLE AS confidence, 'call-site' AS tier FROM code WHERE k = 0 UNION ALL SELECT repo, path, 10, 'GET', '$ENV:' || word || '_URL/b/' || page_id, 0.7::DOUBLE, 'call-site' FROM code WHERE k = 1 UNION ALL SELECT repo, path, 8, 'PUT', 'https://' || host || '/d/' || page_id, 1.0::DOUBLE, 'call-site' FROM code WHERE k = 2"),
    "code_varied_calls": _code("""SELECT repo, path, line, method, target, CASE WHEN target LIKE 'http%' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS confidence, CASE WHEN target LIKE 'http%' THEN 'call-site' ELSE 'inferred' END AS tier
        FROM (SELECT repo, path, line, method, replace(replace(replace(target, '#w', word), '#h', host), '#i', CAST(i AS VARCHAR)) AS target FROM placed JOIN (VALUES
            (1, 0, 'GET', 'https://#h/a/#i?ids=1,#i'), (1, 1, 'POST', 'https://#h/f/#w/#i'), (1, 2, 'PUT', 'url("x", #i)'), (1, 2, 'DELETE', 'https://#h/d/#i'), (1, 4, 'HEAD', '#w/p/#i{}'),
            (0, 0, 'GET', 'https://#h/a/#i{}'), (0, 1, 'PUT', 'http://#w/p/#i'), (0, 2, 'PATCH', 'http://#w/%s'), (0, 4, 'ANY', 'http://#w/u/#i'), (0, 5, 'POST', 'https://#h'),
            (2, 0, 'GET', 'https://#h/t/{id(1)}/#w/#i'), (2, 1, 'PUT', 'https://#h/f,#i'), (2, 2, 'POST', '/g/#i'), (2, 2, 'DELETE', 'https://#h/k/#i'), (2, 3, 'GET', '#w'), (2, 4, 'ANY', 'a ? ''x'' : ''y''')
        ) f(k, v, method, target) USING (k, v))""", PLACED),
    "code_mounted_routes": _code("""SELECT repo, path, line, method, replace(replace(route, '#m', CAST(page_id % 5 AS VARCHAR)), '#i', CAST(i AS VARCHAR)) AS route, 'express' AS framework
        FROM placed JOIN (VALUES (2, 5, 'GET', '/m#m/u/#i'), (2, 5, 'POST', '/v/#i')) f(k, v, method, route) USING (k, v)""", PLACED),
    "code_feign_surfaces": _code("""SELECT repo, 'v' || page_id || '.java' AS path, CAST(page_id % 9 + 8 AS INTEGER) AS line, word || '-client' AS target,
        unnest(list_concat(['GET'], ['POST' FOR j IN range(page_id % 4 + 1)])) AS method, unnest(list_concat(['/g/' || page_id || '/{x}'], ['/p' || (j + 1) FOR j IN range(page_id % 4 + 1)])) AS target_path FROM code WHERE k = 0"""),
    "code_wrapped_axios": _code("SELECT repo, path, 7 AS line, 'GET' AS method, 'https://' || host || '/c/' || page_id AS target FROM code WHERE k = 2"),
    "code_soap_calls": _code("SELECT repo, path, 21 AS line, 'http://' || host || '/soap/' || page_id AS target FROM code WHERE k = 0"),
    "code_web_client_calls": _code("SELECT repo, path, 22 AS line, 'GET' AS method, '/w/' || page_id AS target_path FROM code WHERE k = 0"),
    "code_messages": _code("SELECT repo, path, 14 AS line, 'topic.' || word AS target, 'kafka' AS dep_type FROM code WHERE k = 1"),
    "code_feign_clients": _code("SELECT repo, path, 26 AS line, word || '-client' AS target FROM code WHERE k = 0"),
    "code_routes": _code("SELECT repo, path, 10 AS line, 'GET' AS method, '/v' || (page_id % 5) || '/' || word || '/' || page_id AS route, 'spring' AS framework FROM code WHERE k = 0 UNION ALL SELECT repo, path, 18, 'POST', '/v' || (page_id % 5) || '/add', 'spring' FROM code WHERE k = 0 UNION ALL SELECT repo, path, 16, unnest(['GET', 'POST']), '/r/' || page_id, 'flask' FROM code WHERE k = 1 UNION ALL SELECT repo, path, 11, 'POST', '/e/' || page_id, 'express' FROM code WHERE k = 2 UNION ALL SELECT repo, path, 15, 'GET', '/k' || page_id || '/:key', 'nestjs' FROM code WHERE k = 2"),
    "code_symbols": _code("SELECT repo, path AS file, f.kind, replace(f.name, '#', CAST(page_id AS VARCHAR)) AS qualified_name, replace(f.signature, '#', CAST(page_id AS VARCHAR)) AS signature, f.s AS start_line, f.e AS end_line FROM code JOIN facts f USING (k)", {"facts": "SELECT * FROM (VALUES (0, 'class', 'C#', 'public class C#', 6, 25), (0, 'method', 'C#.one', 'public String one(String x)', 10, 17), (0, 'method', 'C#.add', 'public void add(String x) throws IOException', 18, 24), (0, 'interface', 'F#', 'interface F#', 26, 29), (1, 'class', 'P#', 'class P#', 8, 12), (1, 'method', 'P#.load', 'def load(self, x)', 9, 12), (1, 'function', 'send', 'def send()', 13, 15), (1, 'function', 'handler', 'def handler()', 17, 18), (2, 'class', 'T#', 'export class T#', 5, 10), (2, 'method', 'T#.load', 'async load(key: string): Promise<void>', 6, 9), (2, 'class', 'K', 'export class K', 14, 18), (2, 'method', 'K.one', 'one()', 16, 17)) t(k, kind, name, signature, s, e)"}),
    "code_call_sites": _code("SELECT repo, path AS file, 'C' || page_id || '.add' AS caller, 'one' AS callee_name, 20 AS line FROM code WHERE k = 0 UNION ALL SELECT repo, path, 'send', 'load', 15 FROM code WHERE k = 1"),
    "config_targets": with_views("pg", "SELECT 'r' || page_id AS repo, 4 AS line, 'https://' || host || '/pay/' || page_id AS target FROM pg"),
    "declared_identities": with_views("pg", f"SELECT repo, alias, raw, source, confidence FROM (SELECT *, row_number() OVER (PARTITION BY repo, alias ORDER BY confidence DESC, ord) AS n FROM named) WHERE n = 1 AND alias <> ''", False, {"named": f"SELECT repo, {identity('raw')} AS alias, raw, source, confidence, ord FROM (SELECT 'r' || page_id AS repo, 'r' || page_id AS raw, 'config' AS source, 1.0::DOUBLE AS confidence, 0 AS ord FROM pg UNION ALL SELECT 'r' || page_id, word || '-api', 'package', 0.9::DOUBLE, 1 FROM pg UNION ALL SELECT 'r' || page_id, word || '-service', 'spring', 0.95::DOUBLE, 4 FROM pg)"}),
    "declared_base_paths": with_views("pg", "SELECT 'r' || page_id AS repo, unnest(['spring', 'jaxrs']) AS framework, '/base' || (page_id % 5) AS base FROM pg"),
}
SQL["search_symbol_postings"] = SQL["search_symbols"]
SQL["document_round_trip"] = SQL["export_round_trip"]
_CALLED = "SELECT from_repo, count(*) AS total_deps, count(*) FILTER (confidence >= 0.8) AS high_confidence, list_concat(list(to_repo ORDER BY ord, to_repo), [from_repo])[1:5] AS called FROM deps JOIN (SELECT from_repo, to_repo, min(ord) AS ord FROM lines GROUP BY ALL) o USING (from_repo, to_repo) GROUP BY from_repo"
SQL["document_summaries"] = with_views("deps", f"SELECT 'p' || p_partkey AS repo, '/repos/' || p_brand AS path, coalesce(total_deps, 0) AS total_deps, coalesce(high_confidence, 0) AS high_confidence, coalesce(array_to_string(called, ','), '') AS services_called, true AS whole FROM part LEFT JOIN ({_CALLED}) ON from_repo = 'p' || p_partkey")
SQL["document_violations"] = with_views("deps", "SELECT from_repo AS repo, '$.dependencies[' || k || '].tier' AS path, 'is none of its words' AS rule FROM (SELECT from_repo, tier, row_number() OVER (PARTITION BY from_repo ORDER BY ord, to_repo) - 1 AS k FROM deps JOIN (SELECT from_repo, to_repo, min(ord) AS ord FROM lines GROUP BY ALL) o USING (from_repo, to_repo)) JOIN part ON from_repo = 'p' || p_partkey WHERE p_partkey % 4 = 1 AND tier = 'call-site' UNION ALL SELECT 'p' || p_partkey, '$.version', 'is missing' FROM part WHERE p_partkey % 4 = 2 UNION ALL SELECT 'p' || p_partkey, '$', 'is not JSON' FROM part WHERE p_partkey % 4 = 3")
SQL["impact_of_symbol"] = with_views("sym", "(SELECT 'definition' AS kind, repo, file, start_line AS line, qualified_name AS name FROM sym WHERE sym.name ILIKE '%Ring%' ORDER BY sym.name = 'Ring' DESC, length(sym.name), sym.name, repo, file, start_line, ord LIMIT 50) UNION ALL SELECT 'caller', * FROM (SELECT * FROM (SELECT 'u' || user_id AS repo, 'F' || (event_id % 50) || '.java' AS file, CAST(event_id % 400 AS INTEGER) AS line, 'Ring' AS name FROM events WHERE event_type = 'click' ORDER BY repo, file, line, event_id LIMIT 100) WHERE repo <> 'u7')")
_FACTS = (
    ("'d' || page_id", "config", 1.0, "true"), ("word || '-ledger' || (page_id % 5)", "package", 0.9, "true"), ("word || '-mod' || (page_id % 5)", "go", 0.9, "true"),
    ("word || CASE WHEN page_id % 2 = 0 THEN '-boot' ELSE '-props' END", "spring", 0.95, "true"), ("word || '-svc' || (page_id % 5)", "k8s", 0.9, "true"), ("'core-' || word || '-' || page_id", "k8s", 0.9, "true"),
    ("word || CASE WHEN page_id % 3 = 0 THEN ' Books' ELSE ' Orders' END", "openapi", 0.7, "true"), ("'https://' || host || '/api'", "openapi", 0.85, "page_id % 3 > 0"), ("'http://' || word || '.internal:80'", "openapi", 0.85, "page_id % 3 > 0"), ("word || '-repo'", "git", 0.85, "true"),
)
SQL["declared_documents"] = with_views("pg", "SELECT repo, alias, raw, source, confidence FROM (SELECT *, row_number() OVER (PARTITION BY repo, alias ORDER BY confidence DESC, ord) AS n FROM (SELECT *, " + identity("raw") + " AS alias FROM named) WHERE alias <> '') WHERE n = 1", False, {"named": " UNION ALL ".join(f"SELECT 'd' || page_id AS repo, {raw} AS raw, '{source}' AS source, {confidence}::DOUBLE AS confidence, {ord} AS ord FROM pg WHERE {where}" for ord, (raw, source, confidence, where) in enumerate(_FACTS))})
