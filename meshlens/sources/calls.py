"""What call heads mean: requests, messages, declared clients, and routes that are calls themselves.

All take the table of sources.heads; those that resolve a target also take the files' variables (repo, path, name, value).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.functions import paths as P
from meshlens.functions.predicates import is_namespace_noise, score_target

# Clients and their methods, by language, and what marks an endpoint.
PYTHON_CLIENTS = {
    "requests": ["get", "post", "put", "patch", "delete", "head", "options"],
    "httpx": ["get", "post", "put", "patch", "delete", "head", "options"],
    "urllib": ["urlopen", "urlretrieve"],
    "aiohttp": ["get", "post", "put", "patch", "delete"],
}
SCRIPT_CLIENTS = ["axios", "got", "http", "https", "superagent", "ky"]
SCRIPT_METHODS = ["get", "post", "put", "patch", "delete", "request", "head"]
SCRIPT_FUNCTIONS = ["fetch", "axios", "got", "ky"]
JAVA_CLIENTS = {"getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "postForLocation": "POST", "put": "PUT", "delete": "DELETE", "patchForObject": "PATCH"}
JAVA_ALSO_MAPS = ["put", "delete"]
WEB_CLIENT_VERBS = ["get", "post", "put", "patch", "delete"]
SOAP_METHODS = ["marshalSendAndReceive", "sendSourceAndReceive"]
GRPC_CHANNELS = ["insecure_channel", "secure_channel"]
VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]
URL_LIKE = r"://|^/|^\$ENV:|/.*(?:\{\}|%s|%d)|(?:\{\}|%s|%d).*/"
URL_NAME = r"(?i)url|uri|endpoint|host|path|address|link"
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
SERVERS = ["app", "router", "server", "fastify", "api", "route", "routes", "express"]
ROUTE_VERBS = ["get", "post", "put", "patch", "delete", "head", "options", "all"]

_IDENTIFIER = r"^[\w$]+\z"


def _script() -> Column:
    return F.col("language").isin("typescript", "javascript")


def _arg(i: int) -> Column:
    return F.try_element_at("args", F.lit(i + 1))


def _literal(arg: Column) -> Column:
    """The value of an argument that is one plain text, else null; a Script's template without holes is one."""
    return F.when(arg["kind"] == "text", F.array_join(F.transform(arg["pieces"], lambda p: F.when(p["kind"] == "hole", F.concat(F.lit("{"), p["value"], F.lit("}"))).otherwise(p["value"])), ""))


def _named(names: dict[str, str]) -> Column:
    return functools.reduce(lambda rest, kv: F.when(F.col("name") == kv[0], kv[1]).otherwise(rest), names.items(), F.lit(None).cast("string"))


def resolved(calls: DataFrame, values: DataFrame, arg: str = "arg") -> DataFrame:
    """calls with an argument (or null) -> target: texts as they are, names and holes by the file's variables, other code as {}
    within a sum, and as its source where it stands alone; of Java's other code the texts in it, if it has any."""
    known = values.groupBy("repo", "path").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("known"))
    rows = calls.join(known, ["repo", "path"], "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<string,string>")))
    a = F.col(arg)
    value = lambda p: F.try_element_at("known", p["value"])
    part = lambda p: (
        F.when(p["kind"] == "text", p["value"]).when(p["kind"] == "hole", F.coalesce(value(p), F.concat(F.lit("{"), p["value"], F.lit("}"))))
        .when(p["kind"] == "name", F.coalesce(value(p), F.lit("{}"))).otherwise("{}")
    )
    texts = F.array_join(F.regexp_extract_all(a["raw"], F.lit('"([^"]*)"'), 1), "")
    alone = F.when((F.col("language") == "java") & (texts != ""), texts).otherwise(a["raw"])
    target = F.when(a["kind"] == "name", F.coalesce(F.try_element_at("known", a["raw"]), a["raw"])).when(a["kind"].isin("text", "template", "sum"), F.array_join(F.transform(a["pieces"], part), "")).when(a.isNotNull(), alone)
    return rows.withColumn("target", F.coalesce(target, F.lit(""))).drop("known")


_CALL = ["repo", "path", "language", "line", "n"]


def http_calls(heads: DataFrame, values: DataFrame) -> DataFrame:
    """(repo, path, line, method, target, target_path, confidence, tier, dep_type) of outbound HTTP calls, but for those on
    instances that axios.create made (see wrapped_axios)."""
    first = _arg(0)
    python = functools.reduce(lambda x, kv: x | (F.col("receiver") == kv[0]) & F.col("name").isin(kv[1]), PYTHON_CLIENTS.items(), F.lit(False))
    option = F.upper(F.regexp_extract(_arg(1)["raw"], r"""method\s*:\s*["'](\w+)["']""", 1))
    exchange = F.upper(F.regexp_extract(_arg(1)["raw"], r"HttpMethod\.(\w+)", 1))
    call = lambda verb, arg=first, gated=False: F.struct(F.upper(verb).alias("verb"), arg.alias("arg"), F.lit(gated).alias("gated"))
    lang, name, receiver = F.col("language"), F.col("name"), F.col("receiver")
    java = lang == "java"
    found = (
        F.when((lang == "python") & python, call(name))
        .when(_script() & receiver.isin(SCRIPT_CLIENTS) & name.isin(SCRIPT_METHODS), call(name))
        .when(_script() & receiver.isNull() & name.isin(SCRIPT_FUNCTIONS), call(option))
        .when(java & (name == "exchange") & first.isNotNull(), call(exchange))
        .when(java & name.isin(JAVA_ALSO_MAPS) & first.isNotNull(), call(name, gated=True))
        .when(java & name.isin(list(JAVA_CLIENTS)) & first.isNotNull(), call(_named(JAVA_CLIENTS)))
        .when(java & (name == "url") & first.isNotNull() & receiver.rlike(r"(?i)builder|request"), call(F.lit("ANY")))
        .when(java & (name == "openConnection") & receiver.rlike(_IDENTIFIER), call(F.lit("ANY"), F.struct(F.lit("name").alias("kind"), receiver.alias("raw"), F.array(F.struct(F.lit("name").alias("kind"), receiver.alias("value"))).alias("pieces"))))
    )
    calls = heads.where(~F.col("at")).withColumn("c", found).where("c is not null").select(*_CALL, "receiver", "c.*")
    made = axios_instances(heads, values).select("repo", "path", F.col("name").alias("receiver"))
    calls = calls.join(made, ["repo", "path", "receiver"], "left_anti").drop("receiver")
    opened = heads.where(java & (name == "openConnection")).select("repo", "path", "language", "line", F.col("inner_call").alias("n"))
    urls = heads.where(java & (name == "URL") & receiver.rlike(r"^new\b") & first.isNotNull()).select("repo", "path", "n", F.lit("ANY").alias("verb"), first.alias("arg"), F.lit(False).alias("gated"))
    out = resolved(calls.unionByName(opened.join(urls, ["repo", "path", "n"])), values)
    # put and delete are also what maps and repositories have: there the argument must look like an endpoint
    gate = ~F.col("gated") | F.trim("target").rlike(URL_LIKE) | (F.col("arg.kind") == "name") & F.col("arg.raw").rlike(URL_NAME)
    s = score_target(F.col("target"))
    return out.where(gate & ~is_namespace_noise(s["target"])).select(
        "repo", "path", "line", F.when(F.col("verb").isin(VERBS), F.col("verb")).otherwise("ANY").alias("method"), s["target"].alias("target"), P.split_host_path(s["target"])["path"].alias("target_path"),
        s["confidence"].alias("confidence"), s["tier"].alias("tier"), F.lit("http").alias("dep_type"),
    )


def axios_instances(heads: DataFrame, values: DataFrame) -> DataFrame:
    """(repo, path, name, base): variables that axios.create is assigned to, the last one of a file, with their base URL."""
    text = F.trim(F.regexp_extract(F.array_join(F.transform("args", lambda a: a["raw"]), ", "), r"baseURL\s*:\s*([^,}]+)", 1))
    made = heads.where(_script() & F.col("receiver").isin("axios", "axios.default") & (F.col("name") == "create") & F.col("assigned").isNotNull()).select("repo", "path", F.col("assigned").alias("name"), "n", text.alias("text"))
    made = made.groupBy("repo", "path", "name").agg(F.max_by("text", "n").alias("text"))
    env = F.regexp_extract("text", r"process\.env\.(\w+)", 1)
    named = values.select("repo", "path", F.col("name").alias("text"), "value")
    base = F.when(F.col("text").rlike(r"""^["'`]"""), F.regexp_replace("text", r"""^["'`]+|["'`]+$""", "")).when(env != "", F.concat(F.lit("$ENV:"), env)).otherwise(F.coalesce("value", "text"))
    return made.join(named, ["repo", "path", "text"], "left").select("repo", "path", "name", base.alias("base"))


def wrapped_axios(heads: DataFrame, values: DataFrame) -> DataFrame:
    """(repo, path, line, method, target): calls on instances that axios.create made, their base URL put before a bare path."""
    calls = heads.where(_script() & F.col("name").isin(SCRIPT_METHODS) & F.col("receiver").isNotNull()).select(*_CALL, F.col("receiver").alias("name"), F.upper("name").alias("verb"), _arg(0).alias("arg"))
    used = resolved(calls.join(axios_instances(heads, values), ["repo", "path", "name"]), values)
    whole = F.when(F.col("target").startswith("/") | (F.col("target") == ""), F.concat(F.rtrim("base", F.lit("/")), "target")).otherwise(F.col("target"))
    return used.select("repo", "path", "line", F.when(F.col("verb").isin(VERBS), F.col("verb")).otherwise("ANY").alias("method"), whole.alias("target"))


def soap_calls(heads: DataFrame, values: DataFrame) -> DataFrame:
    """(repo, path, line, target): SOAP calls whose first argument is an address, as a text or a variable."""
    calls = heads.where((F.col("language") == "java") & F.col("name").isin(SOAP_METHODS) & F.col("receiver").isNotNull() & _arg(0)["kind"].isin("text", "name")).select(*_CALL, _arg(0).alias("arg"))
    host = P.split_host_path(F.col("target"))["host"]
    return resolved(calls, values).where(((host != "") | F.col("target").startswith("$ENV:")) & ~is_namespace_noise(F.col("target"))).select("repo", "path", "line", "target")


def web_client_calls(heads: DataFrame) -> DataFrame:
    """(repo, path, line, method, target_path): verb().uri("/path") chains; the host isn't known there."""
    java = heads.where(F.col("language") == "java")
    asked = java.where((F.col("name") == "uri") & F.col("receiver").isNotNull() & _literal(_arg(0)).isNotNull()).select("repo", "path", "line", F.col("inner_call").alias("n"), _literal(_arg(0)).alias("target_path"))
    verbs = java.where(F.col("name").isin(WEB_CLIENT_VERBS)).select("repo", "path", "n", F.upper("name").alias("verb"))
    return asked.join(verbs, ["repo", "path", "n"], "left").select("repo", "path", "line", F.coalesce("verb", F.lit("ANY")).alias("method"), "target_path")


def messages(heads: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, path, line, target, dep_type): Kafka topics sent to, and gRPC channels of files that import grpc."""
    python = heads.where((F.col("language") == "python") & F.col("receiver").isNotNull())
    said = F.concat_ws(" ", "receiver", F.transform("args", lambda a: a["raw"]))
    kafka = python.where((F.col("name") == "send") & F.lower(said).contains("producer")).select("repo", "path", "line", _literal(_arg(0)).alias("target"), F.lit("kafka").alias("dep_type"))
    users = imports.where(F.col("module").rlike(r"^grpc\b")).select("repo", "path").distinct()
    grpc = python.where(F.col("name").isin(GRPC_CHANNELS)).join(users, ["repo", "path"], "left_semi").select("repo", "path", "line", F.coalesce(F.nullif(_literal(_arg(0)), F.lit("")), F.lit("unknown")).alias("target"), F.lit("grpc").alias("dep_type"))
    return kafka.where("target <> ''").union(grpc)


def feign_clients(heads: DataFrame) -> DataFrame:
    """(repo, path, line, n, depth, target): declared Feign clients by name, else by URL."""
    text = F.array_join(F.transform("args", lambda a: a["raw"]), ", ")
    name, url = F.regexp_extract(text, r"\bname\s*=\s*\"([^\"]+)\"", 1), F.regexp_extract(text, r"\burl\s*=\s*\"([^\"]+)\"", 1)
    return heads.where((F.col("language") == "java") & F.col("at") & (F.col("name") == "FeignClient")).select("repo", "path", "line", "n", "depth", F.when(name != "", name).otherwise(url).alias("target")).where("target <> ''")


def feign_surfaces(heads: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, path, line, target, method, target_path): what each declared Feign client's methods ask for, for the client's
    line; a client without mappings has one row without method and path.

    A mapping belongs to the client within whose interface it stands one bracket deeper."""
    spans = symbols.where("kind in ('interface', 'class')").select("repo", F.col("file").alias("path"), "start_line", "end_line")
    clients = feign_clients(heads).join(spans, ["repo", "path"]).where("line between start_line and end_line")
    clients = clients.groupBy("repo", "path", "line", "n", "depth", "target").agg(F.max("start_line").alias("first"), F.min_by("end_line", F.struct(-F.col("start_line"), "end_line")).alias("last"))
    text = F.array_join(F.transform("args", lambda a: a["raw"]), ", ")
    told, only = F.regexp_extract(text, r"(?:value|path)\s*=\s*\{?\s*\"([^\"]+)\"", 1), F.regexp_extract(text, r"\"([^\"]+)\"", 1)
    verb = F.coalesce(_named(MAPPINGS), F.upper(F.nullif(F.regexp_extract(text, r"RequestMethod\.(\w+)", 1), F.lit(""))), F.lit("ANY"))
    mappings = heads.where((F.col("language") == "java") & F.col("at") & F.col("name").isin([*MAPPINGS, "RequestMapping"])).select("repo", "path", F.col("line").alias("at_line"), F.col("n").alias("at_n"), F.col("depth").alias("at_depth"), verb.alias("method"), F.when(told != "", told).otherwise(only).alias("target_path"))
    inside = (F.col("c.repo") == F.col("m.repo")) & (F.col("c.path") == F.col("m.path")) & (F.col("at_depth") == F.col("depth") + 1) & (F.col("at_n") > F.col("n")) & F.col("at_line").between(F.col("first"), F.col("last"))
    return clients.alias("c").join(mappings.alias("m"), inside, "left").select("c.repo", "c.path", "line", "target", "method", "target_path")


def express_routes(heads: DataFrame) -> DataFrame:
    """(repo, path, line, method, route, framework): receiver.verb('/path', ...handlers), below the path that a use() of the
    same file mounts the receiver at. The receiver is a known server's name, a mounted one, or any with a handler behind the path."""
    script = heads.where(_script() & ~F.col("at") & F.col("receiver").isNotNull())
    mounts = script.where((F.col("name") == "use") & _literal(_arg(0)).startswith("/") & (_arg(1)["kind"] == "name")).groupBy("repo", "path", _arg(1)["raw"].alias("owner")).agg(F.max_by(_literal(_arg(0)), "n").alias("prefix"))
    owner = F.regexp_extract("receiver", r"([^.]*)\z", 1)
    handled = F.exists(F.slice("args", 2, 1 << 30), lambda a: a["kind"].isin("function", "name", "member"))
    routes = script.where(F.lower("name").isin(ROUTE_VERBS) & _literal(_arg(0)).startswith("/")).select("repo", "path", "line", F.upper("name").alias("verb"), _literal(_arg(0)).alias("own"), owner.alias("owner"), handled.alias("handled"))
    routes = routes.join(mounts, ["repo", "path", "owner"], "left").where(F.col("handled") | F.lower("owner").isin(SERVERS) | F.col("prefix").isNotNull())
    return routes.select("repo", "path", "line", F.when(F.col("verb") == "ALL", "ANY").otherwise(F.col("verb")).alias("method"), P.join_prefix(F.col("prefix"), F.col("own")).alias("route"), F.lit("express").alias("framework"))
