"""Call heads against Python's own parser over real files, and what calls mean on lines that a pattern alone gets wrong."""

import ast
import random
import sysconfig
from collections import Counter
from pathlib import Path

import pytest

from meshlens.operators import surfaces as S
from meshlens.sources import calls, code
from meshlens.sources.heads import heads, lex

SCHEMA = "repo string, path string, language string, content string"


def found(spark, files):
    df = spark.createDataFrame(files, SCHEMA)
    return heads(df).cache(), code.variables(code.lines(df)).cache()


def parsed(source):
    """(name, number of arguments, line) of every call, by Python's own parser; calls within formatted texts aren't read here."""
    tree = ast.parse(source)
    inside = {id(x) for n in ast.walk(tree) if isinstance(n, ast.JoinedStr) for x in ast.walk(n)}
    named = [(n.func.attr if isinstance(n.func, ast.Attribute) else getattr(n.func, "id", None), n) for n in ast.walk(tree) if isinstance(n, ast.Call) and id(n) not in inside]
    return Counter((name, len(n.args) + len(n.keywords), n.lineno) for name, n in named if name and not isinstance(n.func, ast.Attribute) or name and isinstance(n.func.value, (ast.Name, ast.Attribute, ast.Call, ast.Subscript)) and not _odd(n.func))


def _odd(func):
    """Whether a chain begins with brackets of its own, whose line the two tell differently."""
    while isinstance(func, (ast.Attribute, ast.Call, ast.Subscript)):
        func = func.func if isinstance(func, ast.Call) else func.value
    return not isinstance(func, ast.Name)


def test_heads_against_the_parser():
    paths = sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))[:120] + sorted(Path(sysconfig.get_paths()["stdlib"]).glob("[a-e]*/**/*.py"))[:150]
    n = 0
    for path in paths:
        try:
            source = path.read_text(encoding="utf-8")
            want = parsed(source)
        except (SyntaxError, UnicodeDecodeError):
            continue
        got = Counter((h["name"], len(h["args"]), h["line"]) for h in lex(source, "python"))
        assert not want - got, (path, list((want - got).items())[:3])
        n += 1
    assert n >= 200


def test_lines_that_patterns_get_wrong(spark):
    py = 'import requests\nrequests.get("https://h.example/a?ids=1,2")\nlog("requests.get(foo)"); requests.get("https://h.example/z")\nrequests.get("https://a/1"); requests.post("https://b/2", json=(1, [2, 3]))\nrequests.get(url("x"))\nrequests.put(b"raw")\n# requests.get("no")\n'
    java = 'class A {\n void f() {\n  m.put("key", "v"); rest.put("http://pay/v1/a", b);\n  rest.getForObject(String.format("http://c/%s", id), X.class);\n  rest.exchange(base(1, 2) + "/x", HttpMethod.PATCH, e);\n }\n public void delete(String url) {\n }\n}\n'
    ts = "axios.get(`https://h.example/${id(1)}/x`);\nfetch('/p', { method: 'post' });\nfetch('/q');\nconst re = /axios.get(\"\\/no/;\nconst http = axios.create({ timeout: 1, baseURL: 'https://u/' }); http.get('/v'); http.post(`/w/${id}`);\n"
    h, v = found(spark, [("r", "a.py", "python", py), ("r", "A.java", "java", java), ("r", "a.ts", "typescript", ts)])
    got = sorted((r.path, r.line, r.method, r.target) for r in calls.http_calls(h, v).collect())
    assert got == sorted([
        ("a.py", 2, "GET", "https://h.example/a?ids=1,2"), ("a.py", 3, "GET", "https://h.example/z"), ("a.py", 4, "GET", "https://a/1"), ("a.py", 4, "POST", "https://b/2"), ("a.py", 5, "GET", 'url("x")'), ("a.py", 6, "PUT", "raw"),
        ("A.java", 3, "PUT", "http://pay/v1/a"), ("A.java", 4, "GET", "http://c/%s"), ("A.java", 5, "PATCH", "{}/x"),
        ("a.ts", 1, "GET", "https://h.example/{id(1)}/x"), ("a.ts", 2, "POST", "/p"), ("a.ts", 3, "ANY", "/q"),
    ])
    assert sorted((r.line, r.method, r.target) for r in calls.wrapped_axios(h, v).collect()) == [(5, "GET", "https://u/v"), (5, "POST", "https://u/w/{id}")]


def test_express_mounts_and_handlers(spark):
    ts = "app.use('/api', v1);\nv1.get('/orders', list);\nusers.get('/u/:id', handler);\nusers.get('/w', (req, res) => { res.send(`a,b`); });\nr.post(`/x`, auth.check, async function (req, res) {});\nclient.get('/not-a-route');\nclient.get('/nor-this', { headers });\nthis.router.all('/any');\nv1.use('/deep', v2); v2.delete('/z');\naxios.get('https://h/no', cb);\n"
    h, _ = found(spark, [("r", "a.ts", "typescript", ts), ("r", "b.ts", "typescript", "v1.get('/elsewhere', f);\n")])
    got = {(r.path, r.line, r.method, r.route) for r in calls.express_routes(h).collect()}
    assert got == {("a.ts", 2, "GET", "/api/orders"), ("a.ts", 3, "GET", "/u/:id"), ("a.ts", 4, "GET", "/w"), ("a.ts", 5, "POST", "/x"), ("a.ts", 8, "ANY", "/any"), ("a.ts", 9, "DELETE", "/deep/z"), ("b.ts", 1, "GET", "/elsewhere")}


def test_feign_surfaces(spark):
    java = '@FeignClient(name = "billing-service",\n    url = "http://x")\n@RequestMapping("/not-a-method")\ninterface Billing {\n    @GetMapping("/v1/bills/{id}")\n    Bill one(@PathVariable("id") String id);\n    @RequestMapping(method = RequestMethod.POST, value = "/v1/bills")\n    Bill add(Bill b);\n    @DeleteMapping\n    void clear();\n}\n@FeignClient(url = "http://bare")\ninterface Bare {\n}\n@RestController\nclass Other {\n    @GetMapping("/own")\n    String own() {\n        return x;\n    }\n}\n'
    df = spark.createDataFrame([("shop", "B.java", "java", java)], SCHEMA)
    got = calls.feign_surfaces(heads(df), code.symbols(code.lines(df)))
    assert {(r.line, r.target, r.method, r.target_path) for r in got.collect()} == {(1, "billing-service", "GET", "/v1/bills/{id}"), (1, "billing-service", "POST", "/v1/bills"), (1, "billing-service", "DELETE", ""), (12, "http://bare", None, None)}
    asked = got.where("method is not null").selectExpr("xxhash64(method, target_path) as id", "'billing-service' as repo", "method", "target_path as path")
    routes = spark.createDataFrame([("billing-service", "GET", "/v1/bills/:bill"), ("billing-service", "POST", "/api/v1/bills")], "repo string, method string, path string")
    assert {(r.method, r.match_kind) for r in S.match_surfaces(asked, routes).collect()} == {("GET", "exact"), ("POST", "prefix"), ("DELETE", "none")}


@pytest.mark.parametrize("language", ["python", "java", "typescript"])
def test_random_files_end(language):
    """Any text is read to its end, and no head stands inside a plain string."""
    rng = random.Random(9)
    bits = ['"', "'", "`", "${", "}", "{", "(", ")", "[", "]", "f", "get", ".", ",", "+", "\n", "/*", "*/", "//", "#", "@", " ", "=>", "\\", "/", "new ", "é", '"""', "<", ">"]
    for _ in range(400):
        lex("".join(rng.choices(bits, k=rng.randint(0, 60))), language)


def test_messages(spark):
    py = 'import grpc\nproducer.send(\n    "orders", key=1)\nself.p.send("not", x)\nself.p.send("sent", my_producer)\nproducer.send(f"no{x}")\ngrpc.insecure_channel("host:1")\nchannel = grpc.aio.secure_channel(addr)\n'
    h, _ = found(spark, [("r", "a.py", "python", py)])
    imports = spark.createDataFrame([("r", "a.py", 1, "grpc")], "repo string, path string, line int, module string")
    assert {(r.line, r.target, r.dep_type) for r in calls.messages(h, imports).collect()} == {(2, "orders", "kafka"), (5, "sent", "kafka"), (7, "host:1", "grpc"), (8, "unknown", "grpc")}


def test_comments_within_arguments():
    source = "f(a, // one\n" + "\n".join(f"  /* {i}, ) */" for i in range(200)) + "\n b + /* x */ 'y')\n"
    (head,) = lex(source, "typescript")
    assert [(a["kind"], a["raw"]) for a in head["args"]] == [("name", "a"), ("sum", "b +  'y'")]
