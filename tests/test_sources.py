from pyspark.sql import functions as F

from meshlens.sources import calls, code, configs, files
from meshlens.sources.heads import heads

PY = """import os
from shop.models import Order
import requests
BASE = "https://payments.internal"
HOST = os.getenv("USER_URL")

@app.get("/orders/{id}")
def read(id):
    charge(id)
    return requests.get(f"{BASE}/v1/charge/{id}")

class Box:
    def send(self):
        producer.send("orders.created", 1)
        requests.post(HOST + "/users")
"""
JAVA = """package a;
import com.shop.Money;
@RestController
@RequestMapping("/pnr")
public class PnrController {
    @PostMapping("/create")
    public String create(String x) {
        return service.save(x);
    }
    @RequestMapping(value = "/all", method = RequestMethod.GET)
    public String all() {
        return rest.getForObject("http://doli/v1/all", String.class);
    }
}
"""
TS = """import axios from 'axios';
const base = process.env.USER_SERVICE_URL;
export function load(id) {
  return axios.get(`${base}/v1/users/${id}`);
}
router.post('/v1/users', handler);
"""


def tree(tmp_path):
    for name, text in {"src/a.py": PY, "src/PnrController.java": JAVA, "web/client.ts": TS, "node_modules/x.js": "require('left')", ".env": "svc.url = http://legacy.internal/x\n# no=1\nspring=2\n", "pyproject.toml": ""}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    return {"shop": str(tmp_path)}


def test_extraction(spark, tmp_path):
    read = files.read_repos(spark, tree(tmp_path)).cache()
    rows, heads_ = code.lines(files.sources(read)).cache(), heads(files.sources(read)).cache()
    assert sorted(r.module for r in code.imports(rows).collect()) == ["axios", "com.shop.Money", "os", "requests", "shop.models"]
    got = {(r.method, r.target, r.tier) for r in calls.http_calls(heads_, code.variables(rows)).collect()}
    assert got == {("GET", "https://payments.internal/v1/charge/{id}", "call-site"), ("POST", "$ENV:USER_URL/users", "call-site"), ("GET", "http://doli/v1/all", "call-site"), ("GET", "$ENV:USER_SERVICE_URL/v1/users/{id}", "call-site")}
    assert [(r.target, r.dep_type) for r in calls.messages(heads_, code.imports(rows)).collect()] == [("orders.created", "kafka")]
    assert {(r.method, r.route, r.framework) for r in code.routes(rows, heads_).collect()} == {("GET", "/orders/{id}", "fastapi"), ("POST", "/pnr/create", "spring"), ("GET", "/pnr/all", "spring"), ("POST", "/v1/users", "express")}
    found = {(r.qualified_name, r.start_line, r.end_line) for r in code.symbols(rows).collect()}
    assert {("read", 8, 11), ("Box", 12, 15), ("Box.send", 13, 15), ("PnrController", 3, 14), ("PnrController.create", 6, 9), ("load", 3, 5)} <= found
    sites = {(r.caller, r.callee_name) for r in code.call_sites(rows, code.symbols(rows)).collect()}
    assert ("read", "charge") in sites and ("PnrController.create", "save") in sites
    props = [(r.key, r.value, r.line) for r in configs.properties(files.configs(read)).orderBy("line").collect()]
    assert props == [("svc.url", "http://legacy.internal/x", 1), ("spring", "2", 3)]
    assert [(r.repo, r.command) for r in files.test_command(read).collect()] == [("shop", "pytest")]


def test_yaml(spark):
    text = "server:\n  servlet:\n    context-path: /pss\nports: [80, a, b]\n---\nx: 'y'\n"
    df = spark.createDataFrame([("r", "application.yml", text), ("r", "bad.yml", "a: b\n---\n: : {")], "repo string, path string, content string")
    got = [(r.key, r.value) for r in configs.yaml_properties(df).collect()]
    assert got == [("server.servlet.context-path", "/pss"), ("ports", "a"), ("ports", "b"), ("x", "y"), ("a", "b")]


def test_gitignore(spark):
    rows = [("a/x.log", True), ("out/a.py", True), ("src/out/a.py", False), ("lib/a/b/gen/x.py", True), ("src/x.py", False), ("b/keep.log", False)]
    df = spark.createDataFrame([("r", p, None) for p, _ in rows] + [("r", ".gitignore", "# c\n*.log\n/out/\nlib/**/gen\n!keep.log\n")], "repo string, path string, content string")
    kept = {r.path for r in files.not_ignored(df, df).collect()}
    assert all((p not in kept) == gone for p, gone in rows)


def test_tree_reader_plans_by_size_and_prunes(spark, tmp_path):
    import os

    for k in range(60):
        (tmp_path / f"mono/pkg{k % 5}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"mono/pkg{k % 5}/m{k}.py").write_text("x = 1\n" * 50)
    (tmp_path / "mono/node_modules/dep").mkdir(parents=True)
    (tmp_path / "mono/node_modules/dep/x.js").write_text("x")
    (tmp_path / "mono/.git").mkdir()
    (tmp_path / "mono/.git/config").write_text("[remote]")
    (tmp_path / "mono/.git/HEAD").write_text("ref")
    (tmp_path / "small").mkdir()
    (tmp_path / "small/a.py").write_text("y")
    os.chmod(tmp_path / "mono/node_modules", 0)  # opening it would be told as unreadable, but for root
    repos = {"mono": str(tmp_path / "mono"), "small": str(tmp_path / "small"), "gone": str(tmp_path / "gone")}
    read = files.read_repos(spark, repos, piecefiles=8)
    got = read.collect()
    os.chmod(tmp_path / "mono/node_modules", 0o755)
    assert sorted(r.path for r in got if r.repo == "mono") == sorted([".git/config"] + [f"pkg{k % 5}/m{k}.py" for k in range(60)])
    assert [(r.path, r.status) for r in got if r.repo == "gone"] == [(".", "unreadable: No such file or directory")]
    assert read.where("repo = 'mono'").select(F.spark_partition_id()).distinct().count() == 8
    assert files.read_repos(spark, repos, piecebytes=3000).where("repo = 'mono'").select(F.spark_partition_id()).distinct().count() == 6
    reader = files._Reader({"repos": "\n".join(f"{k}={v}" for k, v in repos.items())})
    assert list(reader.pushFilters([files.EqualTo(("repo",), "small"), files.In(("path",), ("a.py", "b.py"))])) == [] and [(p.name, p.files) for p in reader.partitions()] == [("small", ["a.py"])]
    assert [r.path for r in read.where("repo = 'mono' and path = 'pkg1/m1.py'").collect()] == ["pkg1/m1.py"]


def file_of(spark, language, text):
    return spark.createDataFrame([("r", "f", language, text)], "repo string, path string, language string, content string")


def rows_of(spark, language, text):
    return code.lines(file_of(spark, language, text))


def of(spark, language, text):
    """(call heads, variables) of one text."""
    return heads(file_of(spark, language, text)).cache(), code.variables(rows_of(spark, language, text)).cache()


def test_java_calls(spark):
    text = 'String url = "http://a.internal/x";\nrest.put(url, body);\nheaders.put("k", v);\nnew Request.Builder().url("http://b/y");\nnew URL("http://c/z").openConnection();\nws.marshalSendAndReceive(url, req);\nclient.get().uri("/v1/w");\n'
    found = of(spark, "java", text)
    assert {(r.method, r.target) for r in calls.http_calls(*found).collect()} == {("PUT", "http://a.internal/x"), ("ANY", "http://b/y"), ("ANY", "http://c/z")}
    assert [r.target for r in calls.soap_calls(*found).collect()] == ["http://a.internal/x"]
    assert [(r.method, r.target_path) for r in calls.web_client_calls(found[0]).collect()] == [("GET", "/v1/w")]


def test_axios_instance(spark):
    found = of(spark, "typescript", "const api = axios.create({ baseURL: 'https://u.internal/' });\napi.get('/v1/users');\n")
    assert [(r.method, r.target) for r in calls.wrapped_axios(*found).collect()] == [("GET", "https://u.internal/v1/users")]


def test_nest_and_jaxrs(spark):
    nest = file_of(spark, "typescript", "@Controller('cats')\nexport class C {\n  @Get(':id')\n  one() {}\n  @Post()\n  add() {}\n}\n")
    assert {(r.method, r.route) for r in code.routes(code.lines(nest), heads(nest)).collect()} == {("GET", "/cats/:id"), ("POST", "/cats")}
    java = file_of(spark, "java", '@Path("/pay")\npublic class P {\n  @GET\n  @Path("/{id}")\n  public String one() {\n  }\n  @POST\n  public String add() {\n  }\n}\n')
    assert {(r.method, r.route) for r in code.routes(code.lines(java), heads(java)).collect()} == {("GET", "/pay/{id}"), ("POST", "/pay")}


def test_identities_and_bases(spark):
    from meshlens.sources import identities

    rows = [("r", "package.json", '{"name": "@org/billing-api"}'), ("r", "go.mod", "module example.com/x/ledger\n"), ("r", "pyproject.toml", '[project]\nversion = "1"\nname = "tax"\n'), ("r", "k8s/s.yaml", "kind: Deployment\n---\nkind: Service\nmetadata:\n  labels: {}\n  name: payments-svc\n"), ("r", "src/main/resources/application.yml", "spring:\n  application:\n    name: pss\nserver:\n  servlet:\n    context-path: ${CTX:/pss}\n"), ("r", ".git/config", '[remote "origin"]\n\turl = git@h:o/pay.git\n')]
    df = spark.createDataFrame(rows, "repo string, path string, content string")
    got = {(r.alias, r.source) for r in identities.identities(spark.createDataFrame([("my-repo",)], "name string").selectExpr("'r' as name"), df).collect()}
    assert got == {("r", "config"), ("billing", "package"), ("ledger", "go"), ("tax", "package"), ("payments", "k8s"), ("pss", "spring"), ("pay", "git")}
    assert {(r.framework, r.base) for r in identities.base_paths(df).collect()} == {("spring", "/pss"), ("jaxrs", "/pss")}


def test_identities_of_documents(spark):
    """Structured documents: several in a file, names elsewhere in them, broken ones, and the order of files."""
    from meshlens.sources import identities

    rows = [
        ("a", "deploy/all.yml", "apiVersion: v1\nkind: Service\nmetadata: {labels: {name: wrong}, name: right}\n---\nspec:\n  name: other\nkind: Service\nmetadata:\n  annotations:\n    name: no\n---\nkind: Service\nmetadata:\n    name: deep\n---\nkind: Service\nmetadata: {name: 7}\n"),
        ("a", "deploy/broken.yaml", "kind: Service\nmetadata: {name: before}\n---\n{:\n---\nkind: Service\nmetadata: {name: after}\n"),
        ("a", "vendor/x.yaml", "kind: Service\nmetadata: {name: vendored}\n"),
        ("a", "notes.yaml", "text: 'kind: Service'\nmetadata: {name: quoted}\n"),
        ("b", "openapi.yaml", "info: [\n"), ("b", "openapi.json", '{"info": {"title": "Ledger"}, "servers": [{"url": "https://books.internal/v1"}, {"url": "/rel"}, 3]}'), ("b", "swagger.json", '{"info": {"title": "Later"}}'),
        ("c", "application.yml", "spring: {application: {name: 5}}"), ("c", "application.yaml", "spring: {application: {name: flat}}"), ("c", "src/main/resources/application.properties", "spring.application.name=props"),
        ("d", "src/main/resources/application.properties", "x=1\nspring.application.name = props"), ("d", "application.yml", "spring: {}\n---\nspring: {application: {name: second}}\n"),
        ("d", "package.json", '{"name": ["list"]}'), ("d", "pyproject.toml", "# name = 'no'\n[tool.x]\nname = 'tool'\n[project]\ndependencies = ['a[b]']\nname = 'tax'\n"),
        ("e", "package.json", "{"), ("e", "pyproject.toml", "[project"), ("e", "openapi.yml", None), ("e", "go.mod", ""),
    ]
    df = spark.createDataFrame(rows, "repo string, path string, content string")
    names = df.select("repo").distinct().withColumnRenamed("repo", "name")
    got = {}
    for r in identities.identities(names, df).where("source <> 'config'").collect():
        got.setdefault(r.repo, set()).add((r.alias, r.source, r.confidence))
    assert got == {
        "a": {("right", "k8s", 0.9), ("deep", "k8s", 0.9), ("before", "k8s", 0.9)},
        "b": {("ledger", "openapi", 0.7), ("books", "openapi", 0.85)},
        "c": {("flat", "spring", 0.95)},
        "d": {("props", "spring", 0.95), ("tax", "package", 0.9)},
    }
    assert identities.identities(names.where("false"), df.where("false")).count() == 0
