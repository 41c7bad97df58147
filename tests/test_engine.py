import json

from pyspark.sql import functions as F

from meshlens.engine import DependencyEngine
from meshlens.operators import documents, exports, reports, skills
from meshlens.operators.store import Store, with_columns_of
from meshlens.sources import organisations
from meshlens.streaming.incremental import follow


def test_scan_and_ask(spark, tmp_path):
    trees = {"order-service": {"main.py": 'import requests\nURL = "https://payment-service.internal"\n\n@app.post("/orders")\ndef create(x):\n    return charge(x)\n\ndef charge(x):\n    return requests.post(f"{URL}/v1/charge")\n'}, "payment-service": {"app.py": '@app.post("/v1/charge")\ndef charge():\n    pass\n'}}
    for repo, named in trees.items():
        for name, text in named.items():
            (tmp_path / repo).mkdir(exist_ok=True)
            (tmp_path / repo / name).write_text(text)
    engine = DependencyEngine(spark, str(tmp_path / "store"))
    engine.scan({r: str(tmp_path / r) for r in trees})
    deps = engine.dependencies_of("order-service").collect()
    assert [(d.to_repo, d.dep_types, d.confidence) for d in deps] == [("payment-service", ["http"], 1.0)]
    assert [r.match_kind for r in engine.table("surfaces").collect()] == ["exact"]
    assert [r.node for r in engine.blast_radius("payment-service").collect()] == ["order-service"]
    assert engine.fanout().count() == 0  # a Python route stands on its decorator's line, outside of its handler's span
    assert engine.add_alias("payment-service", "billing-svc") == "billing"
    assert engine.impact("payment-service").first().n_dependents == 1
    out = json.loads(reports.export_json(engine.table("dependencies"), "order-service"))
    assert out["summary"] == {"total_deps": 1, "high_confidence": 1} and reports.violations(engine.table("dependencies")).count() == 0
    scoped = reports.scoped_dependents(engine.table("dependencies"), engine.table("surfaces"), "payment-service", "post /v1/charge")
    assert "order-service" in reports.impact_markdown(engine.impact("payment-service"), scoped)
    assert reports.parse_endpoint("/x") == ("ANY", "/x")


def test_scan_takes_declarations(spark, tmp_path):
    trees = {
        "web": {"application.yml": "pay:\n  url: http://billing-api.internal/v2/charge\n", ".env": "PAY_URL='http://billing-api.internal/v2/charge'\nSTOCK_URL=http://depot/items\n", "a.py": "import company.ledger\n"},
        "repo-x": {"src/main/resources/application.properties": "spring.application.name=billing-api\nserver.servlet.context-path=/v2\n", "A.java": '@RestController\npublic class A {\n    @PostMapping("/charge")\n    public String c() {\n        return x;\n    }\n}\n'},
        "repo-y": {".git/config": '[remote "origin"]\n    url = git@host:team/depot.git\n'},
    }
    for repo, named in trees.items():
        for name, text in named.items():
            (tmp_path / repo / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / repo / name).write_text(text)
    engine = DependencyEngine(spark, str(tmp_path / "store"))
    engine.scan({r: str(tmp_path / r) for r in trees})
    assert {(d.to_repo, d.confidence, d.tier) for d in engine.dependencies_of("web").collect()} == {("repo-x", 0.95, "config"), ("repo-y", 0.85, "config")}
    assert [r.path for r in engine.table("routes").collect()] == ["/v2/charge"]
    assert {(r.repo, r.match_kind) for r in engine.table("surfaces").collect()} == {("repo-x", "exact"), ("repo-y", "none")}
    assert ("web", "ledger", "import") in {(r.from_repo, r.to_repo, r.dep_type) for r in engine.table("signals").collect()}


def test_scans_keep_other_repositories(spark, tmp_path):
    def put(repo, name, text):
        (tmp_path / repo).mkdir(exist_ok=True)
        (tmp_path / repo / name).write_text(text)
        return {repo: str(tmp_path / repo)}

    engine = DependencyEngine(spark, str(tmp_path / "store"))
    a = put("shop", "a.py", 'import requests\ndef old():\n    pass\nrequests.get("http://billing-svc/v1/x")\n')
    engine.scan(a)
    assert [d.to_repo for d in engine.dependencies_of("shop").collect()] == ["billing-svc"]
    engine.scan(put("billing", "b.py", '@app.get("/v1/x")\ndef x():\n    pass\n'))
    names = lambda t, c: {r[0] for r in engine.table(t).select(c).distinct().collect()}
    assert names("repos", "name") == {"shop", "billing"} and names("symbols", "repo") == {"shop", "billing"} and names("dependencies", "from_repo") == {"shop"}
    assert [r.repo for r in engine.search_symbols("O").collect()] == ["shop"]
    engine.index_symbols()
    assert [r.name for r in engine.search_symbols("ol%").collect()] == ["old"] and engine.search_symbols("old", repo="billing").count() == 0 and engine.search_symbols("old").count() == 1
    engine.relink()
    assert [(d.to_repo) for d in engine.dependencies_of("shop").collect()] == ["billing"] and {r.match_kind for r in engine.table("surfaces").collect()} == {"exact"}
    put("shop", "a.py", "def new():\n    pass\n")  # nothing replaces the calls
    engine.scan(a)
    assert {r.name for r in engine.table("symbols").collect()} == {"new", "x"} and engine.table("surfaces").count() == 0
    assert [d.to_repo for d in engine.dependencies_of("shop").collect()] == ["billing"]  # what isn't found again stays until relink
    engine.relink()
    assert engine.table("dependencies").count() == 0


def test_store_by_repository(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = lambda *r: spark.createDataFrame(list(r), "repo string, n int")
    read = lambda v=None: sorted((r.repo, r.n) for r in store.read("t", v).collect())
    store.replace("t", rows(("a", 1), ("b", 1)), ["a", "b"])
    store.replace("t", rows(("a", 2)), ["a"])
    assert read() == [("a", 2), ("b", 1)] and read(1) == [("a", 1), ("b", 1)]
    store.replace("t", rows(), ["a", "b"])
    store.replace("t", rows(("c", 3)), ["c"])
    assert read() == [("c", 3)]
    # two writers from one manifest: the second makes its own anew
    base, commit = store.manifest("t"), store._commit
    other = Store(spark, store.folder)
    store._commit = lambda name, old, parts: (other.replace("t", rows(("d", 4)), ["d"]) if old["version"] == base["version"] else None, commit(name, old, parts))[1]
    store.replace("t", rows(("e", 5)), ["e"])
    store._commit = commit
    assert read() == [("c", 3), ("d", 4), ("e", 5)] and store.manifest("t")["version"] == base["version"] + 2
    store.compact("t")
    assert read() == [("c", 3), ("d", 4), ("e", 5)] and len(store.manifest("t")["parts"]) == 1
    assert len(store.vacuum("t", keep=1)) >= 4 and read() == [("c", 3), ("d", 4), ("e", 5)] and store._versions("t") == [store.manifest("t")["version"]]
    for k in range(40):
        store.replace("t", rows((f"x{k % 3}", k)), [f"x{k % 3}"])
    assert len(store.manifest("t")["parts"]) <= 33 and read() == [("c", 3), ("d", 4), ("e", 5), ("x0", 39), ("x1", 37), ("x2", 38)]


def test_document_constraints(spark):
    """A document of the nested shape is right; each kind of fault is told by its path."""
    good = {
        "version": "1.0", "scanned_at": "2026-06-23T13:10:22+00:00", "repo": {"name": "shop", "path": "/r", "primary_language": ""}, "summary": {"total_deps": 1, "high_confidence": 0, "services_called": ["a"], "services_calling_me": []},
        "dependencies": [{"from": "shop", "to": "a", "types": ["http", "import"], "confidence": 0.6, "tier": "config", "evidence": [{"file": "A.java", "line": 3, "snippet": ""}, {"file": "x", "line": 0, "snippet": ""}], "surfaces": [{"channel": "http", "method": "GET", "path": "/x", "key": "GET /x", "matched": True, "match_kind": "exact", "evidence": "A.java:3"}], "metadata": {}}],
    }

    def broken(change):
        doc = json.loads(json.dumps(good))
        change(doc)
        return json.dumps(doc)

    d = lambda doc: doc["dependencies"][0]
    cases = {
        "a": (broken(lambda x: None), set()), "b": ("{", {("$", "is not JSON")}), "c": (broken(lambda x: x.pop("repo")), {("$.repo", "is missing")}), "d": (broken(lambda x: x["repo"].update(path=4)), {("$.repo.path", "is not of kind string")}),
        "e": (broken(lambda x: d(x).update(confidence=1.5)), {("$.dependencies[0].confidence", "is out of range")}), "f": (broken(lambda x: d(x).update(confidence="1")), {("$.dependencies[0].confidence", "is not of kind number")}),
        "g": (broken(lambda x: d(x)["types"].append("smoke")), {("$.dependencies[0].types[2]", "is none of its words")}), "h": (broken(lambda x: d(x)["evidence"][1].update(line="9")), {("$.dependencies[0].evidence[1].line", "is not of kind integer")}),
        "i": (broken(lambda x: d(x)["surfaces"][0].update(match_kind="no")), {("$.dependencies[0].surfaces[0].match_kind", "is none of its words")}), "j": (broken(lambda x: x["dependencies"].append(7)), {("$.dependencies[1]", "is not of kind object")}),
        "k": (broken(lambda x: (x.pop("version"), d(x).pop("to"))), {("$.version", "is missing"), ("$.dependencies[0].to", "is missing")}), "l": (broken(lambda x: x.update(summary={"total_deps": 1.5})), {("$.summary.total_deps", "is not of kind integer")}),
    }
    docs = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "repo string, document string").cache()
    found = {}
    for r in documents.violations(docs).collect():
        found.setdefault(r.repo, set()).add((r.path, r.rule))
    assert found == {k: v[1] for k, v in cases.items() if v[1]}
    assert [(r.from_repo, r.to_repo, r.dep_types, r.confidence, r.evidence, r.tier, r.surfaces[0].key) for r in documents.dependencies(docs.where("repo = 'a'")).collect()] == [("shop", "a", ["http", "import"], 0.6, ["A.java:3", "x"], "config", "GET /x")]
    assert [r.repo for r in documents.parsed(docs).where("corrupt is not null").orderBy("repo").collect()][:1] == ["b"]


def test_incremental(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    schema = "repo string, path string"
    store.write("paths", spark.createDataFrame([("a", "old"), ("b", "kept")], schema))
    spark.createDataFrame([("a", "new")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    follow(stream, store, "paths", lambda df: df.select("repo", F.upper("path").alias("path")), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, store.read("paths").collect())) == [("a", "NEW"), ("b", "kept")]


CONTROLLER = """package a;
@RestController
@RequestMapping("/pnr")
public class PnrController {
    @PostMapping("/create")
    public String create(String x) {
        return save(x);
    }
}
"""
SERVICE = """package a;
public class PnrService {
    public String save(String x) {
        return send(x);
    }
    public String send(String x) {
        // return rest.getForObject("http://nobody/x", String.class);
        return rest.postForObject(
            "http://doli/v1/book",
            x, String.class);
    }
}
"""


def test_scan_of_an_organisation(spark, tmp_path):
    trees = {
        "pss": {"src/PnrController.java": CONTROLLER, "src/PnrService.java": SERVICE, ".gitignore": "gen/*\n!gen/Kept.java\n", "gen/Out.java": 'class O {\n  void f() {\n    rest.getForObject("http://ghost/x", String.class);\n  }\n}\n', "gen/Kept.java": 'class K {\n  void f() {\n    rest.getForObject("http://depot/items", String.class);\n  }\n}\n'},
        "doli": {"app.py": '@app.post(\n    "/v1/book")\ndef book():\n    pass\n'},
        ".hidden": {"a.py": "x = 1\n"},
    }
    for repo, named in trees.items():
        for name, text in named.items():
            (tmp_path / "org" / repo / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / "org" / repo / name).write_text(text)
    (tmp_path / "org" / "doli" / "broken.py").symlink_to(tmp_path / "nowhere")
    (tmp_path / "org.yml").write_text("repos:\n- path: org/pss\n- path: org/doli\n  name: doli\n")
    assert organisations.from_yaml(str(tmp_path / "org.yml")) == organisations.from_directory(str(tmp_path / "org"))
    engine = DependencyEngine(spark, str(tmp_path / "store"))
    engine.scan_organisation(str(tmp_path / "org.yml"))
    assert [(r.repo, r.path) for r in engine.table("unreadable").collect()] == [("doli", "broken.py")]
    assert {r.to_repo for r in engine.dependencies_of("pss").collect()} == {"doli", "depot"}
    calls = [(r.ep_key, r.target, r.key, r.hops, r.confidence, r.via) for r in engine.route_calls("pss").collect()]
    assert calls == [("POST /pnr/create", "doli", "POST /v1/book", 2, 0.6, ["create", "save", "send"])]
    assert [(r.from_repo, r.endpoints, r.in_blast) for r in engine.impact_of_endpoint("doli", "post /v1/book").collect()] == [("pss", ["POST /v1/book"], True)]
    assert engine.impact_of_endpoint("doli", "get /v1/book").count() == 0
    engine.remember("pss", "codes are six letters", "gotcha")
    engine.remember("pss", "ask first", "rule")
    assert [(n.id, n.kind, n.note) for n in engine.recall("pss").collect()] == [(1, "gotcha", "codes are six letters"), (2, "note", "ask first")]
    engine.forget(1)
    assert [n.id for n in engine.recall("pss").collect()] == [2] and engine.recall("pss", "gotcha").count() == 0
    engine.write_skills(str(tmp_path / "skills"))
    text = skills.read_skill(spark, str(tmp_path / "skills"), "pss")
    assert "name: work-in-pss" in text and "- doli (http, 100%)" in text and "- (note) ask first" in text and "public String create(String x)" in text
    assert {r.repo for r in skills.read_index(spark, str(tmp_path / "skills")).collect()} == {"pss", "doli"} and skills.read_skill(spark, str(tmp_path / "skills"), "none") is None
    engine.write_documents(str(tmp_path / "docs"), "2024-05-01T00:00:00")
    docs = documents.read_documents(spark, str(tmp_path / "docs/dependencies")).cache()
    assert documents.violations(docs).count() == 0 and {r.repo for r in docs.collect()} == {"pss", "doli"}
    doc = json.loads(docs.where("repo = 'pss'").first().document)
    assert doc["repo"]["name"] == "pss" and doc["summary"]["total_deps"] == 2 and [s["key"] for d in doc["dependencies"] for s in d["surfaces"] if d["to"] == "doli"] == ["POST /v1/book"]
    faces = {r.repo: json.loads(r.document)["repos"][r.repo] for r in documents.read_documents(spark, str(tmp_path / "docs/interfaces")).collect()}
    assert faces["doli"]["provides"] == ["POST /v1/book"] and "doli POST /v1/book" in faces["pss"]["consumes"]
    assert {(r.kind, r.repo) for r in engine.impact_of_symbol("doli", "send").collect()} == {("definition", "pss"), ("caller", "pss")}
    engine.export(str(tmp_path / "export"))
    back = exports.load_export(spark, str(tmp_path / "export")).orderBy("to_repo").collect()
    assert [(r.to_repo, r.dep_types, r.evidence) for r in back] == [(d.to_repo, d.dep_types, [e if e[-1].isdigit() else e.rpartition(":")[0] for e in d.evidence]) for d in engine.table("dependencies").orderBy("to_repo").collect()]  # what is behind a last colon is a line, or 0
    assert engine.add_alias("doli", "booking-svc") == "booking" and engine.remove_alias("doli", "booking-svc") and not engine.remove_alias("doli", "booking-svc")
    engine.store.clear("dependencies")
    assert engine.table("dependencies").count() == 0
    assert exports.interfaces_name("a/org-deps.json") == "a/org-interfaces.json" and exports.interfaces_name("graph.json") == "graph-interfaces.json"
    grown = with_columns_of(engine.table("repos"), "name string, path string, scanned_at string")
    assert grown.columns == ["name", "path", "scanned_at"] and grown.first().scanned_at is None
