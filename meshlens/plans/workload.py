"""Views of the driver's tables in the shapes that the operators take. Each has its SQL twin in oracle.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.functions import identity as I
from meshlens.functions import paths as P
from meshlens.operators.checkpoints import written
from meshlens.operators.fanout import endpoint_fanout
from meshlens.operators.partitions import dealt, partitions_for
from meshlens.operators.resolve import resolve
from meshlens.sources import code
from meshlens.sources.heads import heads


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _next_lines(spark: SparkSession, sf_dir: str, n: int | None) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("place")
    a = item.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_returnflag", "l_linestatus", (F.col("l_linenumber") + 1).alias("next_line"), place)
    b = item.select("l_orderkey", F.col("l_linenumber").alias("next_line"), F.col("l_partkey").alias("to_part"))
    keys = ["l_orderkey", "next_line"]
    rows = dealt(a, n, *keys).join(dealt(b, n, *keys), keys).where("l_partkey <> to_part")
    return rows.select(
        F.concat(F.lit("p"), "l_partkey").alias("from_repo"), F.concat(F.lit("p"), "to_part").alias("to_repo"),
        F.when(F.col("l_returnflag") == "A", "http").when(F.col("l_returnflag") == "N", "kafka").otherwise("import").alias("dep_type"),
        ((F.round(F.col("l_discount") * 100).cast("int") * 5 + 50) / 100.0).alias("confidence"),
        F.concat(F.lit("o"), "l_orderkey", F.lit(":"), "l_linenumber").alias("evidence"),
        F.when(F.col("l_linestatus") == "O", "call-site").otherwise("config").alias("tier"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "place",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive lines of an order: a's part calls b's part. A large table's are dealt by their parts in partitions of its size.

    An order may have several lines of one number, which are equal in ord and evidence; place is a's in the table."""
    n = partitions_for(table(spark, sf_dir, "lineitem"))
    return dealt(_next_lines(spark, sf_dir, n), n, "from_repo", "to_repo")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("from_repo", "to_repo").distinct()


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(lines(spark, sf_dir))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, host, path, word): word is the name within the host."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    split = P.split_host_path(F.col("url"))
    return rows.withColumns({"host": split["host"], "path": split["path"]}).withColumn("word", F.regexp_extract("host", r"([a-z]+)\.example", 1))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host names its word's repository, and so does the bare word."""
    rows = pages(spark, sf_dir)
    https = F.when(F.col("url").startswith("https"), 0.9).otherwise(0.7)
    host = rows.select(F.col("word").alias("repo"), I.normalize_identity(F.col("host")).alias("alias"), F.col("host").alias("raw"), F.lit("k8s").alias("source"), https.alias("confidence"), (F.col("page_id") * 2).alias("ord"))
    bare = rows.select(F.col("word"), I.normalize_identity(F.concat("word", F.lit("-service"))), F.concat("word", F.lit("-service")), F.lit("package"), F.lit(0.8), F.col("page_id") * 2 + 1)
    return host.union(bare)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies whose targets name repositories in four ways: a URL, a plural, a longer name, an outside one."""
    rows = pages(spark, sf_dir)
    kind = F.col("page_id") % 4
    to = F.when(kind == 0, F.col("url")).when(kind == 1, F.concat("word", F.lit("s-svc"))).when(kind == 2, F.concat(F.lit("core-"), "word")).otherwise(F.concat(F.lit("zz"), "page_id", F.lit("-external")))
    return rows.select(
        F.when(F.col("page_id") % 5 == 0, F.col("word")).otherwise(F.lit("front")).alias("from_repo"), to.alias("to_repo"),
        F.array(F.when(F.col("page_id") % 3 == 0, "import").otherwise("http")).alias("dep_types"), ((F.col("page_id") % 10) / 10.0).alias("confidence"),
        F.array(F.concat(F.lit("e"), "page_id")).alias("evidence"), F.when(F.col("page_id") % 2 == 0, "call-site").otherwise("config").alias("tier"), F.col("page_id").alias("ord"),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("page_id") % 3
    return pages(spark, sf_dir).select(
        F.col("word").alias("repo"), F.when(kind == 0, "GET").when(kind == 1, "POST").otherwise("").alias("method"), "path",
        F.when(kind == 0, "spring").otherwise("express").alias("framework"), F.concat(F.lit("src/F"), F.col("page_id") % 7, F.lit(".java")).alias("file"), (F.col("page_id") % 100).cast("int").alias("line"),
    )


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the pages' paths: as they are, behind a gateway's prefix, or of a path that nobody serves."""
    kind = F.col("page_id") % 4
    path = F.when(kind == 0, F.col("path")).when(kind == 1, F.concat(F.lit("/gw"), "path")).when(kind == 2, F.col("path")).otherwise(F.concat(F.lit("/none"), "page_id"))
    return pages(spark, sf_dir).select(
        F.col("page_id").alias("id"), F.concat(F.lit("front"), F.col("page_id") % 5).alias("from_repo"), F.col("word").alias("repo"),
        F.when(F.col("page_id") % 2 == 0, "GET").otherwise("POST").alias("method"), path.alias("path"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as methods: a size's repository, a file of 50, a span of lines."""
    start = (F.col("p_partkey") * 7 % 400 + 1).cast("int")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("s"), "p_size").alias("repo"), F.concat(F.lit("src/F"), F.col("p_partkey") % 50, F.lit(".java")).alias("file"), F.lit("java").alias("language"),
        F.when(F.col("p_partkey") % 6 == 0, "class").otherwise("method").alias("kind"), F.col("p_name").alias("name"), F.concat(F.col("p_brand"), F.lit("."), F.col("p_name"), F.lit("_"), F.col("p_partkey")).alias("qualified_name"),
        F.col("p_type").alias("signature"), start.alias("start_line"), (start + F.col("p_size")).alias("end_line"), F.col("p_partkey").alias("ord"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as call sites of their type."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("repo"), F.concat(F.lit("F"), F.col("event_id") % 50, F.lit(".java")).alias("file"), F.col("event_type").alias("callee_name"),
        (F.col("event_id") % 400).cast("int").alias("line"), F.col("event_id").alias("ord"),
    )


def found_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, caller, callee_name): within a size's repository, a part calls the next line's part's name. Some may be found twice.

    Names are looked up first: a part calls fewer names than parts, and its own name is the longest of the columns."""
    n = partitions_for(table(spark, sf_dir, "lineitem"))
    sym = symbols(spark, sf_dir).select("repo", "qualified_name", "name", F.concat(F.lit("p"), "ord").alias("node"))
    callers, callees = sym.select("repo", F.col("qualified_name").alias("caller"), F.col("node").alias("from_repo")), sym.select(F.col("name").alias("callee_name"), F.col("node").alias("to_repo"))
    named = dealt(_next_lines(spark, sf_dir, n).select("from_repo", "to_repo"), n, "to_repo").join(callees, "to_repo").select("from_repo", "callee_name")
    return dealt(named, n, "from_repo").distinct().join(callers, "from_repo").select("repo", "caller", "callee_name")


def part_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls found, each once. Dealt as lines are."""
    return dealt(found_calls(spark, sf_dir), partitions_for(table(spark, sf_dir, "lineitem")), "repo", "caller", "callee_name").distinct()


def pair_partitions(spark: SparkSession, sf_dir: str) -> int | None:
    """More partitions for the pairs of the call graph, which are many times as many as the lines."""
    return partitions_for(table(spark, sf_dir, "lineitem"), 50_000)


def part_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes declared on the first lines of the parts."""
    path = F.concat(F.lit("/"), F.regexp_replace("name", " ", "-"))
    return symbols(spark, sf_dir).select("repo", F.lit("GET").alias("method"), path.alias("path"), "file", F.col("start_line").alias("line"))


def part_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbound calls on the last lines of the parts."""
    return symbols(spark, sf_dir).select("repo", F.concat(F.lit("t"), F.col("ord") % 9).alias("target"), F.concat(F.lit("GET /k"), F.col("ord") % 5).alias("key"), "file", F.col("end_line").alias("line"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as notes on one of ten repositories; roles are kinds that nobody knows, but for the user's."""
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat(F.lit("c"), F.col("conv_id") % 10).alias("repo"),
        F.when(F.col("role") == "user", "gotcha").otherwise(F.col("role")).alias("kind"), F.col("text").alias("note"), F.lit("").alias("created_at"),
    )


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' methods, each in its part's own repository."""
    return symbols(spark, sf_dir).withColumn("repo", F.concat(F.lit("p"), "ord"))


def fanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoint_fanout(part_routes(spark, sf_dir), symbols(spark, sf_dir), part_calls(spark, sf_dir), part_surfaces(spark, sf_dir))


def calls_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls whom among the pages' words, as dependencies with a confidence."""
    rows = surfaces(spark, sf_dir)
    return rows.select("from_repo", F.col("repo").alias("to_repo"), ((F.col("id") % 10) / 10.0).alias("confidence"), (F.col("id") % 3 == 0).alias("import_only"))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned repositories: the parts that are in stock, every one of the table."""
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.concat(F.lit("/repos/"), "p_brand").alias("path"))


JAVA = """package a;
import com.{word}.Client;
// rest.getForObject("http://no/comment");
/* import x.Y;
 rest.put("http://no/{id}", b); */
@RestController
@RequestMapping("/v{five}")
public class C{id} {
    String base = "https://{host}";
    @GetMapping(
        "/{word}/{id}")
    public String one(String x) {
        String s = "rest.getForObject(base)";
        return rest.getForObject(
            base + "/a/{id}",
            String.class);
    }
    @PostMapping("/add")
    public void add(String x) throws IOException {
        one(x);
        ws.marshalSendAndReceive("http://{host}/soap/{id}", x);
        web.get()
            .uri("/w/{id}");
    }
}
@FeignClient(
    name = "{word}-client")
interface F{id} {
}
"""
PYTHON = '''import os, sys as system
from {word}.models import Thing
BASE = os.getenv("{word}_URL")
# requests.get("http://no")
"""
requests.post("http://no")
"""
class P{id}:
    def load(self, x):
        return requests.get(
            BASE + "/b/{id}")

def send():
    producer.send("topic.{word}", 1)
    load(1)
@app.route("/r/{id}", methods=["GET", "POST"])
def handler():
    return 1
'''
SCRIPT = """import {{
  axios }} from '{word}-sdk';
const client = axios.create({{ baseURL: 'https://{host}' }});
// fetch('http://no')
export class T{id} {{
  async load(key: string): Promise<void> {{
    await client.get('/c/{id}');
    return fetch('https://{host}/d/{id}', {{ method: 'PUT' }});
  }}
}}
router.post(
  '/e/{id}', handler);
@Controller('k{id}')
export class K {{
  @Get(':key')
  one() {{
  }}
}}
"""
CONFIG = """# svc.url=http://no/{id}
server.servlet.context-path=/base{five}
spring.application.name={word}-service
billing.url = https://{host}/pay/{id}
db.url=jdbc:postgresql://{host}/x
"""


def _filled(template: str):
    """A template with a page's id, word, host and id modulo five put in."""
    return _put(F.lit(template.replace("{{", "{").replace("}}", "}")))


def _put(out):
    for name, value in (("id", F.col("page_id").cast("string")), ("word", F.col("word")), ("host", F.col("host")), ("five", (F.col("page_id") % 5).cast("string"))):
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return out


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file for each page: Java, Python or TypeScript, with calls over several lines, comments and strings that look like calls."""
    kind = F.col("page_id") % 3
    return pages(spark, sf_dir).select(
        F.concat(F.lit("r"), F.col("page_id") % 20).alias("repo"),
        F.when(kind == 0, F.concat(F.lit("src/C"), "page_id", F.lit(".java"))).when(kind == 1, F.concat(F.lit("app/p"), "page_id", F.lit(".py"))).otherwise(F.concat(F.lit("web/t"), "page_id", F.lit(".ts"))).alias("path"),
        F.when(kind == 0, "java").when(kind == 1, "python").otherwise("typescript").alias("language"),
        F.when(kind == 0, _filled(JAVA)).when(kind == 1, _filled(PYTHON)).otherwise(_filled(SCRIPT)).alias("content"),
    )


def file_partitions(spark: SparkSession, sf_dir: str) -> int | None:
    """As many as the pages' files take at 4000 of them a partition."""
    return partitions_for(table(spark, sf_dir, "pages"), 4000)


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.lines(code_files(spark, sf_dir), file_partitions(spark, sf_dir))


#: Statements of files that differ from page to page: {i} is the statement's place. Their facts stand in the SQL twin.
STATEMENTS = {
    "python": [
        'requests.get("https://{host}/a/{i}?ids=1,{i}")',
        'log("requests.get(no)", requests.post(f"https://{host}/f/{BASE}/{i}", json={"a": [1, 2]}))  # requests.get("x")',
        'httpx.put(url("x", {i}), data=b"y"); httpx.delete("https://{host}/d/{i}")',
        'other.get("https://{host}/no")',
        'requests.head(BASE + "/p/{i}" + tail(1, 2))',
        "text = 'requests.get(\"https://{host}/no\")'",
    ],
    "java": [
        'rest.getForObject(base + "/a/{i}" + f(1, 2), String.class);',
        'map.put("k,{i}", "v"); rest.put("http://{word}/p/{i}", b);',
        'rest.exchange(String.format("http://{word}/%s", x(1)), HttpMethod.PATCH, e);',
        'String s = "rest.delete(\\"http://no\\")";',
        'new URL("http://{word}/u/{i}").openConnection(); // rest.getForObject("http://no", c)',
        'repository.delete(entity.get(1, 2)); rest.postForEntity(base, x(")"), y);',
    ],
    "typescript": [
        "axios.get(`https://{host}/t/${id(1)}/${base}/{i}`, { headers: { a: [1, 2] } });",
        "fetch('https://{host}/f,{i}', { method: 'put', body: f(\")\") });",
        "const r{i} = /fetch\\(\"no/; got.post(\"/g/{i}\").then(x => ky.delete('https://{host}/k/{i}'));",
        "axios.get(base);",
        "/* axios.get('no') */ fetch(a ? 'x' : 'y');",
        "mounted.get('/u/{i}', (req, res) => res.send('a, b')); other.post('/v/{i}', check.auth, list); client.get('/w/{i}');",
    ],
}
BEGINNINGS = {"python": 'import requests, httpx\nBASE = "{word}"\n', "java": 'class C{id} {\nString base = "https://{host}";\n', "typescript": "const base = '{word}';\napp.use('/m{five}', mounted);\n"}


def varied_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of 4 to 12 statements for each page, chosen by page and place; the last lines of Java declare a client."""
    kind = F.col("page_id") % 3

    def body(language: str):
        variants = F.array(*[F.lit(x) for x in STATEMENTS[language]])
        lines = F.transform(F.sequence(F.lit(1), F.col("page_id") % 9 + 4), lambda i: F.replace(variants[((F.col("page_id") * 7 + i * 5) % 6).cast("int")], F.lit("{i}"), i.cast("string")))
        return _put(F.concat(F.lit(BEGINNINGS[language]), F.array_join(lines, "\n")))

    posts = F.array_join(F.transform(F.sequence(F.lit(1), F.col("page_id") % 4 + 1), lambda j: F.concat(F.lit('    @PostMapping(value = "/p'), j, F.lit('", consumes = "a/b")\n    void p'), j, F.lit("(X x);\n"))), "")
    client = F.concat(_put(F.lit('\n}\n@FeignClient(name = "{word}-client")\ninterface F{id} {\n    @GetMapping("/g/{id}/{x}")\n    X one(@PathVariable("x") String x);\n')), posts, F.lit("}\n"))
    return pages(spark, sf_dir).select(
        F.concat(F.lit("r"), F.col("page_id") % 20).alias("repo"), F.concat(F.lit("v"), "page_id", F.when(kind == 0, ".java").when(kind == 1, ".py").otherwise(".ts")).alias("path"), F.when(kind == 0, "java").when(kind == 1, "python").otherwise("typescript").alias("language"),
        F.when(kind == 0, F.concat(body("java"), client)).when(kind == 1, body("python")).otherwise(body("typescript")).alias("content"),
    )


def code_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(heads(code_files(spark, sf_dir)))  # read once, as the engine stores them


def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A properties file and a package file for each page, in repositories of their own."""
    rows = pages(spark, sf_dir).withColumn("repo", F.concat(F.lit("r"), "page_id"))
    plain = rows.select("repo", F.lit("src/main/resources/application.properties").alias("path"), _filled(CONFIG).alias("content"))
    return plain.union(rows.select("repo", F.lit("package.json"), F.concat(F.lit('{"name": "@shop/'), "word", F.lit('-api"}'))))


#: Files in which a page's repository declares names: (path, which pages by id, content).
DECLARED = (
    ("pyproject.toml", "true", '# name = "no"\n[tool.x]\nname = "no"\n[project]\nkeywords = ["a[b]"]\nname = "{word}-ledger{five}"\n'),
    ("go.mod", "true", "// module no\nmodule git.example/x/{word}-mod{five}\n"),
    ("application.yaml", "page_id % 2 = 0", "spring:\n  profiles: {{name: no}}\n  application: {{name: '{word}-boot'}}\n"),
    ("src/main/resources/application.properties", "true", "server.port=1\nspring.application.name={word}-props\n"),
    ("deploy/all.yaml", "true", "kind: Deployment\nmetadata: {{name: no}}\n---\nkind: Service\nmetadata:\n  labels:\n    name: no\n  name: {word}-svc{five}\n---\nmetadata: {{name: 'core-{word}-{id}'}}\nkind: Service\n---\n[\n---\nkind: Service\nmetadata: {{name: no-{word}}}\n"),
    ("openapi.yaml", "page_id % 3 = 0", "info: [\n"),
    ("openapi.yaml", "page_id % 3 > 0", "info: {{title: '{word} Orders'}}\nservers:\n- url: https://{host}/api\n- url: /relative\n- url: http://{word}.internal:80\n"),
    ("swagger.json", "true", '{{"info": {{"title": "{word} Books", "name": "no"}}}}'),
    (".git/config", "true", '[remote "origin"]\n\turl = git@{host}:o/{word}-repo.git\n'),
)


def declared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of DECLARED for each page, in repositories of their own."""
    rows = pages(spark, sf_dir).withColumn("repo", F.concat(F.lit("d"), "page_id"))
    each = [F.when(F.expr(where), F.struct(F.lit(path).alias("path"), _filled(content).alias("content"))) for path, where, content in DECLARED]
    return rows.select("repo", F.explode(F.array_compact(F.array(*each))).alias("file")).select("repo", "file.*")
