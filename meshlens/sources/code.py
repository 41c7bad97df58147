"""Facts from source text: imports, variables, routes, symbols. What calls mean is in sources.calls.

Each file is split into lines once, without comments. A line also knows the rest of its statement (`more`): the lines
that follow while one ends openly or the next one goes on. A fact is a pattern that begins on a line and is read from
its statement, so a call counts for the line of its head, whatever lines its arguments take. What needs more than a
statement (a variable's value, the class around a method, the end of a block) is a join or a window over the file's lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlens.functions import paths as P
from meshlens.operators.partitions import dealt
from meshlens.sources.calls import express_routes

_STRING = r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`[^`]*`)"""
_CONTENT = r"""(["'`])(?:\\.|(?!\1).)*\1"""
_OPEN_END = r"(?:[(\[,+=?.]|&&|\|\||=>)\s*$|^\s*import\b[^'\"}]*\{[^}]*$"
_GOES_ON = r"^\s*(?:\.\w|\}\s*from\b|[)\]]|\+ |\? |: |&&|\|\|)"


def without_comments(rows: DataFrame) -> DataFrame:
    """rows with the text outside comments; strings stay. A comment over several lines, or a Python text in triple quotes
    that stands alone, leaves empty lines."""
    t, python = F.col("text"), F.col("language") == "python"
    before = Window.partitionBy("repo", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    # strings are kept, comments that end on their line are not: in place of either stands what the first group holds
    plain = F.when(python, F.regexp_replace(t, _STRING.replace("|`[^`]*`", "") + r"|#.*$", "$1")).otherwise(F.regexp_replace(t, _STRING + r"|//.*$|/\*.*?\*/", "$1"))
    bare = F.regexp_replace(plain, _STRING, "")
    quotes = F.size(F.split(t, r"\"\"\"|\x27\x27\x27")) - 1
    mark = F.when(~python & bare.rlike(r"/\*"), "open").when(~python & bare.contains("*/"), "closed")
    marked = rows.withColumns({"plain": plain, "quotes": F.when(python, quotes).otherwise(0), "mark": mark})
    inside = (F.last("mark", ignorenulls=True).over(before) == "open") | (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    marked = marked.withColumn("inside", F.coalesce(inside, F.lit(False)))
    kept = F.when(F.col("inside"), F.when(F.col("mark") == "closed", F.regexp_extract("plain", r"\*/(.*)$", 1)).otherwise("")).when(F.col("mark") == "open", F.regexp_replace("plain", r"/\*.*$", ""))
    kept = kept.when(python & F.col("plain").rlike(r"^\s*[rRbBuU]?(?:\"\"\"|\x27\x27\x27)"), "").otherwise(F.col("plain"))
    return marked.withColumn("text", kept).drop("plain", "quotes", "mark", "inside")


def lines(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """files (repo, path, language, content) -> (repo, path, language, line, text, more, code, annotation): text without
    comments; more, the same with the rest of the statement behind it; code, text with an x for what each string holds;
    annotation, whether the line is part of one. With a number of partitions whole files are dealt to as many, so that what a
    task sorts doesn't grow with the files."""
    split = dealt(files, partitions, "repo", "path").select("repo", "path", "language", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "text")).withColumn("line", F.col("pos") + 1).drop("pos")
    file = Window.partitionBy("repo", "path").orderBy("line")
    rows = without_comments(split)
    rows = rows.withColumn("code", F.regexp_replace("text", _CONTENT, "$1x$1"))
    rows = rows.withColumn("ends", ~F.col("code").rlike(_OPEN_END))
    follows = (~F.lag("ends", 1, True).over(file) | F.col("text").rlike(_GOES_ON)) & ~F.col("text").rlike(r"^\s*@\w")
    rows = rows.withColumn("head", F.when(follows, 0).otherwise(1))
    rows = rows.withColumn("statement", F.sum("head").over(file.rowsBetween(Window.unboundedPreceding, 0)))
    rest = Window.partitionBy("repo", "path", "statement").orderBy("line").rowsBetween(0, Window.unboundedFollowing)
    own = F.rtrim("text")
    more = F.concat(own, F.array_join(F.transform(F.slice(F.collect_list("text").over(rest), 2, 1 << 30), lambda x: F.concat(F.lit(" "), F.trim(x))), ""))
    annotation = F.first("code").over(Window.partitionBy("repo", "path", "statement").orderBy("line")).rlike(r"^\s*@\w")
    return rows.withColumns({"more": more, "annotation": annotation}).select("repo", "path", "language", "line", "text", "more", "code", "annotation")


def imports(rows: DataFrame) -> DataFrame:
    """(repo, path, line, module); a Python line may name several."""
    t, m, lang = F.col("code"), F.col("more"), F.col("language")
    py_from, py, java = r"^\s*from\s+(\.*[\w.]*)\s+import\s", r"^\s*import\s+([\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*)", r"^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;"
    ts = r"""(?:^\s*import\s+(?:[^'"]*\sfrom\s+)?|require\(\s*)["']([^"']+)["']"""
    script = lang.isin("typescript", "javascript")
    several = F.transform(F.split(F.regexp_extract(t, py, 1), r"\s*,\s*"), lambda x: F.substring_index(x, " ", 1))
    module = F.when((lang == "python") & t.rlike(py_from), F.array(F.regexp_extract(t, py_from, 1))).when((lang == "python") & t.rlike(py), several).when((lang == "java") & t.rlike(java), F.array(F.regexp_extract(t, java, 1)))
    module = module.when(script & (t.rlike(r"^\s*import\b") | t.rlike(ts)) & m.rlike(ts), F.array(F.regexp_extract(m, ts, 1)))
    return rows.select("repo", "path", "line", F.explode(module).alias("module"))


def variables(rows: DataFrame) -> DataFrame:
    """(repo, path, name, value): literal and environment values; the last assignment of a file wins."""
    assign = r"""^\s*(?:(?:public|private|protected|static|final|const|let|var|String)\s+)*(\w+)\s*(?::\s*\w+\s*)?=\s*(.+?);?\s*$"""
    right = F.regexp_extract("more", assign, 2)
    literal, env = r"""^(?:[rRuU]{0,2}(?=["']))?["'`]([^"'`$]*)["'`]$""", r"""(?:getenv\(|environ\.get\(|environ\[)\s*["'](\w+)["']|process\.env\.(\w+)"""
    name = F.concat(F.regexp_extract(right, env, 1), F.regexp_extract(right, env, 2))
    value = F.when(right.rlike(literal), F.regexp_extract(right, literal, 1)).when(right.rlike(env), F.concat(F.lit("$ENV:"), name))
    found = rows.select("repo", "path", "line", F.regexp_extract("more", assign, 1).alias("name"), value.alias("value")).where("name <> '' and value is not null")
    return found.groupBy("repo", "path", "name").agg(F.max_by("value", "line").alias("value"))


def routes(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(repo, path, line, method, route, framework): decorators of Python frameworks, Express calls, Spring mappings
    with the prefix of the class above them; heads are the same files' call heads."""
    t, m, lang = F.col("code"), F.col("more"), F.col("language")
    fast, flask = r"^\s*@\w+\.(get|post|put|patch|delete|head|options)\(\s*[\"']([^\"']*)", r"^\s*@\w+\.route\(\s*[\"']([^\"']*)"
    methods = F.regexp_extract_all(F.regexp_extract(m, r"methods\s*=\s*\[([^\]]*)\]", 1), F.lit(r"(\w+)"), 1)
    python = rows.where((lang == "python") & t.rlike(r"^\s*@\w+\.\w+\(") & m.rlike(fast)).select("repo", "path", "line", F.upper(F.regexp_extract(m, fast, 1)).alias("method"), F.regexp_extract(m, fast, 2).alias("route"), F.lit("fastapi").alias("framework"))
    flasks = rows.where((lang == "python") & t.rlike(r"^\s*@\w+\.route\(") & m.rlike(flask)).select("repo", "path", "line", F.explode(F.when(F.size(methods) > 0, F.transform(methods, F.upper)).otherwise(F.array(F.lit("GET")))).alias("method"), F.regexp_extract(m, flask, 1), F.lit("flask"))
    mapping = r"@(Get|Post|Put|Delete|Patch|Request)Mapping\b"
    value = F.regexp_extract(m, r"Mapping\s*\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*\"([^\"]*)\"", 1)
    java = rows.where(lang == "java").withColumns({"mapping": F.regexp_extract(m, mapping, 1), "value": value, "is_class": t.rlike(r"\b(?:class|interface)\s+\w+"), "controller": t.rlike(r"@(?:Rest)?Controller\b")})
    after, before = Window.partitionBy("repo", "path").orderBy("line").rowsBetween(1, Window.unboundedFollowing), Window.partitionBy("repo", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    java = java.withColumns({"next_class": F.min(F.when(F.col("is_class"), F.col("line"))).over(after), "next_method": F.min(F.when(t.rlike(r"\)\s*(?:throws [\w, .]+)?\{"), F.col("line"))).over(after), "in_controller": F.max("controller").over(before)})
    on_class = (F.col("mapping") == "Request") & (F.col("next_class") <= F.coalesce("next_method", F.lit(1 << 30)))
    prefixed = java.withColumn("prefix", F.last(F.when(on_class, F.col("value")), ignorenulls=True).over(before))
    own = prefixed.where((F.col("mapping") != "") & ~F.coalesce(on_class, F.lit(False)) & F.col("in_controller"))
    named = F.regexp_extract(m, r"RequestMethod\.(\w+)", 1)
    spring_verb = F.when(F.col("mapping") != "Request", F.upper("mapping")).when(named != "", named).otherwise("ANY")
    spring = own.select("repo", "path", "line", spring_verb, P.join_prefix(F.col("prefix"), F.col("value")), F.lit("spring"))
    return python.union(flasks).union(express_routes(heads)).union(spring).union(nest_routes(rows)).union(jaxrs_routes(rows))


def nest_routes(rows: DataFrame) -> DataFrame:
    """Nest: @Get('x') and its like, below the @Controller('p') of the class."""
    t, m = F.col("code"), F.col("more")
    before = Window.partitionBy("repo", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    prefix = F.last(F.when(t.rlike(r"^\s*@Controller\("), F.regexp_extract(m, r"@Controller\(\s*[\"'`]?([^\"'`)]*)", 1)), ignorenulls=True).over(before)
    own = rows.where(F.col("language").isin("typescript", "javascript")).withColumn("prefix", prefix)
    pattern = r"^\s*@(Get|Post|Put|Patch|Delete|Head|Options|All)\(\s*[\"'`]?([^\"'`)]*)"
    verb = F.upper(F.regexp_extract(m, pattern, 1))
    full = P.join_prefix(F.concat(F.lit("/"), F.ltrim("prefix", F.lit("/"))), F.regexp_extract(m, pattern, 2))
    return own.where(t.rlike(pattern) & F.col("prefix").isNotNull()).select("repo", "path", "line", F.when(verb == "ALL", "ANY").otherwise(verb).alias("method"), full.alias("route"), F.lit("nestjs").alias("framework"))


def jaxrs_routes(rows: DataFrame) -> DataFrame:
    """JAX-RS: a verb's annotation and, next to it, @Path, below the class's @Path."""
    t, m = F.col("code"), F.col("more")
    file = Window.partitionBy("repo", "path").orderBy("line")
    before = file.rowsBetween(Window.unboundedPreceding, 0)
    path = F.regexp_extract(m, r"@Path\(\s*\"([^\"]*)\"", 1)
    seen = rows.where(F.col("language") == "java").withColumns({"value": F.when(t.rlike(r"@Path\("), path), "is_class": t.rlike(r"\b(?:class|interface)\s+\w+"), "is_verb": t.rlike(r"^\s*@(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b"), "ends": t.rlike(r"\)\s*(?:throws [\w, .]+)?\{")})
    block = F.sum(F.when(F.lag("ends", 1, False).over(file) | F.lag("is_class", 1, False).over(file), 1).otherwise(0)).over(before)
    seen = seen.withColumn("block", block)
    first_class = F.min(F.when(F.col("is_class"), F.col("block"))).over(Window.partitionBy("repo", "path"))
    seen = seen.withColumn("class_block", first_class)
    base = F.max(F.when(F.col("block") == F.col("class_block"), F.col("value"))).over(Window.partitionBy("repo", "path"))
    sub = F.max("value").over(Window.partitionBy("repo", "path", "block"))
    got = seen.withColumns({"base": base, "sub": sub}).where("is_verb and base is not null")
    return got.select("repo", "path", "line", F.regexp_extract(m, r"@(\w+)", 1).alias("method"), P.join_prefix(F.concat(F.lit("/"), F.ltrim("base", F.lit("/"))), F.coalesce("sub", F.lit(""))).alias("route"), F.lit("jaxrs").alias("framework"))


def symbols(rows: DataFrame) -> DataFrame:
    """(repo, file, language, kind, name, qualified_name, signature, start_line, end_line, ord).

    Java's annotations belong to what they stand on. A Python block ends before the next line that is no deeper than its head; elsewhere it ends where the
    running count of braces comes back to what it was before the head. Each line tells which depths it closes, and a
    block ends at the first such line behind it: one window over heads and closing lines, no join with all lines."""
    t, m, lang = F.col("code"), F.col("more"), F.col("language")
    script_lang = lang.isin("typescript", "javascript")
    py = r"^(\s*)(?:async\s+)?(def|class)\s+(\w+)"
    java, script = r"\b(class|interface|enum)\s+(\w+)", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(\w+)|^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\(?[^=]*=>"
    method = r"^\s+(?:[\w<>\[\],.@?]+\s+)+(\w+)\s*\([^;{]*\)\s*(?:throws [\w, .]+)?\{"
    member = r"^\s+(?:(?:public|private|protected|static|async|readonly)\s+)*\*?(\w+)\s*\([^;{]*\)\s*(?::\s*[\w<>\[\]|. ,]+)?\{"
    word = r"^\s*(?:return|else|new|throw|if|for|while|switch|catch|function|await)\b"
    indent = F.length(F.regexp_extract(t, r"^(\s*)", 1))
    opened = F.length(F.regexp_replace(t, r"[^{]", "")).cast("long")
    braces = opened - F.length(F.regexp_replace(t, r"[^}]", ""))
    file = Window.partitionBy("repo", "path").orderBy("line")
    upto = file.rowsBetween(Window.unboundedPreceding, 0)
    full = rows.where("trim(text) <> ''").withColumns({"indent": indent.cast("long"), "opened": opened, "after": F.sum(braces).over(upto)}).withColumn("before", F.col("after") - braces)
    script_name = F.concat(F.regexp_extract(m, script, 1), F.regexp_extract(m, script, 2))
    pair = lambda kind, name: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), name.alias("name"))
    class_kind = F.when(F.regexp_extract(t, java, 1) == "interface", "interface").otherwise("class")
    head = (
        F.when((lang == "python") & t.rlike(py), pair(F.when(F.regexp_extract(t, py, 2) == "class", "class").when(F.col("indent") > 0, "method").otherwise("function"), F.regexp_extract(t, py, 3)))
        .when((lang != "python") & t.rlike(java), pair(class_kind, F.regexp_extract(t, java, 2)))
        .when(script_lang & t.rlike(r"\bfunction\b|\bconst\b") & m.rlike(script), pair("function", script_name))
        .when((lang == "java") & t.rlike(r"^\s+[\w<@].*\(") & m.rlike(method) & ~t.rlike(word), pair("method", F.regexp_extract(m, method, 1)))
        .when(script_lang & t.rlike(r"^\s+[\w*].*\(") & m.rlike(member) & ~t.rlike(word), pair("method", F.regexp_extract(m, member, 1)))
    )
    python = lang == "python"
    last_indent = F.lag("indent").over(file)
    # the depths that a line closes: Python's from its indent up to the one before it, others' from the count after it
    closes = F.when(python, F.when(last_indent >= F.col("indent"), F.sequence("indent", last_indent))).when(F.col("after") < F.col("before"), F.sequence("after", F.col("before") - 1))
    noted = F.lag("annotation", 1, False).over(file) & (lang == "java")
    full = full.withColumn("fresh_note", F.col("annotation") & ~F.lag("annotation", 1, False).over(file))
    full = full.withColumn("begins", F.when(noted, F.last(F.when(F.col("fresh_note"), F.col("line")), ignorenulls=True).over(upto)).otherwise(F.col("line")))
    marked = full.withColumns({"head": head, "closes": closes, "depth": F.when(python, F.col("indent")).otherwise(F.col("before")), "last": F.max("line").over(Window.partitionBy("repo", "path"))})
    # a line that itself closes what it opens ends there
    own_end = F.when(~python & (F.col("opened") > 0) & (F.col("after") <= F.col("before")), F.col("line"))
    heads = marked.where("head is not null").select("repo", "path", "language", "line", "depth", "last", F.col("head.kind").alias("kind"), F.col("head.name").alias("name"), F.substr(F.trim(F.regexp_replace(m, r"\s*[{:]\s*$|\s*\{.*$", "")), F.lit(1), F.lit(120)).alias("signature"), own_end.alias("own_end"), "begins", F.lit(None).cast("int").alias("closing"))
    ends = marked.select("repo", "path", "language", "line", F.explode("closes").alias("depth"), "last", *[F.lit(None).cast("string").alias(c) for c in ("kind", "name", "signature")], F.lit(None).cast("int").alias("own_end"), F.col("line").alias("begins"), F.col("line").alias("closing"))
    later = Window.partitionBy("repo", "path", "depth").orderBy("line").rangeBetween(1, Window.unboundedFollowing)
    spans = heads.unionByName(ends).withColumn("closing", F.min("closing").over(later)).where("kind is not null")
    end = F.when(F.col("language") == "python", F.coalesce(F.col("closing") - 1, "last")).otherwise(F.coalesce("own_end", "closing", "last"))
    spans = spans.select("repo", F.col("path").alias("file"), "language", "kind", "name", "signature", F.col("begins").alias("start_line"), end.alias("end_line"))
    outer = spans.where("kind in ('class', 'interface')").select("repo", "file", F.col("name").alias("owner"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    owned = spans.join(outer, ["repo", "file"], "left").withColumn("within", F.expr("s < start_line and e >= end_line"))
    parent = F.max_by(F.when(F.col("within"), F.col("owner")), F.when(F.col("within"), F.col("s")))
    out = owned.groupBy("repo", "file", "language", "kind", "name", "signature", "start_line", "end_line").agg(parent.alias("parent"))
    return out.select("repo", "file", "language", "kind", "name", F.concat_ws(".", "parent", "name").alias("qualified_name"), "signature", "start_line", "end_line", F.col("start_line").cast("long").alias("ord"))


def call_sites(rows: DataFrame, defined: DataFrame) -> DataFrame:
    """(repo, file, caller, callee_name, line): every name( on a line, within the innermost symbol around it."""
    from meshlens.operators.fanout import enclosing

    sites = rows.select("repo", F.col("path").alias("file"), "line", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"(?<!def )(?<!function )(?<!@)\b(\w+)\("), 1))).alias("callee_name")).withColumn("id", F.xxhash64("repo", "file", "line"))
    around = enclosing(sites.select("id", "repo", "file", "line").distinct(), defined)
    return sites.join(around, "id", "left").select("repo", "file", F.coalesce("qualified_name", F.lit("<module>")).alias("caller"), "callee_name", "line").where("substring_index(caller, '.', -1) <> callee_name or caller = '<module>'")
