"""The engine's face: a scan of repositories into stored tables, and the questions asked of them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.functions import identity as I
from meshlens.functions import paths as P
from meshlens.functions.predicates import is_value_holder, score_target
from meshlens.operators import documents, exports, fanout, lookups, memory, reconcile, resolve, skills, surfaces, traversal
from meshlens.operators.store import Store, remove_aliases, replace_aliases, upsert
from meshlens.sources import calls, code, configs, files, organisations
from meshlens.sources.heads import heads as call_heads
from meshlens.sources.identities import base_paths, identities


#: Files that configure a repository or declare its names.
CONFIGS = r"(?:\.ya?ml|\.properties)\z|(?:^|/)\.env(?:\.[^/]*)?\z|^(?:package\.json|pyproject\.toml|go\.mod|openapi\.json|swagger\.json|\.git/config)\z"


class DependencyEngine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)

    def scan(self, repos: dict[str, str]) -> None:
        """Scan repositories (name -> folder), bind their references to each other and to those scanned before, match calls and
        routes, follow endpoints to the calls they reach, and store all tables. What a root .gitignore leaves out doesn't count;
        files that can't be read are in the table unreadable.

        Only the scanned repositories' rows are replaced. Dependencies that they had before and that weren't found again stay,
        as do what other repositories were bound to; relink() binds all anew, from the stored signals."""
        store, names = self.store, sorted(repos)
        named = self.spark.createDataFrame(list(repos.items()), "name string, path string")
        store.replace("repos", named, names, "name")
        read = files.read_repos(self.spark, repos)
        store.replace("files", read.withColumn("content", F.when(F.col("path").rlike(CONFIGS) | F.col("path").isin(".gitignore") | files.language(F.col("path")).isNotNull(), F.col("content"))), names)
        read = self._of("files", names)  # the trees are read once
        store.replace("unreadable", read.where("status is not null").select("repo", "path", "status"), names)
        sources = files.not_ignored(files.sources(read), read)
        store.replace("lines", code.lines(sources), names)
        store.replace("heads", call_heads(sources), names)
        rows, heads = self._of("lines", names), self._of("heads", names)
        store.replace("symbols", code.symbols(rows), names)
        store.replace("calls", code.call_sites(rows, self._of("symbols", names)), names)
        declared = read.where(F.col("path").rlike(CONFIGS) & F.col("content").isNotNull())
        routes = code.routes(rows, heads).select("repo", "method", F.col("route").alias("path"), "framework", F.col("path").alias("file"), "line")
        store.replace("routes", surfaces.fold_base_paths(routes, base_paths(declared)).select(*routes.columns), names)
        new = identities(named, declared).select("repo", "alias", "raw", "source", "confidence", F.xxhash64("raw").alias("ord"))
        store.replace("aliases", replace_aliases(self._of("aliases", names), new, named) if store.exists("aliases") else new, names)
        store.replace("signals", self._signals(rows, heads, self._of("symbols", names), declared), names, "from_repo")
        self._link(names)

    def relink(self) -> None:
        """Bind, match and follow all repositories' references anew, from the stored signals: after a scan of some, others may
        find what they name. Dependencies that aren't found again go."""
        self.store.clear("dependencies")
        self._link([r.name for r in self.table("repos").select("name").distinct().collect()])

    def _of(self, name: str, repos: list[str], column: str = "repo") -> DataFrame:
        rows = self.store.read(name)
        return rows.where(F.col(column).isin(repos)) if len(repos) <= 100 else rows.join(self.spark.createDataFrame([(r,) for r in repos], f"{column} string"), column, "left_semi")

    def _link(self, names: list[str]) -> None:
        store = self.store
        signals, aliases = self._of("signals", names, "from_repo"), store.read("aliases")
        deps = reconcile.reconcile(resolve.without_import_only(resolve.resolve(signals)), aliases)
        if store.exists("dependencies"):
            deps = upsert(self._of("dependencies", names, "from_repo"), deps, ["from_repo", "to_repo"])
        store.replace("dependencies", deps, names, "from_repo")
        refs = signals.select(F.col("to_repo").alias("ref"), F.col("from_repo").alias("exclude")).distinct()
        bound = reconcile.bind(refs, aliases).select(F.col("ref").alias("to_repo"), F.col("exclude").alias("from_repo"), F.coalesce("match.repo", "ref").alias("repo"))
        asked = signals.where("target_path is not null").join(bound, ["from_repo", "to_repo"]).select(F.xxhash64("from_repo", "repo", "file", "line", "target_path").alias("id"), "from_repo", "repo", "method", F.col("target_path").alias("path"), "file", "line")
        store.replace("surfaces", surfaces.match_surfaces(asked, store.read("routes").select("repo", "method", "path")), names, "from_repo")
        store.replace("route_calls", self._fanout(names), names)

    def _signals(self, rows: DataFrame, heads: DataFrame, symbols: DataFrame, declared: DataFrame) -> DataFrame:
        """Everything that names another service, from code and from configuration, ordered by file and line."""
        nothing = F.lit(None).cast("string")
        columns = ["repo", "path", "line", "dep_type", "confidence", "tier", "to_repo", "method", "target_path"]

        def of(df: DataFrame, dep_type, confidence, tier, to_repo, method=nothing, target_path=nothing) -> DataFrame:
            given = {"dep_type": dep_type, "confidence": confidence, "tier": tier, "to_repo": to_repo, "method": method, "target_path": target_path}
            return df.withColumns({k: F.lit(v) if isinstance(v, str | float) else v for k, v in given.items()}).select(columns)

        host, path = I.service_from_url(F.col("target")), P.split_host_path(F.col("target"))["path"]
        values = code.variables(rows)
        wrapped = calls.wrapped_axios(heads, values).withColumn("s", score_target(F.col("target")))
        parts = [
            of(calls.http_calls(heads, values), "http", F.col("confidence"), F.col("tier"), host, F.col("method"), F.col("target_path")),
            of(wrapped, "http", F.col("s.confidence"), F.col("s.tier"), I.service_from_url(F.col("s.target")), F.col("method"), P.split_host_path(F.col("s.target"))["path"]),
            of(calls.soap_calls(heads, values), "soap", 1.0, "call-site", host),
            of(calls.messages(heads, code.imports(rows)), F.col("dep_type"), F.when(F.col("dep_type") == "kafka", 1.0).otherwise(0.9), "call-site", F.col("target")),
            of(calls.feign_surfaces(heads, symbols), "feign", 0.95, "call-site", host, F.col("method"), F.col("target_path")),
            of(code.imports(rows).where(~is_value_holder(F.col("module"))), "import", 0.6, "import", I.import_name(F.col("module"))),
            of(configs.targets(files.configs(declared)), "http", 0.85, "config", host, "", path),
        ]
        evidence = F.concat_ws(":", P.basename(F.col("path")), "line")
        return functools.reduce(DataFrame.unionByName, parts).select(F.col("repo").alias("from_repo"), "to_repo", "dep_type", "confidence", evidence.alias("evidence"), "tier", F.struct("path", "line").alias("ord"), "method", "target_path", F.col("path").alias("file"), "line")

    def scan_organisation(self, source: str) -> None:
        """Scan the repositories that a YAML file lists, or all folders of a folder."""
        self.scan(organisations.from_yaml(source) if source.endswith((".yml", ".yaml")) else organisations.from_directory(source))

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def dependencies_of(self, repo: str) -> DataFrame:
        return lookups.dependencies_of(self.table("dependencies"), repo)

    def dependents_of(self, repo: str) -> DataFrame:
        return lookups.dependents_of(self.table("dependencies"), repo)

    def blast_radius(self, repo: str, depth: int = 3) -> DataFrame:
        return traversal.blast_radius(self.table("dependencies"), self.spark.createDataFrame([(repo,)], "origin string"), depth).select("node")

    def impact(self, repo: str, depth: int = 3) -> DataFrame:
        deps = self.table("dependencies")
        return lookups.impact(deps, deps, repo, depth)

    def search_symbols(self, query: str, limit: int = 50, repo: str | None = None) -> DataFrame:
        """By way of the postings if index_symbols made some since the last scan."""
        symbols = self.table("symbols")
        if self.store.exists("postings") and self.store.manifest("postings")["parts"][0]["of"] == self.store.manifest("symbols")["version"]:
            return lookups.search_postings(symbols, self.table("postings"), query, limit, repo)
        return lookups.search_symbols(symbols, query, limit, repo)

    def index_symbols(self) -> None:
        """Postings of all symbols' names, for searches until the next scan."""
        version = self.store.manifest("symbols")["version"]
        self.store.write("postings", lookups.name_postings(self.store.read("symbols", version)), of=version)

    def callers(self, name: str, limit: int = 100, repo: str | None = None) -> DataFrame:
        return lookups.callers(self.table("calls").withColumn("ord", F.lit(0)), name, limit, repo)

    def impact_of_endpoint(self, repo: str, endpoint: str | None = None, depth: int = 3) -> DataFrame:
        """Direct dependents with the endpoints they use; with an endpoint only those that use it, and of the blast radius
        only them."""
        deps = self.table("dependencies")
        return lookups.impact_of_endpoint(deps, deps, self.table("surfaces"), repo, endpoint, depth)

    def impact_of_symbol(self, repo: str, symbol: str) -> DataFrame:
        """Where a name is defined, and the call sites of it in other repositories."""
        return lookups.impact_of_symbol(self.table("symbols"), self.table("calls").withColumn("ord", F.lit(0)), repo, symbol)

    def test_commands(self) -> DataFrame:
        return files.test_command(self.table("files"))

    def _fanout(self, names: list[str] | None = None, max_hops: int = 4) -> DataFrame:
        """Of the named repositories' endpoints, or of all: a fan-out stays within its repository."""
        of = self.table if names is None else lambda name, column="repo": self._of(name, names, column)
        outbound = self.table("surfaces") if names is None else of("surfaces", "from_repo")
        out = outbound.select(F.col("from_repo").alias("repo"), F.col("repo").alias("target"), P.endpoint_key(F.col("method"), F.col("path")).alias("key"), "file", "line")
        return fanout.endpoint_fanout(of("routes"), of("symbols"), of("calls"), out, max_hops)

    def fanout(self, max_hops: int = 4) -> DataFrame:
        """What endpoints fan out to: as the scan stored it, or anew for another number of calls."""
        return self.table("route_calls") if max_hops == 4 and self.store.exists("route_calls") else self._fanout(max_hops=max_hops)

    def route_calls(self, repo: str) -> DataFrame:
        return fanout.route_calls(self.table("route_calls"), repo)

    def remember(self, repo: str, note: str, kind: str = "note", created_at: str = "") -> None:
        old = self.table("memory") if self.store.exists("memory") else self.spark.createDataFrame([], memory.SCHEMA)
        new = self.spark.createDataFrame([(repo, kind, note, created_at)], "repo string, kind string, note string, created_at string")
        self.store.write("memory", memory.remember(old, new, "note"))

    def recall(self, repo: str, kind: str | None = None) -> DataFrame:
        rows = self.table("memory") if self.store.exists("memory") else self.spark.createDataFrame([], memory.SCHEMA)
        return memory.recall(rows, repo, kind)

    def forget(self, note: int) -> None:
        self.store.write("memory", memory.forget(self.table("memory"), self.spark.createDataFrame([(note,)], "id long")))

    def remove_alias(self, repo: str, name: str) -> bool:
        """Drop an alias by its raw value or its normal form; whether there was one."""
        old = self.table("aliases")
        new = remove_aliases(old, self.spark.createDataFrame([(repo, name)], "repo string, name string"))
        gone = new.count() < old.count()
        self.store.write("aliases", new)
        return gone

    def export(self, folder: str, repo: str | None = None) -> None:
        exports.write_export(self.table("dependencies"), folder, repo)

    def write_documents(self, folder: str, scanned_at: str) -> None:
        """Each repository's nested document below dependencies, and what it provides and consumes below interfaces."""
        deps, matched = self.table("dependencies"), self.table("surfaces")
        keyed = matched.withColumn("key", P.endpoint_key(F.col("method"), F.col("path")))
        documents.write_documents(documents.documents(deps, self.table("repos"), scanned_at, keyed), f"{folder}/dependencies")
        documents.write_documents(documents.interfaces_documents(exports.interfaces(self.table("routes"), matched)), f"{folder}/interfaces")

    def write_skills(self, folder: str) -> None:
        notes = self.table("memory") if self.store.exists("memory") else self.spark.createDataFrame([], memory.SCHEMA)
        skills.write_registry(self.table("dependencies"), self.table("repos"), self.table("symbols"), notes, folder)

    def add_alias(self, repo: str, raw: str) -> str:
        """A manual alias, kept by later scans; returns its normal form."""
        row = self.spark.createDataFrame([(repo, raw)], "repo string, raw string").select("repo", I.normalize_identity(F.col("raw")).alias("alias"), "raw", F.lit("manual").alias("source"), F.lit(1.0).alias("confidence"), F.xxhash64("raw").alias("ord"))
        alias = row.first().alias
        if alias:
            self.store.update("aliases", row, ["repo", "alias"])
        return alias
