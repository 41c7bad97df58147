"""Source trees as tables: a Python data source, and the rules of what counts as Columns."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

# Languages by ending, and folders whose content doesn't count.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "java": "java", "ts": "typescript", "tsx": "typescript", "go": "go"}
EXCLUDED = ("node_modules", "vendor", ".git", "__pycache__", "build", "dist", "target", ".venv", "venv")
CONFIG_NAME = r"^(?:application[^/]*\.(?:properties|ya?ml)|bootstrap[^/]*\.ya?ml|\.env(?:\..*)?)\z"


#: Files whose text is read: sources, configurations, and what declares a repository's names or tests.
WANTED = re.compile(r"\.(?:py|jsx?|java|tsx?|go|ya?ml|properties|json|toml|mod|xml|gradle|ini)$|^\.env(?:\..*)?$|^\.gitignore$|^config$")


class _Piece(InputPartition):
    """Some files of a repository; without any, its folders couldn't be listed and failed says why."""

    def __init__(self, name: str, root: str, files: list[str], failed: list[tuple[str, str]]):
        super().__init__(None)
        self.name, self.root, self.files, self.failed = name, root, files, failed


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repos = [tuple(x.split("=", 1)) for x in options["repos"].split("\n") if x]
        self.bytes, self.most = int(options.get("piecebytes", 32 << 20)), int(options.get("piecefiles", 2000))
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list) -> Iterable:
        """Equalities of repo and path choose what is listed; whatever else is asked Spark does itself."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("repo",):
                self.repos = [r for r in self.repos if r[0] in values]
            elif values is not None and f.attribute == ("path",):
                self.paths = values if self.paths is None else self.paths & values
            else:
                yield f

    def _listed(self, root: str, failed: list[tuple[str, str]]) -> Iterator[tuple[str, int]]:
        """(relative path, bytes) of a repository's files, excluded folders never opened; of .git only the file that names the remote."""
        folders = [""]
        while folders:
            folder = folders.pop()
            try:
                with os.scandir(os.path.join(root, folder)) as entries:
                    found = sorted(entries, key=lambda e: e.name)
            except OSError as e:
                failed.append((folder, e.strerror))
                continue
            for entry in found:
                path = os.path.join(folder, entry.name)
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in EXCLUDED:
                        folders.append(path)
                    elif path == ".git" and os.path.exists(os.path.join(root, ".git/config")):
                        yield ".git/config", 0
                elif not entry.is_dir():
                    try:
                        yield path, entry.stat().st_size
                    except OSError:
                        yield path, 0  # reading it will tell why

    def partitions(self) -> list[InputPartition]:
        """The driver lists names and sizes; a task reads files of some 32 MB or 2000 of them, so that a large repository is many tasks."""
        out = []
        for name, root in self.repos:
            files, size, failed = [], 0, []
            for path, n in self._listed(root, failed):
                if self.paths is not None and path not in self.paths:
                    continue
                if files and (size + n > self.bytes or len(files) >= self.most):
                    out.append(_Piece(name, root, files, []))
                    files, size = [], 0
                files.append(path)
                size += n
            if files or failed:
                out.append(_Piece(name, root, files, failed))
        return out or [_Piece("", "", [], [])]

    def read(self, piece: _Piece) -> Iterator[tuple]:
        for file in piece.files:
            path = os.path.join(piece.root, file)
            text, status = None, None
            if WANTED.search(os.path.basename(file)):
                try:
                    with open(path, encoding="utf-8", errors="replace") as f:
                        text = f.read()
                except OSError as e:
                    status = f"unreadable: {e.strerror}"
            yield piece.name, file, os.path.abspath(path), text, status
        for folder, why in piece.failed:
            yield piece.name, folder or ".", os.path.abspath(os.path.join(piece.root, folder)), None, f"unreadable: {why}"


class RepoFiles(DataSource):
    """Files of repositories, dot files too: (repo, path, full_path, content, status). Excluded folders below a repository are
    never opened, and filters of repo and path choose what is listed and read.

    Options: repos, lines of name=folder, which the driver and the executors must see; piecebytes and piecefiles, how much a
    task reads at most (a larger file is read whole). The content is that of files which can matter, whatever their size; of
    others, and of what can't be read, it is null, and status says why."""

    @classmethod
    def name(cls) -> str:
        return "repofiles"

    def schema(self) -> str:
        return "repo string, path string, full_path string, content string, status string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_repos(spark: SparkSession, repos: dict[str, str], **options: int) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepoFiles)
    return spark.read.format("repofiles").options(**options).option("repos", "\n".join(f"{k}={v}" for k, v in repos.items())).load()


def language(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return kinds[F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))]


def excluded(full_path: Column) -> Column:
    """Whether any part of the absolute path is an excluded folder."""
    return F.arrays_overlap(F.split(full_path, "/"), F.array(*[F.lit(x) for x in EXCLUDED]))


def ignore_rules(files: DataFrame) -> DataFrame:
    """(repo, n, pattern, again) of the repositories' root .gitignore files: the n-th line as a regular expression over
    relative paths; again where the line takes its files back in."""
    lines = files.where(F.col("path") == ".gitignore").select("repo", F.posexplode(F.split("content", r"\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("again", F.col("line").startswith("!"))
    lines = lines.withColumn("glob", F.regexp_replace("line", "^!", "")).withColumn("glob", F.regexp_replace("glob", r"^\\(?=[!#])", ""))
    lines = lines.withColumns({"folder": F.col("glob").endswith("/"), "anchored": F.rtrim("glob", F.lit("/")).contains("/")})
    bare = F.regexp_replace(F.trim("glob", F.lit("/")), r"([.^$+{}()|\\])", r"\\$1")
    for old, new in (("**/", "\x01"), ("**", "\x02"), ("*", "[^/]*"), ("?", "[^/]"), ("\x01", "(?:.*/)?"), ("\x02", ".*")):
        bare = F.replace(bare, F.lit(old), F.lit(new))
    pattern = F.concat(F.when(F.col("anchored"), "^").otherwise("(?:^|/)"), bare, F.when(F.col("folder"), "/").otherwise("(?:/|$)"))
    return lines.select("repo", "n", pattern.alias("pattern"), "again")


def not_ignored(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows (repo, path, ...) that no root .gitignore leaves out; of the lines that fit a path the last one decides."""
    fits = rows.select("repo", "path").join(ignore_rules(files), "repo").where(F.expr("path rlike pattern"))
    gone = fits.groupBy("repo", "path").agg(F.max_by("again", "n").alias("again")).where("not again")
    return rows.join(gone, ["repo", "path"], "left_anti")


def sources(files: DataFrame) -> DataFrame:
    """The files that count, with their language."""
    return files.withColumn("language", language(F.col("path"))).where(F.col("language").isNotNull() & F.col("content").isNotNull() & ~excluded(F.col("full_path")))


def configs(files: DataFrame) -> DataFrame:
    return files.where(F.regexp_extract("path", r"([^/]*)\z", 1).rlike(CONFIG_NAME) & ~excluded(F.col("full_path")))


def test_command(files: DataFrame) -> DataFrame:
    """(repo, command): how a repository's tests run, by the first build file of the list that it has."""
    rules = [("pytest.ini", "pytest"), ("pyproject.toml", "pytest"), ("package.json", "npm test"), ("pom.xml", "mvn test"), ("build.gradle", "gradle test"), ("go.mod", "go test ./...")]
    rank = F.lit(None).cast("int")
    for i, (name, _) in reversed(list(enumerate(rules))):
        rank = F.when(F.col("path") == name, i).otherwise(rank)
    best = files.groupBy("repo").agg(F.min(rank).alias("i"))
    return best.where("i is not null").select("repo", F.array(*[F.lit(c) for _, c in rules])[F.col("i")].alias("command"))
