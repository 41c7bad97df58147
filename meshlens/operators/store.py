"""The stored tables and their updates: an update writes beside what is there, so a lost job never leaves half a table and
no job overwrites what it reads."""

from __future__ import annotations

import functools
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meshlens.functions import identity as I

#: Parts after which a table is written as one again.
MOST_PARTS = 32


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new take the place of old ones with their keys; other old rows stay, stale ones too."""
    return old.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new)


def replace_by_repo(old: DataFrame, new: DataFrame, repos: DataFrame, column: str = "repo") -> DataFrame:
    """All rows of the given repositories (name) are replaced, also where new has none for them."""
    return old.join(repos.select(F.col("name").alias(column)).distinct(), column, "left_anti").unionByName(new)


def replace_aliases(old: DataFrame, new: DataFrame, repos: DataFrame) -> DataFrame:
    """Automatic aliases of the repositories are replaced, manual ones stay unless a new one has their (repo, alias)."""
    scanned = repos.select(F.col("name").alias("repo")).distinct().withColumn("scanned", F.lit(True))
    kept = old.join(scanned, "repo", "left").where("scanned is null or source = 'manual'").drop("scanned")
    return upsert(kept, new, ["repo", "alias"])


def remove_aliases(aliases: DataFrame, gone: DataFrame) -> DataFrame:
    """aliases without those that gone (repo, name) names by their raw value or by its normal form, automatic ones too."""
    named = gone.select(F.col("repo").alias("repo_"), F.col("name").alias("name_"), I.normalize_identity(F.col("name")).alias("alias_"))
    return aliases.join(named, (F.col("repo") == F.col("repo_")) & ((F.col("raw") == F.col("name_")) | (F.col("alias") == F.col("alias_"))), "left_anti")


def with_columns_of(df: DataFrame, schema: str) -> DataFrame:
    """df in a later version's columns: those it lacks are null."""
    wanted = StructType.fromDDL(schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def append_with_ids(old: DataFrame, new: DataFrame, *order: str, id_column: str = "id") -> DataFrame:
    """new gets the ids after old's largest; for the few rows of one writer, such as notes."""
    last = old.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("last")).first()["last"]
    return old.unionByName(new.withColumn(id_column, F.row_number().over(Window.orderBy(*order)) + F.lit(last)).select(old.columns))


class Store:
    """Named tables below one folder of any file system that Spark knows.

    A table is made of parts, folders of Parquet that are never changed, and of numbered manifests. A manifest lists the
    parts that count and, of a part that holds some repositories only, which ones: a row counts if no later part holds its
    repository. So what a scan of three repositories writes is their rows and a manifest, whatever the table's size. A
    manifest is written beside and renamed to its number, which fails if another writer has taken it: then it is made anew
    from that writer's, and neither's rows are lost."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, *names: str):
        return self.hadoop.Path("/".join([self.folder, *names]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        fs, path = self._fs(), self._path(name, "manifests")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")) if fs.exists(path) else []

    def manifest(self, name: str, version: int | None = None) -> dict:
        """version and parts of the table's latest manifest, or of the one named: [{part, seq, repos (null: all), column}]."""
        versions = self._versions(name)
        if not versions:
            return {"version": 0, "parts": []}
        at = self._path(name, "manifests", f"{version or versions[-1]:010d}.json")
        stream = self._fs().open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, name: str, old: dict, parts: list[dict]) -> bool:
        """Whether the manifest after old is this one."""
        fs, version = self._fs(), old["version"] + 1
        new, at = self._path(name, "manifests", f".{uuid.uuid4().hex}"), self._path(name, "manifests", f"{version:010d}.json")
        stream = fs.create(new)
        stream.write(json.dumps({"version": version, "parts": parts}).encode())
        stream.close()
        context = self.hadoop.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(new), context.makeQualified(at), none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass()):
                raise
            fs.delete(new, False)
            return False

    def _put(self, name: str, df: DataFrame, repos: list[str] | None, column: str, **notes) -> None:
        part = uuid.uuid4().hex
        rows = df if repos is None else df.repartition(column).sortWithinPartitions(column)  # so that a filter by repository reads few row groups
        rows.write.parquet(f"{self.folder}/{name}/parts/{part}")
        while True:
            old = self.manifest(name)
            seq = max((p["seq"] for p in old["parts"]), default=0) + 1
            given = set(repos or ())
            kept = [p for p in old["parts"] if repos is not None and not (p["repos"] is not None and set(p["repos"]) <= given)]
            if self._commit(name, old, [*kept, {"part": part, "seq": seq, "repos": repos, "column": column, **notes}]):
                return

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The table's rows, as of a version if one is named."""
        parts = self.manifest(name, version)["parts"]
        frames = []
        for p in parts:
            df = self.spark.read.parquet(f"{self.folder}/{name}/parts/{p['part']}")
            gone = sorted({r for q in parts if q["seq"] > p["seq"] for r in q["repos"] if p["repos"] is None or r in set(p["repos"])})
            if gone and len(gone) <= 100:
                df = df.where(~F.col(parts[-1]["column"]).isin(gone) | F.col(parts[-1]["column"]).isNull())
            elif gone:
                df = df.join(self.spark.createDataFrame([(r,) for r in gone], "gone_ string"), F.col(parts[-1]["column"]) == F.col("gone_"), "left_anti")
            frames.append(df)
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def write(self, name: str, df: DataFrame, **notes) -> None:
        """The whole table anew; notes stand in its manifest."""
        self._put(name, df, None, "repo", **notes)

    def replace(self, name: str, df: DataFrame, repos: list[str], column: str = "repo") -> None:
        """The rows of these repositories anew, also where df has none for them; others' rows aren't read or written."""
        self._put(name, df.where(F.col(column).isin(repos)) if len(repos) <= 100 else df, sorted(set(repos)), column)
        if len(self.manifest(name)["parts"]) > MOST_PARTS:
            self.compact(name)

    def compact(self, name: str) -> None:
        """All parts become one; rows that no longer count go."""
        old = self.manifest(name)
        part = uuid.uuid4().hex
        self.read(name, old["version"]).write.parquet(f"{self.folder}/{name}/parts/{part}")
        self._commit(name, old, [{"part": part, "seq": max(p["seq"] for p in old["parts"]), "repos": None, "column": old["parts"][-1]["column"]}])  # another writer's manifest wins: the next compaction is then its own

    def vacuum(self, name: str, keep: int = 2) -> list[str]:
        """Delete the manifests but for the last ones, and the parts that none of these lists; the parts deleted. Not to be run beside a writer."""
        fs, versions = self._fs(), self._versions(name)
        listed = {p["part"] for v in versions[-keep:] for p in self.manifest(name, v)["parts"]}
        for v in versions[:-keep]:
            fs.delete(self._path(name, "manifests", f"{v:010d}.json"), False)
        gone = [s.getPath().getName() for s in fs.listStatus(self._path(name, "parts")) if s.getPath().getName() not in listed]
        for part in gone:
            fs.delete(self._path(name, "parts", part), True)
        return gone

    def clear(self, name: str) -> None:
        """An empty version; readers of older ones aren't disturbed."""
        self.write(name, self.read(name).limit(0))

    def update(self, name: str, new: DataFrame, keys: list[str]) -> None:
        self.write(name, upsert(self.read(name), new, keys) if self.exists(name) else new)
