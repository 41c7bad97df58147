"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to differ from all of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Intermediate tables in the folder that driver and executors share.

    The folder comes from ``spark.checkpoint.dir``. Only a local session may do without it:
    a temporary folder is then made and set. Elsewhere executors wouldn't share that folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="meshlens-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, df: DataFrame) -> DataFrame:
        """Write df, and read it back: later failures restart from the written table."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._meshlens_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables made by cut() that nothing will read again."""
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._meshlens_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, scratch: Scratch, u: str = "u", v: str = "v", rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the smallest node reachable.

    With a number of rounds it may stop early: root is then a smaller node of the same component, if a round found
    one, and nodes that it found none for aren't in the result.

    Alternating large-star and small-star rounds: each round is two aggregations and two joins,
    the table of edges never grows beyond its first size, and the number of rounds grows with the
    logarithm of the longest chain. Nodes without a link aren't in the result.
    """
    e = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a <> b").distinct()
    e = scratch.cut(e)
    last = None
    while True:
        both = e.select(F.col("a").alias("n"), F.col("b").alias("m")).union(e.select(F.col("b").alias("n"), F.col("a").alias("m")))
        least = scratch.cut(both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("root")))  # a table of its own, so that a hot node's side of the join can be split
        large = scratch.cut(both.join(least, "n").where("m > n").select(F.col("m").alias("a"), F.col("root").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("root"))
        small = (
            large.join(low, "a").where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
            .union(low.select("a", F.col("root").alias("b"))).where("a <> b").distinct()
        )
        new = scratch.cut(small)
        seen = None if rounds == 1 else new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(e, least, large)
        e = new
        if rounds == 1:
            return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        rounds = rounds and rounds - 1
        if (seen.n, seen.h) == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
        last = (seen.n, seen.h)


def whole_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[list[pd.DataFrame]]:
    """The groups of consecutive equal keys, whole even where a batch ends within one."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        k = frame[key].to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        bounds = [0, *cuts.tolist()]
        yield [frame.iloc[a:b] for a, b in zip(bounds, bounds[1:])]
        held = frame.iloc[bounds[-1] :]
    if held is not None and len(held):
        yield [held]


def by_group(df: DataFrame, key: str, one: Callable, schema: str) -> DataFrame:
    """one(group) -> frame or None for each group of key; groups are of a bounded size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in whole_groups(frames, key):
            out = [r for r in map(one, groups) if r is not None and len(r)]
            if out:
                yield pd.concat(out, ignore_index=True)

    return df.repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)
