"""Sharding by sampled splitters: shards of near equal size, equal groups side by side.

Records are ordered by the hash of their group, then by a hash of their key. Samples drawn in proportion to size give
quantile boundaries, by which records are partitioned into ranges, many to a shard; ranges that turn out too full get
further boundaries from samples of their own. Running sums over each range, behind the sums of the ranges before it, are
the exact place of every record, and the shards cut that line at equal distances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlens.llm.common import Scratch

SERIAL_BITS = 16


def keyed(docs: DataFrame, key: str, size: Column, group: Column, row: Column) -> DataFrame:
    """(row, size, k, tie, serial): the order is by k, the group's hash, then by tie, the key's hash with a part of the
    serial number in its last bits, so that rows repeated any number of times can still be told apart."""
    rows = docs.select(row.alias("row"), size.cast("long").alias("size"), F.xxhash64(group).alias("k"), F.xxhash64(F.col(key)).alias("tie"), F.monotonically_increasing_id().alias("serial"))
    low = F.xxhash64("serial").bitwiseAND(F.lit((1 << SERIAL_BITS) - 1))
    return rows.withColumn("tie", F.shiftleft(F.shiftright("tie", SERIAL_BITS), SERIAL_BITS).bitwiseOR(low))


def places(splits: np.ndarray, k: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """How many of the sorted splits (k, tie) are not above each (k, tie)."""
    low, high = np.searchsorted(splits[:, 0], k, "left"), np.searchsorted(splits[:, 0], k, "right")
    shared = low < high
    for at in np.unique(low[shared]):  # where a split has the same k, its tie decides
        own = np.flatnonzero(shared & (low == at))
        low[own] = at + np.searchsorted(splits[at : high[own[0]], 1], tie[own], "right")
        shared[own] = False
    return low


def ranged(rows: DataFrame, splits: np.ndarray) -> DataFrame:
    """rows with range, their place among the splits."""

    @F.pandas_udf("int")
    def place(k: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(places(splits, k.to_numpy(), tie.to_numpy()), dtype=np.int32)

    return rows.withColumn("range", place("k", "tie"))


def samples(rows: DataFrame, expected: Column, seed: int) -> np.ndarray:
    """Sorted (k, tie), each row's about as often as expected says; drawn by a hash, so that every run draws the same."""
    u = F.pmod(F.xxhash64(F.lit(seed), "k", "tie", "serial"), F.lit(1 << 30)) / float(1 << 30)
    got = rows.select("k", "tie", F.floor(expected + u).alias("n")).where("n > 0").groupBy("k", "tie").agg(F.sum("n").alias("n")).toPandas().sort_values(["k", "tie"])
    return np.repeat(got[["k", "tie"]].to_numpy(np.int64), got["n"].to_numpy(np.int64), axis=0)


def quantiles(drawn: np.ndarray, pieces: int) -> np.ndarray:
    """pieces - 1 boundaries at equal distances among sorted samples."""
    if pieces < 2 or not len(drawn):
        return np.zeros((0, 2), np.int64)
    return drawn[np.arange(1, pieces) * len(drawn) // pieces]


def splitters(rows: DataFrame, ranges: int, oversample: int, seed: int) -> tuple[np.ndarray, pd.DataFrame]:
    """The sorted boundaries of about that many ranges, and each range's bytes and n. No range has more than twice its
    equal share of bytes or of rows, unless it is one row or rows that nothing tells apart. The driver sees about
    oversample samples a range, and one line of each range."""
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    splits = np.zeros((0, 2), np.int64)
    if total.n:
        splits = np.unique(quantiles(samples(rows, F.col("size") * (ranges * oversample / total.bytes), seed), ranges), axis=0)
    bytes_most, n_most = 2 * (total.bytes or 0) / ranges, max(1, 2 * total.n / ranges)
    while True:
        placed = ranged(rows, splits)
        full = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).toPandas().sort_values("range").reset_index(drop=True)
        load = np.maximum(full["bytes"] / max(bytes_most, 1), full["n"] / n_most)
        over = full.assign(load=load)[(load > 1) & (full["n"] > 1)]
        if not len(over):
            return splits, full
        share = F.greatest(F.col("size") / bytes_most, F.lit(1 / n_most))
        seed += 1
        drawn = samples(placed.where(F.col("range").isin(over["range"].tolist())), share * oversample, seed)
        at = places(splits, drawn[:, 0], drawn[:, 1])
        finer = [quantiles(drawn[at == r], int(np.ceil(2 * x))) for r, x in zip(over["range"], over["load"])]
        new = np.unique(np.vstack([splits, *finer]), axis=0)
        if len(new) == len(splits):
            return splits, full
        splits = new


def cuts_of(placed: DataFrame, total: int, shards: int, slack: float) -> list[int]:
    """Where the shards begin on the line of sizes: at equal distances, moved to the nearest edge of the group there if
    that is within slack of a shard's size, else to the nearest edge of the record there."""
    j = F.greatest(F.lit(1), F.ceil(F.col("begin") * shards / F.lit(total)))
    hit = placed.where((j < shards) & (j * total < (F.col("begin") + F.col("size")) * shards)).select("k", "begin", "size").collect()
    spans = placed.where(F.col("k").isin([r.k for r in hit])).groupBy("k").agg(F.min("begin").alias("a"), F.max(F.col("begin") + F.col("size")).alias("b")).collect()
    span, hit = {r.k: (r.a, r.b) for r in spans}, sorted(hit, key=lambda r: r.begin)
    out = [0]
    for i in range(1, shards):
        goal = total * i / shards
        row = next(r for r in hit if r.begin <= goal < r.begin + r.size)
        edge = min(span[row.k], key=lambda x: abs(x - goal))
        if abs(edge - goal) > slack * total / shards:
            edge = min((row.begin, row.begin + row.size), key=lambda x: abs(x - goal))
        out.append(max(edge, out[-1]))
    return out[1:]


def shard(docs: DataFrame, size: Column, group: Column, key: str = "doc_id", row: Column | None = None, shards: int = 24, range_rows: int = 200_000, max_ranges: int = 16_384, oversample: int = 16, slack: float = 0.005, seed: int = 23) -> DataFrame:
    """(row, size, shard, slot, range) for each row of docs: shard from 0, slot gapless from 0 within it.

    size is a column of docs, at least 1; row, a struct of what is to be kept of docs, by default all its columns. Shards' sums of sizes
    differ from each other by the slack and half a record at each end. Rows of an equal group stand side by side; a group
    is cut where keeping it whole would cost more than the slack. Null keys and groups are values like any other, repeated
    rows are each placed, an empty table gives an empty result, and where there are fewer rows than shards some shards are
    empty. There are a few ranges a shard at least, and more for larger tables, up to max_ranges: beyond it ranges grow.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.cut(keyed(docs, key, size, group, F.struct("*") if row is None else row))
    ranges = min(max_ranges, max(4 * shards, -(-rows.count() // range_rows)))
    splits, full = splitters(rows, ranges, oversample, seed)
    before = full[["bytes", "n"]].cumsum() - full[["bytes", "n"]]
    starts = docs.sparkSession.createDataFrame(list(zip(full["range"].tolist(), before["bytes"].tolist(), before["n"].tolist())), "range int, bytes_before long, n_before long")
    upto = Window.partitionBy("range").orderBy("k", "tie", "serial").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged(rows, splits).join(F.broadcast(starts), "range").select(  # a short row for each of a bounded number of ranges
        "row", "size", "range", "k", (F.col("bytes_before") + F.sum("size").over(upto) - F.col("size")).alias("begin"), (F.col("n_before") + F.count("*").over(upto) - 1).alias("nth"),
    )
    placed = scratch.cut(placed)
    total = int(full["bytes"].sum())
    cuts = cuts_of(placed, total, shards, slack) if total else []
    placed = placed.withColumn("shard", F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("begin"))) if cuts else F.lit(0))
    counts = {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}
    first = np.cumsum([0] + [counts.get(i, 0) for i in range(shards - 1)]).tolist()
    slot = F.col("nth") - F.array(*[F.lit(n).cast("long") for n in first])[F.col("shard")]
    return placed.select("row", "size", "shard", slot.alias("slot"), "range")


def write_shards(sharded: DataFrame, folder: str) -> None:
    """A folder for each shard, its files' records in the order of slot; a shard is written by as many tasks as it has ranges."""
    sharded.repartition("range").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
