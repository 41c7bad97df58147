"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents fall into blocks by a hash within their source. A source's target in words is met by a
sequence of block draws: a permuted pass over its blocks, then another one in another order, until
the target is reached; the last block is cut at a word. The numbers of draws are the exact quotas
that the splitting tree deals out: at each node the quotas of the left half of the output shards
are one multivariate-hypergeometric draw from the node's quotas. A shard takes consecutive, hence
disjoint, stretches of each source's sequence and is shuffled locally by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlens.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Words that each source gives, in the order of sizes (by code point, null last): shares by weight,
    those above cap times their size stop there, and the rest is dealt anew."""
    total, out = share * sum(n for _, n in sizes), [0.0] * len(sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    open_ = [i for i, (_, n) in enumerate(sizes) if n > 0]
    while open_:
        each = total / sum(weight[i] for i in open_)
        over = [i for i in open_ if each * weight[i] > cap * sizes[i][1]]
        if not over:
            for i in open_:
                out[i] = each * weight[i]
            break
        for i in over:
            out[i] = cap * sizes[i][1]
            total -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def shard_quotas(quotas: list[int], shards: int, shard: int, seed: int, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) by source of the draws that a shard gets, by walking down the splitting tree.

    Every shard finds its own path from the seed alone, so no table of all shards is ever built."""
    left = np.zeros(len(quotas), dtype=np.int64)
    have, lo, hi, all_ = np.asarray(quotas, dtype=np.int64), 0, shards, int(sum(quotas))
    at = lambda i: all_ * i // shards
    seen = {} if seen is None else seen
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if (lo, hi) not in seen:
            rng = np.random.default_rng([seed, lo, hi])
            seen[lo, hi] = rng.multivariate_hypergeometric(have, at(mid) - at(lo), method="marginals")
        got = seen[lo, hi]
        if shard < mid:
            have, hi = got, mid
        else:
            left, have, lo = left + got, have - got, mid
    return left, have


def deal(spark: SparkSession, quotas: list[int], shards: int, seed: int) -> DataFrame:
    """(sid, draw, shard) for every draw of every source, made on the executors."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for frame in frames:
            for shard in frame["id"]:
                first, count = shard_quotas(quotas, shards, int(shard), seed, seen)
                sid = np.repeat(np.arange(len(quotas)), count)
                draw = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
                yield pd.DataFrame({"sid": sid.astype(np.int32), "draw": draw.astype(np.int64), "shard": np.int32(shard)})

    return spark.range(shards).mapInPandas(walk, "sid int, draw long, shard int")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17, block_docs: int = 256, max_blocks: int = 65536, shard_draws: int = 8, columns: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: row (struct of the named columns, or of all), size, source_size, target, draws, taken.

    draws is an array of (pass, shard, words); words is below size only where the source's target ends
    within the document. Null texts have size 0 and are never drawn; null keys and sources are
    values like any other (source null is last). Repeated rows are each mixed. An empty table gives an
    empty result. A shard holds about shard_draws blocks. Only one line of statistics per source reaches the driver.

    Sizes are counted once and written without texts; everything is planned over that table. Name the columns that are
    wanted where texts aren't: that table then holds them, and no text is read again or shuffled.
    """
    spark, scratch = docs.sparkSession, scratch or Scratch(docs.sparkSession, "mixing")
    rows = docs.select(
        F.struct(*(["*"] if columns is None else [F.col(f"`{c}`") for c in columns])).alias("row"), F.col(source).cast("string").alias("src"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("h"),
    )
    narrow = scratch.cut(rows.drop("row") if columns is None else rows)
    rows = rows if columns is None else narrow
    stats = sorted(((r.src, int(r.n), int(r.words)) for r in narrow.groupBy("src").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets([(s, w) for s, _, w in stats], weights, share, cap)
    blocks = [min(max_blocks, -(-n // block_docs)) for _, n, _ in stats]
    known = spark.createDataFrame(
        [(i, s, w, float(g), b, int(g + 0.5)) for i, ((s, _, w), g, b) in enumerate(zip(stats, goal, blocks))],
        "sid int, src2 string, source_size long, target double, n_blocks int, goal long",
    )
    if len(stats) <= 10_000:  # a row of some 60 bytes for each source
        known = F.broadcast(known)
    placed = lambda frame: frame.join(known, F.col("src").eqNullSafe(F.col("src2"))).drop("src", "src2").withColumn("block", F.expr("cast(pmod(h, n_blocks) as int)"))

    block = placed(narrow).groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("n_blocks").alias("n_blocks"), F.first("goal").alias("goal"))
    passes = max(1, int(np.ceil(cap)))
    block = block.withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(passes)])))
    order = Window.partitionBy("sid").orderBy("pass", F.xxhash64(F.lit(seed), "pass", "block"), "block")
    block = block.withColumns({
        "draw": (F.row_number().over(order) - 1).cast("long"),
        "start": F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"),
    }).where("start < goal").withColumn("take", F.expr("least(words, goal - start)"))
    block = scratch.cut(block)
    quotas = [0] * len(stats)
    for r in block.groupBy("sid").count().collect():
        quotas[r.sid] = r["count"]
    shards = max(1, -(-sum(quotas) // shard_draws))
    drawn = block.join(deal(spark, quotas, shards, seed), ["sid", "draw"]).groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "take"))).alias("instances"))
    within = Window.partitionBy("sid", "block").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed(rows).withColumn("before", F.sum("size").over(within) - F.col("size")).join(drawn, ["sid", "block"], "left")
    draws = F.expr("filter(transform(coalesce(instances, array()), x -> named_struct('pass', x.pass, 'shard', x.shard, 'words', greatest(0L, least(size, x.take - before)))), x -> x.words > 0)")
    return rows.select("row", "size", "source_size", "target", draws.alias("draws")).withColumn("taken", F.expr("aggregate(draws, 0L, (a, x) -> a + x.words)"))


def materialise(mixed: DataFrame, text: str = "text", seed: int = 17) -> DataFrame:
    """The mix itself: a row of the documents' own columns for each draw, cut draws at their last word
    (the words of a cut text are joined by one space), plus mix_shard and mix_order."""
    columns = mixed.schema["row"].dataType.names
    one = mixed.select("row", "size", F.explode("draws").alias("d"))
    cut = F.when(F.col("d.words") < F.col("size"), F.array_join(F.slice(F.regexp_extract_all(F.col(f"row.{text}"), F.lit(f"({WORD})"), 1), 1, F.col("d.words").cast("int")), " ")).otherwise(F.col(f"row.{text}"))
    return one.select(*[cut.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns], F.col("d.shard").alias("mix_shard"), F.xxhash64(F.lit(seed), "row", "d.pass").alias("mix_order"))
