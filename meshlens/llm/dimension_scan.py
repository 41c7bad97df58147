"""Approximate nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Vectors are turned by a random rotation and dealt to lists by nearest centroid. Within the lists that a
query probes, candidates are scanned in blocks of columns: after each block a hypothesis test abandons
those whose partial inner product makes it unlikely that the whole one reaches the query's best so far.
Of a product P, d of D rotated columns hold, over random rotations, d / D P on average, with a variance
of at most d (D - d) / (D^2 (D - 1)) times (|query|^2 |candidate|^2 + P^2). Abandoned is who lies more than
SIGMAS deviations below what a product at the bound would hold, or can't reach it with the product of the
rests' norms, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlens.llm.common import Scratch

COLUMNS, SIGMAS, STEP, SLACK = 16, 4.0, 1024, 1e-5
NEAR = 16  # a query's bound is the k-th best of lists that hold NEAR * k candidates
QUERIES = 400  # so many are answered by brute force, to learn how many lists a query must go through


@dataclass
class Index:
    rotation: np.ndarray  # D x D
    centroids: np.ndarray  # lists x D, rotated
    probes: int

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The list of each (rotated) vector."""
        c = self.centroids
        return np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1).astype(np.int32) if len(x) else np.zeros(0, np.int32)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Each query's lists, most promising first."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")


def takes_part(x: Column) -> Column:
    """Whether an array of floats is a vector: not null, not zero, every component finite."""
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, x) of the vectors that take part: not null, not zero, every component finite."""
    x = F.col(embedding).cast("array<float>")
    return vectors.select(F.col(vec_id).cast("long").alias("id"), x.alias("x")).where(takes_part(F.col("x")) & F.col("id").isNotNull())


def fit(sample: np.ndarray, lists: int, k: int = 20, recall: float = 0.96, seed: int = 3, steps: int = 8) -> Index:
    """Rotation, k-means centroids, and as many probes as give the wished recall within the sample; rows outside it take more."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    x = sample @ rotation
    lists = max(1, min(lists, len(x)))
    index = Index(rotation, x[rng.choice(len(x), lists, replace=False)], lists)
    for _ in range(steps):
        at = index.nearest(x)
        total = np.zeros_like(index.centroids)
        np.add.at(total, at, x)
        count = np.bincount(at, minlength=lists)[:, None]
        index.centroids = np.where(count > 0, total / np.maximum(count, 1), index.centroids)
    asked = rng.choice(len(x), min(len(x), 400), replace=False)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-score, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(index.order(x[asked]), axis=1)  # of each list in the query's order
    rank = np.take_along_axis(place, index.nearest(x)[best], axis=1)
    index.probes = probes_for(rank, recall)
    return index


def scan(q: np.ndarray, x: np.ndarray, need: int, bound: np.ndarray | None = None, tally: dict | None = None) -> list[np.ndarray]:
    """For each query the candidates whose inner product may be among its need largest and reaches its bound; both sides are rotated.

    bound: the need-th best of what each query has found elsewhere. Candidates are tested against it from the first block on; only
    where no query has a bound yet, so that no test could abandon anything, is a first lot multiplied in full to get one.
    tally counts the pairs and those abandoned before their last block."""
    dim = q.shape[1]
    cuts = [*range(COLUMNS, dim, COLUMNS), dim]
    tail = lambda v, d: np.sqrt((v[:, d:] ** 2).sum(1))
    bound = np.full(len(q), -np.inf) if bound is None else bound.astype(float).copy()
    kept_q, kept_x, kept_s = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    norm_q, rest_q = tail(q, 0), [tail(q, d) for d in cuts[:-1]]
    for first in range(0, len(x), STEP):
        part = x[first : first + STEP]
        norm, abandoned = tail(part, 0), 0
        slack = SLACK + 1e-12 * norm_q * norm.max()  # what rounding makes of products of long vectors
        if len(cuts) == 1 or not np.isfinite(bound).any():
            score = q @ part.T
            least = np.partition(score, len(part) - need, axis=1)[:, len(part) - need] if len(part) >= need else np.full(len(q), -np.inf)
            a, b = np.nonzero(score >= (np.maximum(least, bound) - slack)[:, None])
            s = score[a, b]
        else:
            some = q[:, : cuts[0]] @ part[:, : cuts[0]].T
            for k, d in enumerate(cuts[:-1]):
                spread, rest = SIGMAS * np.sqrt(d * (dim - d) / (dim - 1)) / dim, tail(part, d)
                if k == 0:
                    a, b = np.nonzero(some + rest_q[k][:, None] * rest[None, :] >= (bound - slack)[:, None])
                    s = some[a, b]
                else:
                    stay = s + rest_q[k][a] * rest[b] >= bound[a] - slack[a]
                    a, b, s = a[stay], b[stay], s[stay]
                some_bound = np.isfinite(bound[a])
                least = np.where(some_bound, bound[a], 0.0)
                stay = ~some_bound | (s + spread * np.hypot(norm_q[a] * norm[b], least) >= d / dim * least - slack[a])
                a, b, s = a[stay], b[stay], s[stay]
                s = s + np.einsum("ij,ij->i", q[a, d : cuts[k + 1]], part[b, d : cuts[k + 1]])
            abandoned = len(q) * len(part) - len(a)
            stay = s >= bound[a] - slack[a]
            a, b, s = a[stay], b[stay], s[stay]
        if tally is not None:
            tally["pairs"] = tally.get("pairs", 0) + len(q) * len(part)
            tally["abandoned"] = tally.get("abandoned", 0) + abandoned
        kept_q, kept_x, kept_s = np.append(kept_q, a), np.append(kept_x, b + first), np.append(kept_s, s)
        order = np.lexsort((-kept_s, kept_q))
        kept_q, kept_x, kept_s = kept_q[order], kept_x[order], kept_s[order]
        begin = np.searchsorted(kept_q, np.arange(len(q)))
        size = np.diff(np.append(begin, len(kept_q)))
        full = size >= need
        bound[full] = np.maximum(bound[full], kept_s[begin[full] + need - 1])
        stay = kept_s >= (bound - slack)[kept_q]
        kept_q, kept_x, kept_s = kept_q[stay], kept_x[stay], kept_s[stay]
    return np.split(kept_x, np.searchsorted(kept_q, np.arange(1, len(q))))


def top(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, k: int, bound: np.ndarray | None = None, tally: dict | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best of x by exact inner product, ties to smaller ids, rows of the query's id left out;
    those below the query's bound may be missing."""
    ids, times = np.unique(x_ids, return_counts=True)
    own = times[np.isin(ids, q_ids)]
    near = scan(q @ rotation, x @ rotation, k + int(own.max(initial=0)), bound, tally)
    for i, rows in enumerate(near):
        rows = rows[x_ids[rows] != q_ids[i]]
        score = (x[rows] * q[i]).sum(axis=1)
        order = np.lexsort((x_ids[rows], -score))[:k]
        yield int(q_ids[i]), x_ids[rows][order], score[order]


def probes_for(ranks: np.ndarray, recall: float) -> int:
    """How many lists to go through, most promising first, so that a share recall of the neighbours at these places is met."""
    return int(np.quantile(ranks, recall, method="higher")) + 1 if ranks.size else 1


def _nearest_lists(dealt: DataFrame, asked: pd.DataFrame, k: int, dim: int) -> pd.DataFrame:
    """(query, list) of the exact k nearest in all of dealt (id, list, raw) to the few asked (id, x): each task compares its vectors
    with all of these and keeps k a query."""
    shared = dealt.sparkSession.sparkContext.broadcast((asked["id"].to_numpy(), np.stack(asked["x"].to_numpy()).astype(float)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q = shared.value
        best = pd.DataFrame({"query": np.zeros(0, int), "list": np.zeros(0, int), "id": np.zeros(0, int), "score": np.zeros(0)})
        for frame in frames:
            for at in range(0, len(frame), 4096):
                some = frame.iloc[at : at + 4096]
                ids, lists = some["id"].to_numpy(), some["list"].to_numpy()
                score = np.where(q_ids[:, None] == ids[None, :], -np.inf, q @ matrix(some["raw"], dim).T)
                top_ = np.argpartition(-score, min(k, len(some)) - 1, axis=1)[:, :k]
                new = pd.DataFrame({"query": np.arange(len(q)).repeat(top_.shape[1]), "list": lists[top_].ravel(), "id": ids[top_].ravel(), "score": np.take_along_axis(score, top_, axis=1).ravel()})
                best = pd.concat([best, new[new["score"] > -np.inf]]).sort_values(["query", "score", "id"], ascending=[True, False, True]).groupby("query").head(k)
        yield best

    found = dealt.select("id", "list", "raw").mapInPandas(run, "query int, list int, id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "list").toPandas()


def _dimension(rows: DataFrame) -> tuple[int, int]:
    """The most frequent length of vectors (of equally frequent ones the smaller), and how many have it."""
    sizes = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    return (sizes[0]["dim"], sizes[0]["count"]) if sizes else (0, 0)


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f4").reshape(len(column), dim).astype(float)


def search(vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", sample: int | None = None, lists: int | None = None, chunk: int = 8192, recall: float = 0.96) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each id divisible by every, the k nearest found among all others
    by inner product in double precision, nearest first, ties to smaller ids.

    The index is fitted on at most sample vectors, by a hash of the id (16 a list, 8,192 to 131,072, by default;
    2 * sqrt(vectors) lists, 16,384 at most); every vector is in it. How many lists a query goes through is learnt from at most
    QUERIES of the queries, by a hash of the id, each compared with every vector: the places of their true neighbours' lists tell
    what the wished recall takes. The sample that the centroids were fitted on doesn't, since it lies nearer to them than the rest. Vectors null, zero or not finite take no part,
    and neither do those of another length than the most frequent one. A query goes through further lists until they
    hold k candidates besides itself. Those that hold the first NEAR * k are scanned first, and the k-th best of them is the
    bound that candidates of its other lists must be likely to reach. Rows that repeat an id are candidates each, but ask once (the least
    vector does). Lists and their queries are cut into chunks of a bounded size, by the counts of each list, so a
    list that holds a third of all vectors is many tasks' work.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, vec_id, embedding)
    dim, total = _dimension(rows)
    out_schema = "query_id long, rank int, vec_id long, score double"
    if total == 0:
        return spark.createDataFrame([], out_schema)
    rows = rows.where(F.size("x") == dim)
    lists = lists or int(np.clip(2 * np.sqrt(total), 1, 16_384))
    few = rows.orderBy(F.xxhash64("id"), "id").limit(sample or int(np.clip(16 * lists, 8_192, 131_072))).toPandas()
    index = fit(np.stack([np.asarray(x, dtype=float) for x in few["x"]]), lists, k, recall)
    shared = spark.sparkContext.broadcast(index)  # lists x dim numbers, at most 16,384 lists

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.stack(frame["x"].to_numpy())
                yield pd.DataFrame({"id": frame["id"], "list": shared.value.nearest(x @ shared.value.rotation), "raw": [v.astype("<f4").tobytes() for v in x]})

    scratch = Scratch(spark, "dimension-scan")
    dealt = scratch.cut(rows.mapInPandas(deal, "id long, list int, raw binary"))
    held_by = {r["list"]: r["count"] for r in dealt.groupBy("list").count().collect()}  # one line a list
    sizes = spark.sparkContext.broadcast(np.array([held_by.get(i, 0) for i in range(len(index.centroids))]))

    asking = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("x").alias("x"), F.count("*").alias("rows"))
    trial = asking.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(QUERIES).toPandas()
    probes = 1
    if len(trial):
        near = _nearest_lists(dealt, trial, k, dim)
        place = np.argsort(index.order(np.stack(trial["x"].to_numpy()) @ index.rotation), axis=1)
        probes = probes_for(place[near["query"].to_numpy(), near["list"].to_numpy()], recall)

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 512):
                some = frame.iloc[at : at + 512]
                x = np.stack(some["x"].to_numpy())
                order = shared.value.order(x @ shared.value.rotation)
                reach = np.cumsum(sizes.value[order], axis=1) - some["rows"].to_numpy()[:, None]  # the query's own rows may be among them
                enough = np.minimum((reach < k).sum(1) + 1, order.shape[1])
                place = np.arange(order.shape[1])[None, :]
                used = place < np.maximum(probes, enough)[:, None]
                near = used & (place < ((reach < NEAR * k).sum(1) + 1)[:, None])
                yield pd.DataFrame({"id": some["id"].to_numpy().repeat(used.sum(1)), "list": order[used].astype(np.int32), "near": near[used], "raw": np.repeat(np.array([v.astype("<f4").tobytes() for v in x], dtype=object), used.sum(1))})

    asked = scratch.cut(asking.mapInPandas(probe, "id long, list int, near boolean, raw binary"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "found": []})
        got = list(top(right["id"].to_numpy(), matrix(right["raw"], dim), left["id"].to_numpy(), matrix(left["raw"], dim), shared.value.rotation, k, right["bound"].to_numpy(float)))
        return pd.DataFrame({"query_id": [g[0] for g in got], "found": [[{"vec_id": int(i), "score": float(s)} for i, s in zip(g[1], g[2])] for g in got]})

    def scanned(asked: DataFrame) -> DataFrame:
        asks = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
        cuts = F.broadcast(spark.createDataFrame([(i, -(-n // chunk), -(-asks.get(i, 0) // chunk)) for i, n in held_by.items()], "list int, parts int, lots int"))
        held = dealt.join(cuts.where("lots > 0"), "list").select("id", "raw", "list", F.expr("cast(pmod(xxhash64(id), parts) as int)").alias("part"), F.explode(F.expr("sequence(0, lots - 1)")).alias("lot"))
        asking = asked.join(cuts, "list").select("id", "raw", "bound", "list", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.expr("cast(pmod(xxhash64(id, 7), lots) as int)").alias("lot"))
        keys = ["list", "part", "lot"]
        return held.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(compare, "query_id long, found array<struct<vec_id long, score double>>")

    near = scratch.cut(_ranked(scanned(asked.where("near").withColumn("bound", F.lit(float("-inf")))), k))
    bounds = near.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("bound"))
    far = scanned(asked.where("not near").join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))))
    return _best(near.select("query_id", "vec_id", "score").union(_flat(far)), k)


def _flat(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.explode("found").alias("f")).select("query_id", "f.vec_id", "f.score")


def _best(flat: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return flat.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return _best(_flat(found), k)


def recall_of(found: DataFrame, vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = 256) -> float:
    """The share of the exact k nearest of at most sample queries, by a hash of the id, that found has: each task
    compares its vectors with all of the sample, by brute force."""
    rows = valid(vectors, vec_id, embedding)
    dim, _ = _dimension(rows)
    rows = rows.where(F.size("x") == dim)
    few = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("x").alias("x")).orderBy(F.xxhash64("id", F.lit(5)), "id").limit(sample).toPandas()
    if not len(few):
        return 1.0
    shared = rows.sparkSession.sparkContext.broadcast((few["id"].to_numpy(), np.stack(few["x"].to_numpy()).astype(float)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q = shared.value
        for frame in frames:
            for at in range(0, len(frame), 2048):
                some = frame.iloc[at : at + 2048]
                x, ids = np.stack(some["x"].to_numpy()).astype(float), some["id"].to_numpy()
                score = np.where(q_ids[:, None] == ids[None, :], -np.inf, q @ x.T)
                order = np.argsort(-score, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"query_id": q_ids, "found": [[{"vec_id": int(ids[j]), "score": float(score[i, j])} for j in order[i] if score[i, j] > -np.inf] for i in range(len(q))]})

    exact = _ranked(rows.mapInPandas(run, "query_id long, found array<struct<vec_id long, score double>>"), k).select("query_id", "vec_id")
    return exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")).distinct(), ["query_id", "vec_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 1.0
