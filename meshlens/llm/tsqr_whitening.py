"""Whitening of vectors by TSQR: no covariance matrix is formed.

Vectors become integers first, so that their sums are exact. Each partition of the distinct vectors centres its rows and
keeps only the triangular factor of its QR decomposition, batch by batch; the factors are merged in a tree, a few at a
time, each level a written table; the singular values and right vectors of the last factor are those of all centred rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm.common import Scratch

SCALE, SAFE = 256, 1 << 62
OUT = "id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, x): x holds floor(256 * entry). Rows whose vector is null or holds a null or a non-finite entry are left out."""
    v = F.col(vec).cast("array<double>")
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))  # NaN is above infinity to Spark
    return vectors.where(v.isNotNull() & finite).select(F.col(key).alias("id"), F.transform(v, lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, rows as a matrix) for each length of the arrays in a column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def n_times_deviation(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: in 64 bits where they do, else in Python's integers."""
    top = max(abs(int(x.max())), abs(int(x.min())), 1) if x.size else 1
    if top * n + max(map(abs, sums), default=0) < SAFE:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return n_times_deviation(x, n, sums).astype(np.float64) / n


def exact_sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Length -> (number of vectors, sum of each entry); one line an entry reaches the driver."""
    entry = fit.select(F.size("x").alias("d"), F.posexplode("x").alias("pos", "c")).groupBy("d", "pos")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(entry.agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).collect(), key=lambda r: (r.d, r.pos)):
        out.setdefault(r.d, (r.n, []))[1].append(int(r.s))
    return out


def triangular(fit: DataFrame, sums: dict[int, tuple[int, list[int]]], scratch: Scratch, fan: int) -> dict[int, np.ndarray]:
    """Length -> the triangular factor of all centred vectors of that length."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in by_length(batch.column(0)):
                if d:
                    held[d] = np.linalg.qr(np.vstack([held.get(d, np.zeros((0, d))), centred(x, *sums[d])]), mode="r")
        yield pa.RecordBatch.from_pydict({"d": pa.array(list(held), pa.int32()), "part": pa.array([TaskContext.get().partitionId()] * len(held), pa.int64()), "r": pa.array([r.tobytes() for r in held.values()], pa.binary())})

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        d = int(group["d"].iloc[0])
        rows = [np.frombuffer(r).reshape(-1, d) for _, r in sorted(zip(group["part"], group["r"]))]
        return pd.DataFrame({"d": [d], "part": [group["part"].iloc[0] // fan], "r": [np.linalg.qr(np.vstack(rows), mode="r").tobytes()]})

    level = scratch.cut(fit.mapInArrow(local, "d int, part long, r binary"))
    while (level.agg(F.max("part")).first()[0] or 0) > 0:
        level = scratch.cut(level.groupBy("d", F.floor(F.col("part") / fan).alias("group")).applyInPandas(lambda key, g: merged(g), "d int, part long, r binary"))
    return {r.d: np.frombuffer(r.r).reshape(-1, r.d) for r in level.collect()}


def components(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(right vectors as rows, variances, shares of the whole variance) of up to that many components, by falling
    variance; those without variance to double precision aren't components."""
    _, s, vt = np.linalg.svd(r)
    s = s[: min(r.shape)]
    keep = [k for k in range(min(most, len(s))) if s[k] > s[0] * max(n, r.shape[1]) * np.finfo(float).eps]
    signs = np.array([1.0 if v[np.argmax(np.abs(v))] > 0 else -1.0 for v in vt[keep]])
    e = s * s / n
    return vt[keep] * signs[:, None] if keep else vt[:0], e[keep], e[keep] / e.sum() if keep else e[keep]


def whiten(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", most: int = 4, fan: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row of vectors and each of up to most
    components, numbered from 1.

    The fit is over each distinct integer vector once: repeated rows don't weigh, and each gets its own result. Rows whose
    vector is null or holds null or non-finite entries give nothing, nor do empty vectors and vectors that don't vary (a
    single one, say); null keys are kept. Vectors of several lengths are whitened apart, each length with its own n and
    identity_error. An entry of 2**63 / 256 or more stops at the largest long; a deviation beyond a long is null. Only the sums, one
    triangular factor a length and the variances of the result reach the driver; their size doesn't grow with the rows.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "whitening")
    rows = integers(vectors, key, vec)
    fit = scratch.cut(rows.select("x").distinct())
    sums = exact_sums(fit)
    factors = triangular(fit, sums, scratch, fan)
    model = {d: (*sums[d], *components(r, sums[d][0], most)) for d, r in factors.items()}

    def project(d: int, x: np.ndarray) -> np.ndarray:
        n, s, v, e, _ = model[d]
        return centred(x, n, s) @ v.T / np.sqrt(e)

    def whitened_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, _, x in by_length(batch.column(0)):
                if d in model:
                    w = project(d, x)
                    full = np.hstack([w, np.zeros((len(w), most - w.shape[1]))])
                    yield pa.RecordBatch.from_pydict({"d": pa.array(np.full(len(w), d), pa.int32())} | {f"w{k}": pa.array(full[:, k]) for k in range(most)})

    white = fit.mapInArrow(whitened_fit, ", ".join(["d int", *(f"w{k} double" for k in range(most))]))
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    spread = white.groupBy("d").agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).collect()  # centred, then multiplied
    error = {r.d: max((abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < len(model[r.d][3])), default=0.0) for r in spread}

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in by_length(batch.column(1)):
                if d not in model or not len(model[d][3]):
                    continue
                n, s, _, e, share = model[d]
                k, dev = len(e), n_times_deviation(x, n, s)
                top = max((abs(int(a)) for a in (dev.max(), dev.min())), default=0)
                square = (dev.astype(object) ** 2).sum(1) if top * top * d >= SAFE else (dev * dev).sum(1)
                fits = [int(q) if q < 1 << 63 else None for q in square.tolist()]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), pa.array(np.full(len(at) * k, n), pa.int64()),
                    pa.array([q for q in fits for _ in range(k)], pa.int64()), pa.array(project(d, x).reshape(-1)), pa.array(np.tile(share, len(at))), pa.array(np.full(len(at) * k, error[d])),
                ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, OUT.format(rows.schema["id"].dataType.simpleString()))
