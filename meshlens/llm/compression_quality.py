"""Quality scores by compression: zstandard dictionaries of good and of bad text.

A document is compressed with either dictionary; the difference of the two sizes, normalised by their
sum, is calibrated to the probability of label 1. Two terms beside it help short and odd texts: the length,
and the size under the good dictionary over the bytes (README has what they add).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm.common import Scratch, by_group

LEVEL, PIECE = 3, 4096


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def _compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
    out = []
    for d in (good, bad):
        data = zstandard.ZstdCompressionDict(d)
        data.precompute_compress(level=LEVEL)
        out.append(make(data))
    return out


def sizes(texts: list[str], model: Model) -> np.ndarray:
    """A row for each text: bytes, and compressed bytes with the good and with the bad dictionary.

    Long texts are compressed piece by piece, so that the dictionaries weigh as much there as in short ones."""
    good, bad = _compressors(model.good, model.bad)
    out = np.zeros((len(texts), 3))
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "replace")
        for at in range(0, len(raw), PIECE):
            piece = raw[at : at + PIECE]
            out[i] += len(piece), len(good.compress(piece)), len(bad.compress(piece))
    return out


def features(size: np.ndarray) -> np.ndarray:
    """What the calibration sees: the difference of the compressed sizes normalised by their sum, alone and
    damped for short texts, and how far the good dictionary compresses at all."""
    n, good, bad = size.T
    d = 20 * (bad - good) / np.maximum(good + bad, 1)
    short = 1 / (1 + n / 200)
    ratio = np.minimum(good / np.maximum(n, 1), 1.2)
    return np.stack([np.ones_like(d), d, d * short, short, 5 * ratio, 5 * ratio**2], axis=1)


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[float, ...]:
    """Logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return tuple(float(v) for v in w)


def dictionary(raw: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the raw text where there is too little of it to train one."""
    try:
        return zstandard.train_dictionary(size, raw).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(raw)[-size:] or b" "


def labelled_rows(docs: DataFrame, labels: DataFrame, per_label: int = 3000, holdout: int | None = 5, key: str = "doc_id", text: str = "text", label: str = "quality", scratch: Scratch | None = None) -> DataFrame:
    """k, text, label, calibrates: whole texts of at most per_label rows of each label, by hashes of key and text; a
    quarter of the rows, by a hash of both, calibrates. Keys whose crc32 (as text) is divisible by holdout are left out.

    Equal rows count once. A key with both labels is in both samples, once with each label. Null keys and labels other
    than 0 and 1 are left out; null texts are empty ones."""
    named = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and k is not null").distinct()
    if holdout:
        named = named.where(F.crc32(F.col("k").cast("string")) % holdout != 0)
    parts = [named.where(F.col("label") == v).orderBy(F.xxhash64("k"), "k").limit(per_label) for v in (0, 1)]
    few = F.broadcast(parts[0].union(parts[1]))  # at most 2 * per_label rows
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(few, "k")
    rows = rows.groupBy("k", "label", F.md5("text").alias("fp")).agg(F.first("text").alias("text"))
    rows = (scratch or Scratch(docs.sparkSession, "quality")).cut(rows)
    # a key may have many texts: of the rows, too, at most per_label of each label stay
    kept = [rows.where(F.col("label") == v).select("k", "label", "fp").orderBy(F.xxhash64("k"), "k", "fp").limit(per_label) for v in (0, 1)]
    return rows.join(F.broadcast(kept[0].union(kept[1])), ["k", "label", "fp"]).select("k", "text", "label", (F.pmod(F.xxhash64("k", "text"), F.lit(4)) == 0).alias("calibrates"))


def _to_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for k, text, label in zip(frame["k"], frame["text"], frame["label"]):
            raw = text.encode("utf-8", "replace")
            pieces = [raw[at : at + PIECE] for at in range(0, len(raw), PIECE)]
            yield pd.DataFrame({"k": k, "label": label, "at": np.arange(len(pieces)), "piece": pieces})


def dictionaries(pieces: DataFrame, size: int, at_once: int) -> list[bytes]:
    """The dictionaries of labels 1 and 0 of all pieces (k, label, at, piece).

    Up to at_once pieces of a label, by a hash, are trained on by a task. Of more there are several dictionaries,
    whose own pieces one more training makes one of, so the driver holds a dictionary for each at_once pieces."""
    counts = dict(pieces.groupBy("label").count().collect())
    groups = F.create_map(*[F.lit(x) for v in (0, 1) for x in (v, -(-counts.get(v, 0) // at_once) or 1)])
    dealt = pieces.withColumn("hash", F.xxhash64("k", "at", "piece")).withColumn("group", F.col("label") + 2 * F.pmod("hash", groups[F.col("label")]))

    def train(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["hash", "k", "at"], kind="stable")
        return pd.DataFrame({"group": g["group"].iloc[:1], "piece": [dictionary([bytes(x) for x in g["piece"]], size)]})

    made = by_group(dealt, "group", train, "group long, piece binary").toPandas().sort_values("group")
    out = []
    for v in (1, 0):
        some = [bytes(x) for x in made["piece"][made["group"] % 2 == v]]
        out.append(some[0] if len(some) == 1 else dictionary([x[at : at + PIECE] for x in some for at in range(0, len(x), PIECE)], size))
    return out


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 3000, size: int = 1 << 17, holdout: int | None = 5, key: str = "doc_id", text: str = "text", label: str = "quality", scratch: Scratch | None = None, at_once: int = 8192) -> Model:
    """A model from a sample bounded by one parameter: whole texts of at most per_label rows of each label, as
    labelled_rows has them. All pieces of those that don't calibrate make the dictionaries (see dictionaries); those
    that are set aside calibrate, as whole texts, measured where they are."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    rows = labelled_rows(docs, labels, per_label, holdout, key, text, label, scratch)
    pieces = rows.where("not calibrates").mapInPandas(_to_pieces, "k long, label int, at long, piece binary")
    model = Model(*dictionaries(scratch.cut(pieces), size, at_once), ())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"label": frame["label"], "x": list(features(sizes(frame["text"].tolist(), shared.value)))})

    seen = rows.where("calibrates").mapInPandas(run, "label int, x array<double>").toPandas()
    if seen["label"].nunique() < 2:
        good, every = rows.agg(F.sum("label"), F.count("*")).first()
        odds = np.log(((good or 0) / every + 0.01) / (1.01 - (good or 0) / every)) if every else np.log(101)
        return Model(model.good, model.bad, (float(odds), 0.0, 0.0, 0.0, 0.0, 0.0))
    order = np.lexsort(np.stack(seen["x"].to_list()).T)
    return Model(model.good, model.bad, calibrate(np.stack(seen["x"].to_list())[order], seen["label"].to_numpy(float)[order]))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, names: tuple[str, str] = ("quality_score", "quality_predicted")) -> DataFrame:
    """All columns of docs with a score (0 to 1) and a prediction (1 if the score reaches threshold) under names.

    Columns of docs that have these names are replaced. Whole texts are compressed; null texts score as empty ones.
    Rows are kept as they are, repeated or not."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for t in texts:
            p = features(sizes(t.fillna("").tolist(), m)) @ np.array(m.weights)
            yield pd.Series(1 / (1 + np.exp(-np.clip(p, -30, 30))))

    scored = F.pandas_udf(run, "double")
    return docs.withColumn(names[0], scored(F.col(text))).withColumn(names[1], F.when(F.col(names[0]) >= threshold, 1).otherwise(0))
