"""Sharding, conversation repair and whitening against plain versions, over odd rows and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlens.llm import conversation_repair, sampled_splitters, tsqr_whitening
from meshlens.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"


# sharding


def test_op11(spark, tmp_path):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcé 日", k=rng.randint(0, 80))) for _ in range(3000)] + [None] * 40 + [""] * 10 + ["copy of a copy"] * 1500
    docs = [(i if i % 50 else None, t, "x", "x", 1) for i, t in enumerate(texts)] + [(7, "one row again and again", "x", "x", 1)] * 900
    schema = "doc_id long, text string, shard string, row string, size int"
    spark.createDataFrame(docs, schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_sampled_splitters"](spark, str(tmp_path)).toPandas()
    want = sorted((-1 if d[0] is None else d[0], len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in docs)
    assert sorted(zip(got["doc_id"].fillna(-1).astype(int), got["size"], got["text_crc32"])) == want
    assert set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all() and sorted(got["shard"].unique()) == list(range(24))
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 2 * (0.005 * sums.mean() + 250)  # the slack and half of the longest record, at either end
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    shards_of = got.groupby(["text_crc32", "size"])["shard"].nunique()
    assert (shards_of > 1).sum() <= 23 and shards_of.max() >= 3  # a group is only cut by a shard's edge; the hot ones are
    again = QUERIES["op11_sampled_splitters"](spark, str(tmp_path)).toPandas()
    by = ["doc_id", "text_crc32", "shard", "slot"]
    assert again.sort_values(by)[by].reset_index(drop=True).equals(got.sort_values(by)[by].reset_index(drop=True))


def test_op11_small_and_empty(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/few/documents.parquet")
    got = QUERIES["op11_sampled_splitters"](spark, f"{tmp_path}/few").toPandas()
    assert len(got) == 3 and got["shard"].between(0, 23).all() and got["shard"].nunique() == 3 and set(got["slot"]) == {0}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op11_sampled_splitters"](spark, f"{tmp_path}/none").count() == 0


def test_ranges_are_never_too_full(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("group"), F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 100 + 1).alias("size"), F.col("id").alias("doc_id"))
    keyed = sampled_splitters.keyed(rows, "doc_id", F.col("size"), F.col("group"), F.struct("doc_id"))
    splits, full = sampled_splitters.splitters(keyed, 100, 4, 1)
    assert full["n"].sum() == 20_000 and full["n"].max() <= 2 * 20_000 / 100 and full["bytes"].max() <= 2 * full["bytes"].sum() / 100
    assert [tuple(s) for s in splits] == sorted(tuple(s) for s in splits)


def test_places():
    splits = np.array([[1, 5], [3, 2], [3, 9], [8, 0]])
    k, tie = np.array([0, 1, 1, 3, 3, 3, 9]), np.array([9, 4, 5, 1, 2, 10, 0])
    assert sampled_splitters.places(splits, k, tie).tolist() == [sum((a, b) <= (x, y) for a, b in splits.tolist()) for x, y in zip(k, tie)]
    assert sampled_splitters.places(np.zeros((0, 2), np.int64), k, tie).tolist() == [0] * 7


def test_write_shards(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 9).cast("int")).alias("text"))
    sharded = sampled_splitters.shard(docs, F.octet_length("text") + 8, F.col("text"), shards=4)
    sampled_splitters.write_shards(sharded, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.select("row.doc_id").distinct().count() == 500 and sorted(r.shard for r in back.select("shard").distinct().collect()) == [0, 1, 2, 3]
    assert {(r.shard, r.slot) for r in back.collect()} == {(r.shard, r.slot) for r in sharded.collect()}


# conversation repair


def plain_repair(rows):
    """The contract's digest of rows (turn, role, text), worked out over whole strings from the last row on."""
    seen, fault = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ()), "a": (0, "", ())}
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            _, role, text = rows[i]
            new = {q: (c + 4, "D" + a, o) for q, (c, a, o) in best.items()}
            for (q, t), to in after.items():
                if to not in best or fault[i] in ("blank", "duplicate") or (role[:1] != t and t == "s"):
                    continue
                c, a, o = best[to]
                kept = role[:1] == t
                x = (c + (0 if kept else 3) + (3 if fault[i] == "truncated" else 0), ("K" if kept else "R") + a, ((role if kept else name[t], text), *o))
                new[q] = min(new.get(q, x), x, key=lambda y: y[:2])
            best = new
        for _ in range(4):
            for (q, t), to in after.items():
                if t != "s" and to in best:
                    c, a, o = best[to]
                    x = (c + 3, "I" + a, ((name[t], ""), *o))
                    best[q] = min(best.get(q, x), x, key=lambda y: y[:2])
    cost, audit, out = best[""]
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: fault.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    }


def damage(table):
    """conversation -> its rows after the query's damage, in order."""
    out = {}
    for conv, turn, role, text in table:
        rows = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            rows += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def test_op12(spark, tmp_path):
    rng = random.Random(8)
    texts = ["Yes.", "No!", "why?", "cut off", "", " \t", "two.\n", "日本。", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    table = [(c if c % 40 else None, rng.choice([*range(12), None, 30]) if c % 3 == 0 else t, rng.choice(roles), rng.choice(texts) if c % 2 else f"{rng.choice(texts)}{t}.") for c in range(600) for t in range(rng.randint(1, 9))]
    table += [(5000, t, ("user", "assistant")[t % 2], f"part {t}." * (t % 4)) for t in range(3000)] + [(5001, 1, "user", "x" * 200_000)] * 3
    spark.createDataFrame([(*r, 1, "c") for r in table], "conv_id long, turn long, role string, text string, pos int, conv string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.asDict() for r in QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    want = damage(table)
    assert set(got) == set(want)
    for conv, rows in want.items():
        assert {k: v for k, v in got[conv].items() if k != "conv_id"} == plain_repair(rows), conv
    none = next(c for c, rows in want.items() if not rows)
    assert got[none]["audit"] == "" and got[none]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_op12_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op12_conversation_repair"](spark, str(tmp_path)).count() == 0


def test_repaired_rows_fit_the_grammar(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b?", "c"]) + str(rng.randint(0, 3)) + rng.choice(["", "."])) for c in range(300) for t in range(rng.randint(1, 7))]
    edits = conversation_repair.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).toPandas()
    for conv, g in edits.sort_values("place").groupby("conv"):
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, e in zip(g["role"], g["edit"]) if e != "D")), conv
        assert list(g["place"]) == list(range(1, len(g) + 1)) and (g["edit"] != "I").sum() == sum(r[0] == int(conv) for r in rows)
        kept = g[g["edit"] == "K"]
        assert (kept["role"] == kept["old_role"]).all()


def test_chart_table_stays_small():
    chart, rng = conversation_repair.Chart(), random.Random(1)
    number = chart.first
    for _ in range(20_000):
        number = chart.step(number, rng.choice("suax"), rng.random() < 0.2, rng.choice([0, 3]))[0]
    assert len(chart.columns) < 300


# whitening


def vectors():
    rng = np.random.default_rng(6)
    x = (rng.standard_normal((400, 7)) @ rng.standard_normal((7, 7))).astype(np.float32)
    x[100:250] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[5].tolist())]
    odd = [(900, None), (901, [1.0, None] + [0.0] * 5), (902, [float("nan")] * 7), (903, [float("-inf")] * 7), (904, []), (905, [0.5, 0.25])]
    return rows, odd + [(910 + i, [float(i), 1.0, float(i * i)]) for i in range(5)]


def test_op13(spark, tmp_path):
    rows, odd = vectors()
    spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, component int, x string").repartition(12).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op13_tsqr_whitening"](spark, str(tmp_path)).toPandas()
    got["vec_id"] = got["vec_id"].fillna(-1).astype(int)
    assert set(got["vec_id"]) == {-1 if i is None else i for i, _ in rows} | {910, 911, 912, 913, 914}
    for part, width in ((rows, 4), ([(i, v) for i, v in odd if i >= 910], 2)):
        x = np.floor(256 * np.array([v for _, v in part], dtype=float)).astype(np.int64)
        fit = np.unique(x, axis=0)
        n, s = len(fit), fit.sum(0)
        c = fit - s / n
        e, v = np.linalg.eigh(c.T @ c / n)
        e, v = e[::-1], v[:, ::-1]
        white = (x - s / n) @ v[:, :width] / np.sqrt(e[:width])
        own = got[got["vec_id"].isin([-1 if i is None else i for i, _ in part])]
        assert len(own) == len(part) * width and (own["n"] == n).all() and (own["identity_error"] <= 1e-9).all() and own["identity_error"].nunique() == 1
        table = own.pivot(index="vec_id", columns="component", values="whitened").loc[[-1 if i is None else i for i, _ in part]].to_numpy()
        sign = np.sign((table * white).sum(0))
        assert np.allclose(table * sign, white, atol=1e-9)
        first = own[own["component"] == 1].set_index("vec_id")
        deviation = ((n * x - s) ** 2).sum(1)
        assert [first.loc[-1 if i is None else i, "deviation"] for i, _ in part] == deviation.tolist()
        for k in range(width):
            assert own[own["component"] == k + 1]["explained"].iloc[0] == pytest.approx(e[k] / e.sum(), rel=1e-9)


def test_op13_empty_and_constant(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert QUERIES["op13_tsqr_whitening"](spark, f"{tmp_path}/none").count() == 0
    spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/same/embeddings.parquet")
    assert QUERIES["op13_tsqr_whitening"](spark, f"{tmp_path}/same").count() == 0


def test_exact_beyond_64_bits():
    x = np.array([[1 << 60, -(1 << 60)], [5, 6]])
    assert tsqr_whitening.n_times_deviation(x, 1000, [3, 4]).tolist() == [[1000 * (1 << 60) - 3, -1000 * (1 << 60) - 4], [4997, 5996]]
