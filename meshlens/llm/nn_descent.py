"""Near-duplicate vectors by NN-descent.

A first neighbour graph comes from random-projection trees; rounds then join neighbours of neighbours
(both directions) and keep each node's best, until a round finds next to no new link. A list that is
saturated, all its entries above the threshold, is enlarged: first to four times its length, and at
last, exactly: its node is compared with all vectors of its label, which joins components, and then with
all members of its component, tile by tile without emitting a pair. The recall of links is audited against brute force on a sample of nodes; while it is too low, rounds go on
with longer lists, and at last all vectors of each label are compared, tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlens.llm.common import Scratch, by_group, connected_components
from meshlens.llm.dimension_scan import takes_part

LEAF, TREES, BITS, TILE = 64, 4, 16, 512


def matrix(column: pd.Series) -> np.ndarray:
    """Unit vectors, in double precision, of a column of float arrays as bytes; shorter ones are filled up with zeros,
    which changes no product of two of one length."""
    most = max(map(len, column), default=0)
    x = np.frombuffer(b"".join(v.ljust(most, b"\0") for v in column), "<f4").astype(float).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _best(score: np.ndarray, allowed: np.ndarray, node: np.ndarray, k: int) -> pd.DataFrame | None:
    """For each row the k largest scores among its allowed columns."""
    score = np.where(allowed, score, -2.0)
    k = min(k, score.shape[1])
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    got = np.take_along_axis(score, top, axis=1)
    a, b = np.nonzero(got > -2)
    return pd.DataFrame({"u": node[a], "v": node[top[a, b]], "score": got[a, b]}) if len(a) else None


def first_graph(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """(u, v, score) of neighbours that share a leaf of a random-projection tree; leaves of nodes that
    no split parts are dealt at random into parts of LEAF nodes."""

    def codes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = matrix(frame["raw"])
                for t in range(TREES):
                    planes = np.random.default_rng([seed, t]).standard_normal((x.shape[1], BITS))
                    code = ((x @ planes > 0) * (1 << np.arange(BITS - 1, -1, -1))).sum(1)
                    yield pd.DataFrame({"node": frame["node"], "label": frame["label"], "tree": t, "code": code})

    coded = nodes.select("node", "label", "raw").mapInPandas(codes, "node long, label string, tree int, code int")
    sizes = nodes.groupBy("label").agg(F.count("*").alias("members"))
    depth = F.least(F.lit(BITS), F.ceil(F.log2(F.greatest(F.col("members") / LEAF, F.lit(1.0))))).cast("int")
    coded = coded.join(sizes, "label").withColumn("leaf", F.xxhash64("label", "tree", F.floor(F.col("code") / F.pow(F.lit(2.0), BITS - depth)).cast("int")))
    full = coded.groupBy("leaf").agg(F.count("*").alias("held"))
    parted = coded.join(full, "leaf").withColumn("group", F.xxhash64("leaf", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("held") / LEAF))))

    def one(g: pd.DataFrame) -> pd.DataFrame | None:
        if len(g) < 2:
            return None
        x = matrix(g["raw"])
        return _best(x @ x.T, ~np.eye(len(g), dtype=bool), g["node"].to_numpy(), k)

    return by_group(parted.select("group", "node").join(nodes.select("node", "raw"), "node"), "group", one, "u long, v long, score double")


def drawing(round_: int) -> Window:
    """The order in which a node's reverse neighbours are drawn for the round after this one."""
    return Window.partitionBy("v").orderBy(F.desc("fresh"), F.xxhash64("u", F.lit(round_ + 1)), "u")


def kept_lists(edges: DataFrame, k: int, threshold: float, round_: int) -> DataFrame:
    """Each node's k best, and up to four times as many where they reach the threshold; worst: the last of the scores
    once there are k, so a node is saturated where worst reaches the threshold. new: found in this round; fresh: not
    yet compared; drawn: among the 2 k reverse neighbours of v that take part in the next round."""
    once = edges.repartition("u").groupBy("u", "v").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"), F.min("new").alias("new"))
    order = Window.partitionBy("u").orderBy(F.desc("score"), "v")
    ranked = once.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) | (F.col("score") >= threshold) & (F.col("rank") <= 4 * k))
    listed = ranked.withColumn("worst", F.when(F.max("rank").over(Window.partitionBy("u")) >= k, F.min("score").over(Window.partitionBy("u"))).otherwise(F.lit(-1.5))).drop("rank")
    return listed.withColumn("drawn", F.row_number().over(drawing(round_)) <= 2 * k)


def descend(graph: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """Candidates (u, v, score) that a round finds: pairs of neighbours of one node, at least one of them fresh there,
    that beat the worst entry of u's list or reach the threshold. Of a node's reverse neighbours, those drawn take part."""
    forward = graph.select(F.col("u").alias("pivot"), F.col("v").alias("member"), "fresh")
    reverse = graph.where("drawn").select(F.col("v").alias("pivot"), F.col("u").alias("member"), "fresh")
    members = forward.union(reverse).groupBy("pivot", "member").agg(F.max("fresh").alias("fresh"))
    state = nodes.select(F.col("node").alias("member"), "raw").join(graph.groupBy(F.col("u").alias("member")).agg(F.first("worst").alias("worst")), "member")

    def one(g: pd.DataFrame) -> pd.DataFrame | None:
        fresh = g["fresh"].to_numpy(bool)
        if len(g) < 2 or not fresh.any():
            return None
        x = matrix(g["raw"])
        score = x @ x.T
        allowed = (fresh[:, None] | fresh[None, :]) & ~np.eye(len(g), dtype=bool) & (score > np.minimum(g["worst"].to_numpy(), np.nextafter(threshold, -2))[:, None])
        return _best(score, allowed, g["member"].to_numpy(), k)

    return by_group(members.join(state, "member"), "pivot", one, "u long, v long, score double")


def links_within(members: DataFrame, threshold: float) -> DataFrame:
    """members (node, root, weight, raw) -> (node, n): the weight of the others of its component at or above threshold.

    A component of more than TILE nodes is dealt into tiles, each pair of which is one bounded group."""
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiled = members.join(sizes, "root").withColumns({"tile": F.expr("cast(pmod(xxhash64(node), tiles) as int)"), "other": F.explode(F.expr("sequence(0, tiles - 1)"))})
    side = lambda left, a, b: tiled.select(F.xxhash64("root", a, b).alias("pair"), F.lit(left).alias("asks"), "node", "weight", "raw")

    def one(g: pd.DataFrame) -> pd.DataFrame | None:
        asks = g["asks"].to_numpy(bool)
        a, b = g[asks], g[~asks]
        if not len(a) or not len(b):
            return None
        near = (matrix(a["raw"]) @ matrix(b["raw"]).T >= threshold) & (a["node"].to_numpy()[:, None] != b["node"].to_numpy()[None, :])
        return pd.DataFrame({"node": a["node"].to_numpy(), "n": near @ b["weight"].to_numpy()})

    parts = by_group(side(True, "tile", "other").union(side(False, "other", "tile")), "pair", one, "node long, n long")
    return parts.groupBy("node").agg(F.sum("n").alias("n"))


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Those of the pairs that first join two components: at most one less than there are ends."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept = []
    for a, b in pairs.tolist():
        ra, rb = find(a), find(b)
        if ra != rb:
            root[ra] = rb
            kept.append((a, b))
    return np.array(kept, dtype=np.int64).reshape(-1, 2)


def links_across(nodes: DataFrame, threshold: float) -> DataFrame:
    """nodes (node, label, root, asks, raw) -> (u, v): roots of components that a link joins. Every node that asks is
    compared with all nodes of its label, in pairs of tiles; of a pair's links a spanning forest is told."""
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    sizes = nodes.groupBy("label").agg(tiles(F.count("*")).alias("tiles"), tiles(F.count_if("asks")).alias("asking")).where("asking > 0")
    sized = nodes.join(sizes, "label")

    def side(left: bool, rows: DataFrame, own: str, others: str) -> DataFrame:
        dealt = rows.withColumns({"tile": F.expr(f"cast(pmod(xxhash64(node), {own}) as int)"), "other": F.explode(F.expr(f"sequence(0, {others} - 1)"))})
        a, b = ("tile", "other") if left else ("other", "tile")
        return dealt.select(F.xxhash64("label", a, b).alias("pair"), F.lit(left).alias("left"), "root", "raw")

    def one(g: pd.DataFrame) -> pd.DataFrame | None:
        left = g["left"].to_numpy(bool)
        a, b = g[left], g[~left]
        if not len(a) or not len(b):
            return None
        ra, rb = a["root"].to_numpy(), b["root"].to_numpy()
        i, j = np.nonzero((matrix(a["raw"]) @ matrix(b["raw"]).T >= threshold) & (ra[:, None] != rb[None, :]))
        found = _forest(np.unique(np.stack([ra[i], rb[j]], axis=1), axis=0))
        return pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})

    both = side(True, sized.where("asks"), "asking", "tiles").union(side(False, sized, "tiles", "asking"))
    return by_group(both, "pair", one, "u long, v long")


def joined_across(nodes: DataFrame, roots: DataFrame, asking: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """roots (node, root) with components joined by all links of the nodes of asking (node)."""
    named = nodes.select("node", "label", "raw").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = named.join(asking.select("node", F.lit(True).alias("asks")), "node", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    merged = connected_components(links_across(rows, threshold), scratch).select(F.col("node").alias("root"), F.col("root").alias("joined"))
    known = nodes.select("node").join(roots, "node", "left").select("node", F.col("root").alias("old"), F.coalesce("root", "node").alias("root")).join(merged, "root", "left")
    return scratch.cut(known.where("old is not null or joined is not null").select("node", F.coalesce("joined", "root").alias("root")))


def audit(nodes: DataFrame, roots: DataFrame, threshold: float, sample: int = 256) -> float:
    """The recall of links by nodes, not by links, so that a large group doesn't hide losses elsewhere.

    From each class of components by size (single nodes, up to 8 nodes, up to 64, ...) a bounded sample of nodes is
    compared by brute force with all nodes of their labels. The recall of a node is the share of its links that lie
    within its component. Told is the smallest of the averages over the nodes with up to 1, 8, 64, ... links, each node
    weighed by the nodes that it stands for. Each task returns two sums for each sampled node."""
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = named.groupBy("root").agg(F.count("*").alias("held"))
    level = named.join(sizes, "root").select("node", F.ceil(F.log2("held") / 3).cast("int").alias("level"))
    order = Window.partitionBy("level").orderBy(F.xxhash64("node", F.lit(11)), "node")
    few = level.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).join(level.groupBy("level").agg(F.count("*").alias("of")), "level")
    few = few.join(named, "node").select("node", "label", "root", "raw", "level", "of").toPandas()
    if not len(few):
        return 1.0
    shared = nodes.sparkSession.sparkContext.broadcast((matrix(few["raw"]), few["label"].to_numpy(), few["root"].to_numpy(), few["node"].to_numpy()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, label, root, node = shared.value
        links, found = np.zeros(len(node), dtype=np.int64), np.zeros(len(node), dtype=np.int64)
        for frame in frames:
            for at in range(0, len(frame), 1024):
                part = frame.iloc[at : at + 1024]
                near = (x @ matrix(part["raw"]).T >= threshold) & (label[:, None] == part["label"].to_numpy()[None, :]) & (node[:, None] != part["node"].to_numpy()[None, :])
                links += near.sum(1)
                found += (near & (root[:, None] == part["root"].to_numpy()[None, :])).sum(1)
        some = np.flatnonzero(links)
        yield pd.DataFrame({"node": node[some], "links": links[some], "found": found[some]})

    seen = named.select("node", "label", "root", "raw").mapInPandas(run, "node long, links long, found long").groupBy("node").agg(F.sum("links").alias("links"), F.sum("found").alias("found")).toPandas()
    if not len(seen):
        return 1.0
    seen = seen.merge(few[["node", "level", "of"]], on="node")
    weight = (seen["of"] / seen["level"].map(few["level"].value_counts())).to_numpy()
    kind = np.ceil(np.log2(seen["links"]) / 3).astype(int).to_numpy()
    share = (seen["found"] / seen["links"]).to_numpy()
    return min(float(np.average(share[kind == c], weights=weight[kind == c])) for c in np.unique(kind))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", max_rounds: int = 6, recall: float = 0.99, seed: int = 23, scratch: Scratch | None = None, exact: bool = False) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    exact: whatever recall the audit tells, all vectors of each label are compared at last, so that no link is lost; that work
    grows with the square of a label's vectors, in tiles of a bounded size.

    Vectors link if their labels are equal and not null and the cosine found reaches threshold. n_links counts
    other rows linked directly, component_id is the smallest vec_id that links reach, kept tells whether the
    row has it. Vectors that are null, zero or not finite, and those without id or label, link with nothing:
    they are components of their own. Equal vectors of a label are one node of the graph, weighed by their
    number. Vectors of different lengths don't link, whatever their labels.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "nn-descent")
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).cast("string").alias("label"))
    x = F.col("embedding").cast("array<float>")
    takes = takes_part(x) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = base.select("vec_id", F.when(takes, F.xxhash64("label", x)).alias("node"), F.concat_ws(":", F.size(x), "label").alias("label"), x.alias("x"))
    distinct = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("x").alias("x"))

    def to_bytes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop(columns="x").assign(raw=[np.asarray(v, "<f4").tobytes() for v in frame["x"]])

    nodes = scratch.cut(distinct.mapInPandas(to_bytes, "node long, first_id long, weight long, label string, raw binary"))
    graph = scratch.cut(kept_lists(first_graph(nodes, k, seed).withColumns({"fresh": F.lit(True), "new": F.lit(True)}), k, threshold, 0))
    round_ = 0
    while True:
        last = round_ + max_rounds
        while round_ < last:
            round_ += 1
            found = descend(graph, nodes, k, threshold).withColumns({"fresh": F.lit(True), "new": F.lit(True)})
            old = graph.select("u", "v", "score", F.expr("fresh and not drawn").alias("fresh"), F.lit(False).alias("new"))
            new = scratch.cut(kept_lists(old.unionByName(found), k, threshold, round_))
            scratch.drop(graph)
            graph = new
            # saturated nodes are compared exactly below: their links must not outweigh those of small components
            links = graph.where((F.col("score") >= threshold) & (F.col("worst") < threshold)).agg(F.count("*").alias("n"), F.count_if("new").alias("new")).first()
            if links.new <= 0.001 * links.n:
                break
        edges = graph.where(F.col("score") >= threshold).select("u", "v")
        roots = connected_components(edges, scratch)
        saturated = graph.where(F.col("worst") >= threshold).select(F.col("u").alias("node")).distinct()
        if not saturated.isEmpty():
            roots = joined_across(nodes, roots, saturated, threshold, scratch)
        if not exact and audit(nodes, roots, threshold) >= recall:
            break
        if exact or k >= 80:  # longer lists didn't help: all nodes of a label are compared
            roots = joined_across(nodes, roots, nodes, threshold, scratch)
            break
        k *= 2
        again = scratch.cut(graph.withColumns({"fresh": F.lit(True), "drawn": F.row_number().over(drawing(round_)) <= 2 * k}))
        scratch.drop(graph)
        graph = again
    members = roots.join(nodes.select("node", "first_id", "weight", "raw"), "node")
    counts = links_within(members, threshold)
    smallest = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = nodes.select("node", "first_id", "weight").join(roots, "node", "left").join(counts, "node", "left").join(smallest, "root", "left")
    known = known.select("node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    out = rows.select("vec_id", "node").join(known, "node", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
