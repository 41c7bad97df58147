"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its lower-case words' five-word shingles, each labelled with its number of
earlier occurrences. Each of SKETCHES hash functions picks the MINIMA smallest labelled shingles and
hashes them in text order, so two texts agree on a sketch only if they share shingles in the same
order. Texts that agree on a sketch are candidates; an alignment of their shingle sequences, within
the band outside which no good enough alignment can run, decides:
similarity = aligned / (shingles of both - aligned) >= 0.8.

At similarity 0.8 a candidate pair of long texts is missed with a probability of about (1 - 0.8**3)**16 =
1e-5. The minima are drawn without replacement, so short texts are missed more often: two texts with 4 of
5 shingles in common agree on a sketch with C(4,3)/C(5,3) = 0.4, and are missed with 0.6**16 = 2.8e-4.

Classes are found without pairing all texts of a bucket. In leader rounds, every text of a bucket that
still holds several classes meets one new leader of it. A round goes on to the next one only if it has
settled a tenth of what it got, so all rounds together make at most ten comparisons for each place
in a bucket. What is left passes an exact filter by rare shingles, linear in its words, then rounds again,
and only texts that nothing tells apart are compared in tiles.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlens.llm.common import Scratch, by_group, connected_components

SHINGLE, SIMILARITY, SKETCHES, MINIMA = 5, 0.8, 16, 3
TILE, TILE_SHINGLES, COUNTERS, SETTLED = 1024, 500_000, 1 << 17, 0.1
TOP = np.uint64(2**64 - 1)
_WORD = re.compile(r"\w+")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' shingle hashes in order, and how many each text has. A text of one to four words has one
    shingle, of all its words; a text without words has none."""
    words = [_WORD.findall(t.lower()) for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.empty(n.sum(), dtype=object)
    flat[:] = [x for w in words for x in w]
    h = pd.util.hash_array(flat, categorize=True) if len(flat) else np.zeros(0, np.uint64)
    count = np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1))
    first = np.repeat(np.cumsum(n) - n, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    width = np.repeat(np.minimum(n, SHINGLE), count)
    out = np.full(len(first), 0x2545F4914F6CDD1D, dtype=np.uint64)
    padded = np.append(h, np.zeros(SHINGLE, np.uint64))
    for i in range(SHINGLE):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.where(width > i, padded[first + i], np.uint64(i)))
    return out, count


def sketch_keys(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A row of SKETCHES keys for each text that has shingles."""
    n = count[count > 0]
    if not len(n):
        return np.zeros((0, SKETCHES), np.int64)
    starts = np.cumsum(n) - n
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, text))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    at = np.arange(len(h))
    earlier = np.empty(len(h), np.uint64)
    earlier[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    label = _mixed(h + earlier * np.uint64(0xD6E8FEB86659FD93))
    keys = np.empty((len(n), SKETCHES), np.uint64)
    for j in range(SKETCHES):
        x = _mixed(label ^ np.uint64((0xA0761D6478BD642F * (2 * j + 1)) & (2**64 - 1)))
        picked = np.empty((MINIMA, len(n)), np.int64)
        for k in range(MINIMA):
            least = np.minimum.reduceat(x, starts)
            hits = np.flatnonzero(x == np.repeat(least, n))
            picked[k] = hits[np.searchsorted(hits, starts)]  # the first of each text
            picked[k][n <= k] = -1
            x[picked[k][n > k]] = TOP
        picked.sort(axis=0)
        key = np.full(len(n), j + 1, np.uint64)
        for k in range(MINIMA):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.where(picked[k] < 0, np.uint64(0), label[picked[k]]))
        keys[:, j] = key
    return keys.view(np.int64)


def _slices(texts: pd.Series, chars: int = 2_000_000) -> Iterator[slice]:
    """Consecutive slices of some chars characters: what bounds the memory of a batch."""
    start = size = 0
    for i, n in enumerate(texts.str.len()):
        if size and size + n > chars:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def _sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part in _slices(frame["text"]):
            sub = frame.iloc[part]
            h, count = shingle_hashes(sub["text"].tolist())
            keys = iter(sketch_keys(h, count))
            yield pd.DataFrame({"doc_id": sub["doc_id"], "fp": sub["fp"], "n": count, "keys": [next(keys) if c else [] for c in count]})


def _to_shingles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part in _slices(frame["text"]):
            sub = frame.iloc[part]
            h, count = shingle_hashes(sub["text"].tolist())
            ends = np.cumsum(count)
            yield pd.DataFrame({"fp": sub["fp"], "shingles": [h[e - c : e].tobytes() for c, e in zip(count, ends)]})


def aligned(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence whose matches stay within band of the diagonal.

    A column of the table is one integer of the rows within the band, so that a step handles them all at once
    and costs 2 * band + 1 bits. A row that the band leaves is settled: its bit is 0 if it counts."""
    places: dict[int, list[int]] = {}
    for i, s in enumerate(a):
        places.setdefault(s, []).append(i)
    many = max(16, len(a) // 2000)  # from here on a shingle's places are one integer, too
    wide = {s: sum(1 << i for i in at) for s, at in places.items() if len(at) > many}
    width, low, got = min(len(a), band + 1), 0, 0
    v = (1 << width) - 1
    for j, s in enumerate(b):
        if j:
            if j > band and low < len(a):
                got += not v & 1
                v >>= 1
                low, width = low + 1, width - 1
            if low + width < len(a):
                v |= 1 << width
                width += 1
        if not width:
            break
        if s in wide:
            m = (wide[s] >> low) & ((1 << width) - 1)
        else:
            m = 0
            for i in places.get(s, ()):
                if low <= i < low + width:
                    m |= 1 << i - low
        if m and (u := v & m):
            v = ((v + u) | (v - u)) & ((1 << width) - 1)
    return got + width - v.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """The similarity of two shingle sequences, 0 if it is below least."""
    need = int(np.ceil(least / (1 + least) * (len(a) + len(b)) - 1e-9))
    if not len(a) or not len(b) or min(len(a), len(b)) < need:
        return 0.0
    if len(np.intersect1d(a, b)) + min(len(a) - len(np.unique(a)), len(b) - len(np.unique(b))) < need:
        return 0.0
    short = min(len(a), len(b))
    same = a[:short] == b[:short]
    head = short if same.all() else int(same.argmin())
    same = a[len(a) - short + head :][::-1] == b[len(b) - short + head :][::-1]
    tail = len(same) if same.all() else int(same.argmin())
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    got = head + tail + (aligned(x.tolist(), y.tolist(), max(len(a), len(b)) - need) if len(x) and len(y) else 0)
    score = got / (len(a) + len(b) - got)
    return score if score >= least - 1e-12 else 0.0


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        linked = [similarity(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) > 0 for a, b in zip(frame["a"], frame["b"])]
        yield frame.loc[linked, ["ru", "rv"]]


def _labelled(h: np.ndarray) -> np.ndarray:
    """One text's shingles, told apart by their numbers of earlier occurrences."""
    order = np.argsort(h, kind="stable")
    at = np.arange(len(h))
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[order][1:] != h[order][:-1]
    earlier = np.empty(len(h), np.uint64)
    earlier[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return _mixed(h + earlier * np.uint64(0xD6E8FEB86659FD93))


def _counters(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(COUNTERS, np.int64)
    for frame in frames:
        for s in frame["shingles"]:
            np.add.at(total, (_labelled(np.frombuffer(s, np.uint64)) % COUNTERS).astype(np.int64), 1)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"counter": at, "n": total[at]})


def tell_apart(rest: DataFrame, shingles: DataFrame, scratch: Scratch) -> DataFrame:
    """Those texts (fp) of rest (fp, root, n) that may be linked with a text of another class: an exact filter.

    All labelled shingles are put in one order, rare ones first. Two texts of n and m shingles are linked only
    if they share 4/9 (n + m) of them; then the first that they share stands at a place i with n - i >= 4/9
    (n + m), hence among the first n / 5 + 1 of a text, and m <= 9/4 (n - i) - n. A text stays if it has such
    a shingle that a short enough text of another class has, too. How rare a shingle is comes from COUNTERS
    counters (any order is exact, a good one tells more apart)."""
    texts = scratch.cut(rest.join(shingles, "fp"))
    counts = texts.select("shingles").mapInPandas(_counters, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    rare = np.zeros(COUNTERS, np.int64)
    rare[counts["counter"].to_numpy()] = counts["n"].to_numpy()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for fp, root, n, s in zip(frame["fp"], frame["root"], frame["n"], frame["shingles"]):
                token = _labelled(np.frombuffer(s, np.uint64))
                order = np.lexsort((token, rare[(token % COUNTERS).astype(np.int64)]))
                token = token[order[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1]]
                most = (n - np.arange(len(token))) * ((1 + SIMILARITY) / SIMILARITY) - n + 1e-6
                yield pd.DataFrame({"fp": [fp] * len(token), "root": [root] * len(token), "n": n, "token": token.view(np.int64), "most": most})

    rows = scratch.cut(texts.mapInPandas(run, "fp binary, root binary, n long, token long, most double"))
    each = rows.groupBy("token", "root").agg(F.min("n").alias("n"))
    two = each.withColumn("k", F.row_number().over(Window.partitionBy("token").orderBy("n", "root"))).where("k <= 2")
    two = two.groupBy("token").agg(F.min(F.struct("k", "root", "n")).alias("one"), F.max(F.struct("k", "root", "n")).alias("other")).where("one.k < other.k")
    near = rows.join(scratch.cut(two), "token").where("if(one.root <> root, one.n, other.n) <= most")
    return scratch.cut(near.select("fp").distinct())


def common_shingles(seqs: list[np.ndarray]) -> np.ndarray:
    """How many shingles, repeats counted, each two sequences share: an upper bound of what can be aligned."""
    n = np.array([len(s) for s in seqs])
    flat, owner = np.unique(np.concatenate(seqs), return_inverse=True)[1].astype(np.uint64), np.repeat(np.arange(len(seqs)), n)
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    at = np.arange(len(flat))
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    flat = (flat << np.uint64(24)) | (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = (np.cumsum(shared) - 1)[place]
    keep = shared[place]
    owner, column = owner[keep], column[keep]
    out = np.zeros((len(seqs), len(seqs)), np.float32)
    for first in range(0, int(shared.sum()), 16384):
        some = (column >= first) & (column < first + 16384)
        m = np.zeros((len(seqs), min(16384, int(shared.sum()) - first)), np.float32)
        m[owner[some], column[some] - first] = 1
        out += m @ m.T
    return out


def tile_links(g: pd.DataFrame) -> pd.DataFrame | None:
    """Links that connect what a pair of tiles of one bucket holds and isn't connected yet.

    Pairs that an earlier sketch already brings together, or of one class, are left out; of the others, those
    whose common shingles allow it are aligned, unless links found before connect them."""
    ta, tb, key = g["ta"].iloc[0], g["tb"].iloc[0], g["key"].iloc[0]
    g = g.sort_values("fp", kind="stable")
    tile, roots, n = g["tile"].to_numpy(), g["root"].to_numpy(), g["n"].to_numpy()
    keys = np.stack(g["keys"].to_numpy())
    own = int(np.flatnonzero(keys[0] == key)[0])
    codes = pd.factorize(roots)[0]
    todo = (tile[:, None] == ta) & (tile[None, :] == tb) if ta != tb else np.triu(np.ones((len(g), len(g)), bool), 1)
    todo &= codes[:, None] != codes[None, :]
    todo &= np.minimum(n[:, None], n[None, :]) >= SIMILARITY * np.maximum(n[:, None], n[None, :]) - 1e-9
    for j in range(own):
        todo &= keys[:, j][:, None] != keys[:, j][None, :]
    if not todo.any():
        return None
    seqs = [np.frombuffer(s, np.uint64) for s in g["shingles"]]
    need = np.ceil(SIMILARITY / (1 + SIMILARITY) * (n[:, None] + n[None, :]) - 1e-9)
    todo &= common_shingles(seqs) >= need
    parent = list(range(len(g)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[int, int] = {}
    for i, c in enumerate(codes):
        parent[i] = first.setdefault(c, i)
    out = []
    for i, j in zip(*np.nonzero(todo)):
        a, b = find(i), find(j)
        if a != b and similarity(seqs[i], seqs[j]):
            parent[b] = a
            out.append((roots[i], roots[j]))
    return pd.DataFrame(out, columns=["ru", "rv"]) if out else None


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fp (its content's address), class_id, class_size, kept.

    A class holds the documents that links of verified similarity connect; class_id is its smallest
    key, kept tells whether the row has it. Equal texts are one node from the start and are never paired.
    Null and empty texts have no copies: each is a class of its own. Texts without words match equal
    texts only. A class whose keys are all null has class_id null. Repeated rows come out as often as in.

    A bucket's leaders are its texts in the order of the sizes of all buckets that a text is in: texts that
    share most with others come first. See the module's text for the rounds, and tell_apart for what follows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "order-minhash")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("fp", F.unhex(F.md5("text")))
    sketched = scratch.cut(rows.mapInPandas(_sketch, "doc_id long, fp binary, n long, keys array<long>"))
    nodes = sketched.where("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    flat = nodes.select("fp", "n", F.explode("keys").alias("key"))
    sizes = scratch.cut(flat.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    sized = flat.join(sizes, "key").groupBy("fp").agg(F.sum("size").alias("weight"), F.first("n").alias("n"), F.collect_list("key").alias("shared"))
    rest = sized.select(F.explode("shared").alias("key"), "fp", "n", "weight", F.col("fp").alias("root"), F.lit(None).cast("struct<weight: bigint, fp: binary>").alias("last"))
    rest = scratch.cut(rest)

    texts = rows.select("fp", "text").join(rest.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.first("text").alias("text"))
    shingles = scratch.cut(texts.mapInPandas(_to_shingles, "fp binary, shingles binary"))

    def renamed(frame: DataFrame, names: DataFrame) -> DataFrame:
        return frame.join(names.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new")

    found: list[DataFrame] = []

    def rounds(rest: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The places and the keys of buckets that leaders leave with several classes."""
        before = None
        while True:
            place = F.struct("weight", "fp")
            lead = F.max(F.when(F.col("last").isNull() | (place < F.col("last")), F.struct("weight", "fp", "root")))
            mixed = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"), F.sum("n").alias("words"), lead.alias("lead"))
            mixed = scratch.cut(mixed.where("low <> high and lead is not null").select("key", "members", "words", "lead"))
            places = mixed.agg(F.sum("members")).first()[0] or 0
            if not places or before and places > before * (1 - SETTLED):
                return rest, mixed if places else None
            before = places
            rest = rest.drop("last").join(mixed.select("key", "lead"), "key")
            pairs = rest.where("root <> lead.root").select(F.col("fp").alias("u"), F.col("lead.fp").alias("v"), F.col("root").alias("ru"), F.col("lead.root").alias("rv")).distinct()
            both = pairs.join(shingles.select(F.col("fp").alias("u"), F.col("shingles").alias("a")), "u").join(shingles.select(F.col("fp").alias("v"), F.col("shingles").alias("b")), "v")
            links = scratch.cut(both.mapInPandas(_verify, "ru binary, rv binary"))
            # one round of the components joins a leader's star; what it doesn't join stays apart until the end
            names = scratch.cut(connected_components(links, scratch, "ru", "rv", rounds=1))
            found.extend([links, names.select(F.col("node").alias("ru"), F.col("root").alias("rv"))])
            rest = scratch.cut(renamed(rest.select("key", "fp", "n", "weight", "root", F.struct("lead.weight", "lead.fp").alias("last")), names))

    rest, mixed = rounds(rest)
    if mixed is not None:
        left = scratch.cut(rest.join(mixed.select("key"), "key", "left_semi"))
        rest, mixed = rounds(scratch.cut(left.join(tell_apart(left.select("fp", "root", "n").distinct(), shingles, scratch), "fp", "left_semi")))
    if mixed is not None:
        tiles = F.expr(f"cast(ceil(greatest(members / {TILE}, words / {TILE_SHINGLES})) as int)")
        left = rest.select("key", "fp", "root").join(mixed.select("key", tiles.alias("tiles")), "key")
        left = left.withColumns({"tile": F.expr("cast(pmod(xxhash64(fp), tiles) as int)"), "other": F.explode(F.expr("sequence(0, tiles - 1)"))})
        left = left.select("key", "fp", "root", "tile", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb")).join(nodes, "fp").join(shingles, "fp")
        links = by_group(left.withColumn("pair", F.xxhash64("key", "ta", "tb")), "pair", tile_links, "ru binary, rv binary")
        found.append(scratch.cut(links))

    ids = sketched.select("doc_id", "fp", "n", F.when(F.col("fp") != F.unhex(F.md5(F.lit(""))), F.col("fp")).alias("root"))
    if found:
        ids = renamed(ids, connected_components(functools.reduce(DataFrame.unionByName, found), scratch, "ru", "rv"))
    ids = scratch.cut(ids)
    sizes = scratch.cut(ids.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    out = ids.join(sizes, "root", "left")
    return out.select("doc_id", "fp", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
