"""SentencePiece encoding and decoding with N-best segmentations.

A text's piece lattice has an edge for each piece of the model's vocabulary, weighed by the model's
score, and one of byte pieces for each character that no piece covers. A forward Viterbi pass gives
the best score up to every position; a backward A* search that uses these scores as exact heuristics
yields the N best paths in order. Where two neighbouring characters stand together in no piece, every
path passes, so lattices fall apart there and are solved once per distinct chunk; the N best of the
whole text combine those of its chunks.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm.common import unused

SPACE, UNKNOWN_PENALTY, KEPT = "▁", 10.0, 256  # KEPT: longer chunks are rare, and not held
_MISS = object()
SEGMENTATIONS = "array<struct<score double, ids binary>>"


class Decoder:
    """The model's pieces alone."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.raw = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if model.is_byte(i)}

    def decode(self, ids: bytes) -> str:
        seq = np.frombuffer(ids, "<u2").tolist()
        if not seq:
            return ""
        if self.raw.keys().isdisjoint(seq):
            text = "".join([self.pieces[i] for i in seq])
        else:
            raw, pieces = self.raw, self.pieces
            text = b"".join([bytes((raw[i],)) if i in raw else pieces[i].encode() for i in seq]).decode("utf-8", "replace")
        return text.replace(SPACE, " ").removeprefix(" ")


class Lattice:
    """The model's pieces, and the segmentations of chunks. Ids are little-endian unsigned 16-bit integers."""

    def __init__(self, model_file: str, most_chunks: int = 400_000, most_ids: int = 16_000_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        assert size <= 1 << 16
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.code = [i.to_bytes(2, "little") for i in range(size)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.table: dict = {}
        self.together: set[str] = set()
        for i in plain:
            p = self.pieces[i]
            for k in range(1, len(p)):
                self.table.setdefault(p[:k], None)
                self.together.add(p[k - 1 : k + 1])
        for i in plain:
            self.table[self.pieces[i]] = (i, model.get_score(i))
        self.trie: dict = {}  # character -> (the next characters' entries, the piece that ends here and its score, or None)
        for p in sorted(self.table, key=len):
            at = self.trie
            for c in p[:-1]:
                at = at[c][0]
            at[p[-1]] = ({}, *(self.table[p] or (None, None)))
        self.single = {p for p in self.table if len(p) == 1 and self.table[p]}
        self.longest = max(len(self.pieces[i]) for i in plain)
        self.unknown = min(model.get_score(i) for i in plain if model.get_score(i) > -1e8) - UNKNOWN_PENALTY
        self.marked = sorted(p for p in self.together if p[1] in ".,")  # where a comma or full stop isn't cut off
        # whether every space and newline cuts: a piece holds no newline, and a space mark only at its start or after another
        self.cuts = not any("\n" in p or p[1] == SPACE and p[0] != SPACE for p in self.together) and "\n" not in self.table
        self.lists: dict = {}
        self.most_chunks, self.most_ids = most_chunks, most_ids
        self._clear()

    def _clear(self) -> None:
        """Of each chunk seen: its best segmentation's score and ids, and how much worse the second one is."""
        self.slot: dict[str, int] = {}
        self.scores, self.gaps, self.starts, self.counts, self.ids = (np.zeros(0, t) for t in (float, float, np.int64, np.int64, "<u2"))

    def _slots(self, chunks: list[str]) -> np.ndarray:
        """Places of distinct chunks in scores, gaps, starts and counts; those not seen before are solved."""
        got = [*map(self.slot.get, chunks)]
        missing = [c for c, g in zip(chunks, got) if g is None]
        if not missing:
            return np.array(got, np.int64)
        if len(self.slot) + len(missing) > self.most_chunks or len(self.ids) > self.most_ids:
            self._clear()
            missing = chunks
        scores, ids, gaps = zip(*map(self.best, missing))
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        self.slot.update(zip(missing, range(len(self.starts), len(self.starts) + len(missing))))
        self.scores, self.gaps = np.append(self.scores, scores), np.append(self.gaps, gaps)
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(counts) - counts)
        self.counts = np.append(self.counts, counts)
        self.ids = np.append(self.ids, np.frombuffer(b"".join(ids), "<u2"))
        return np.fromiter(map(self.slot.__getitem__, chunks), np.int64, len(chunks))

    def edge(self, chunk: str, i: int) -> tuple[bytes, float]:
        """The byte pieces of a character that no piece covers."""
        return b"".join(self.code[self.bytes.get(b, 0)] for b in chunk[i].encode("utf-8", "replace")), self.unknown

    def forward(self, chunk: str) -> tuple[list[float], list[float], list[int], list]:
        """By end position: the best score, the second best, and the best path's last step, its start and its piece (or ids)."""
        n, low, trie, longest, single = len(chunk), float("-inf"), self.trie, self.longest, self.single
        first, second, start, piece = [low] * (n + 1), [low] * (n + 1), [0] * (n + 1), [None] * (n + 1)
        first[0] = 0.0
        for i in range(n):
            x, y, at, j = first[i], second[i], trie, i
            for c in chunk[i : i + longest]:
                got = at.get(c)
                if got is None:
                    break
                at, own, s = got
                j += 1
                if s is not None:
                    v, w = x + s, first[j]
                    if v > w:
                        first[j], start[j], piece[j] = v, i, own
                        v = y + s
                        second[j] = w if w > v else v
                    elif v > second[j]:
                        second[j] = v
            if chunk[i] not in single:
                own, s = self.edge(chunk, i)
                v, j = x + s, i + 1
                if v > first[j]:
                    second[j] = max(first[j], y + s)
                    first[j], start[j], piece[j] = v, i, own
                elif v > second[j]:
                    second[j] = v
        return first, second, start, piece

    def nbest(self, chunk: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations, best first: A* from the end, with the forward scores as heuristics.

        Of equally good paths the one nearest to the start goes first, and a position is left at most n times: its
        first n visits are its n best rests, as the heuristics are exact. So a long run of ties takes no more than
        n * length * longest steps. A path is a chain of its pieces; ids are joined for the n results alone."""
        if (kept := self.lists.get((chunk, n))) is not None:
            return kept
        first = self.forward(chunk)[0]
        heap, out, count, left = [(-first[-1], len(chunk), 0, 0.0, None)], [], 0, [0] * (len(chunk) + 1)
        while heap and len(out) < n:
            _, j, _, tail, path = heapq.heappop(heap)
            if left[j] == n:
                continue
            left[j] += 1
            if j == 0:
                ids = []
                while path:
                    own, path = path
                    ids.append(own)
                out.append((tail, b"".join(ids)))
                continue
            steps = [] if chunk[j - 1] in self.single else [(j - 1, *self.edge(chunk, j - 1))]
            for i in range(max(0, j - self.longest), j):
                p = self.table.get(chunk[i:j])
                if p is not None:
                    steps.append((i, self.code[p[0]], p[1]))
            for i, own, s in steps:
                count += 1
                heapq.heappush(heap, (-(tail + s + first[i]), i, count, tail + s, (own, path)))
        if len(chunk) <= KEPT:
            if len(self.lists) >= 20_000:
                self.lists.clear()
            self.lists[chunk, n] = out
        return out

    def best(self, chunk: str) -> tuple[float, bytes, float]:
        """Score and ids of the best segmentation, and how much worse the second one is."""
        first, second, start, piece = self.forward(chunk)
        j, parts = len(chunk), []
        while j:
            own = piece[j]
            parts.append(own if isinstance(own, bytes) else self.code[own])
            j = start[j]
        return first[-1], b"".join(reversed(parts)), first[-1] - second[-1]

    def chunks(self, text: str) -> list[str]:
        """The text with its leading space, cut where no piece reaches across."""
        if not text:
            return []
        full, at, out = SPACE + text.replace(" ", SPACE), 0, []
        for k in range(1, len(full)):
            if full[k - 1 : k + 1] not in self.together:
                out.append(full[at:k])
                at = k
        return [*out, full[at:]]

    def _cut(self, texts: pa.Array) -> pa.Array:
        """The chunks of many texts. Where each space is single, and no comma or full stop stands in a pair of marked,
        cuts are at spaces, newlines, and before commas and full stops that end a word."""
        odd = pc.equal(pc.binary_length(texts), 0)
        for some in (pc.match_substring(texts, SPACE), pc.match_substring(texts, "  "), pc.starts_with(texts, " "), pc.match_substring_regex(texts, "|".join(map(re.escape, self.marked)) or r"\z\A.")):
            odd = pc.or_(odd, some)
        if not self.cuts or pc.all(odd).as_py():
            return pa.array(map(self.chunks, texts.to_pylist()), pa.list_(pa.string()))
        cut = pc.binary_join_element_wise(SPACE, pc.replace_substring(texts, " ", " " + SPACE), "")
        for old, new in (("\n", " \n "), (", ", " , "), (". ", " . ")):
            cut = pc.replace_substring(cut, old, new)
        out = pc.split_pattern(cut, " ")
        if pc.any(odd).as_py():
            rows, own = out.to_pylist(), odd.to_pylist()
            out = pa.array([self.chunks(t) if o else r for t, o, r in zip(texts.to_pylist(), own, rows)], pa.list_(pa.string()))
        return out

    def segment(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The text's n best segmentations, or all there are, best first."""
        return next(self.segment_all(pa.array([text], pa.string()), n))

    def segment_all(self, texts: pa.Array, n: int) -> Iterator[list[tuple[float, bytes]]]:
        """The n best segmentations of each text. Arrow cuts the texts and numbers their chunks, each distinct chunk is
        solved once, and a text's ids are those of its chunks in a row."""
        cut = self._cut(texts)
        each = cut.flatten().dictionary_encode()
        codes, names = each.indices.to_numpy(), each.dictionary
        slots = self._slots(names.to_pylist())[codes]
        gaps, counts = self.gaps[slots], self.counts[slots]
        ends = np.append(0, np.cumsum(counts))
        raw = self.ids[np.repeat(self.starts[slots] - ends[:-1], counts) + np.arange(ends[-1])].tobytes()
        begin = 0
        for length in pc.list_value_length(cut).to_pylist():
            stop = begin + length
            score, own = float(self.scores[slots[begin:stop]].sum()), gaps[begin:stop]
            # a chunk outside the n - 1 smallest gaps is at its best in all of the n best
            close = np.argpartition(own, n - 2)[: n - 1] if 1 < n <= length else np.arange(length if n > 1 else 0)
            close = sorted(begin + k for k in close.tolist() if own[k] < np.inf)
            options = [self.nbest(names[codes[k]].as_py(), n) for k in close]
            edges = [2 * ends[begin], *(2 * x for k in close for x in (ends[k], ends[k + 1])), 2 * ends[stop]]
            between = [raw[a:b] for a, b in zip(edges[::2], edges[1::2])]
            yield combined(score, between, options, n)
            begin = stop


def combined(score: float, between: list[bytes], options: list[list[tuple[float, bytes]]], n: int) -> list[tuple[float, bytes]]:
    """The n best of all choices of one option each, best first; between are the ids around the places of choice."""

    def joined(pick: tuple[int, ...]) -> bytes:
        return b"".join([x for left, o, k in zip(between, options, pick) for x in (left, o[k][1])] + between[-1:])

    out, heap, seen = [], [(0.0, (0,) * len(options))], {(0,) * len(options)}
    while heap and len(out) < n:
        loss, pick = heapq.heappop(heap)
        out.append((score - loss, joined(pick)))
        for d, o in enumerate(options):
            if pick[d] + 1 < len(o) and (more := (*pick[:d], pick[d] + 1, *pick[d + 1 :])) not in seen:
                seen.add(more)
                heapq.heappush(heap, (loss + o[pick[d]][0] - o[pick[d] + 1][0], more))
    return out


_lattices: dict[str, Lattice] = {}
_decoders: dict[str, Decoder] = {}


def lattice(model_file: str) -> Lattice:
    """One lattice, with its cache, for each Python worker."""
    if model_file not in _lattices:
        _lattices[model_file] = Lattice(model_file)
    return _lattices[model_file]


def decoder(model_file: str) -> Decoder:
    if model_file not in _decoders:
        _decoders[model_file] = Decoder(model_file)
    return _decoders[model_file]


def encode(docs: DataFrame, model_file: str, n: int = 4, text: str = "text", into: str = "segmentations", decoded: str | None = None) -> DataFrame:
    """All columns of docs and into: the whole text's n best segmentations, best first, with scores; with decoded,
    also a column of that name with the text that the best segmentation's ids decode to.

    A null or empty text has one segmentation, without ids. Rows are kept as they are. A column of docs named
    as into or decoded is replaced."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = lattice(model_file)
        back = decoder(model_file) if decoded else None
        for part in texts:
            sizes = np.cumsum(part.str.len().to_numpy())
            at = 0
            while at < len(part):
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 4_000_000, "right")))
                coded = model.segment_all(pa.array(part.iloc[at:stop], pa.string()), n)
                while got := list(itertools.islice(coded, 128)):
                    out = pd.DataFrame({"coded": [[{"score": s, "ids": ids} for s, ids in g] for g in got]})
                    out["back"] = [back.decode(g[0][1]) for g in got] if back else None
                    yield out
                at = stop

    both, coded = F.pandas_udf(run, f"coded {SEGMENTATIONS}, back string")(F.coalesce(F.col(f"`{text}`"), F.lit(""))), unused(docs, "coded")
    out = docs.select("*", both.alias(coded)).withColumn(into, F.col(f"{coded}.coded"))
    return (out.withColumn(decoded, F.col(f"{coded}.back")) if decoded else out).drop(coded)


def decode(docs: DataFrame, model_file: str, ids: str, into: str = "decoded") -> DataFrame:
    """All columns of docs and into: the text of a column of ids (null: empty)."""

    def run(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = decoder(model_file)
        for part in column:
            for at in range(0, len(part), 256):
                yield pd.Series([model.decode(x or b"") for x in part.iloc[at : at + 256]], dtype=object)

    return docs.withColumn(into, F.pandas_udf(run, "string")(F.expr(ids)))
