"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links. A node's failure link leads to where matching goes on once
the longest pieces that end within the node's string are popped; how many pieces those are is computed
ahead. A word's greedy longest-match length is then one walk over its characters, adding counts, and no
piece is ever built.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm.common import unused

_TOKEN = re.compile(r"\w+|[^\w\s]")


class Automaton:
    """first: pieces that start a word; inner: pieces that go on within one. Node 0 starts words, node 1 their rest."""

    def __init__(self, first: set[str], inner: set[str], cache: int = 400_000):
        self.next: list[dict[str, int]] = [{}, {}]
        piece, depth = [False, False], [0, 0]
        for root, words in ((0, first), (1, inner)):
            for w in words:
                at = root
                for c in w:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                        depth.append(depth[at] + 1)
                    at = self.next[at][c]
                if w:
                    piece[at] = True
        #: Failure link (-1: no segmentation) and the number of pieces popped on the way.
        self.link, self.popped = [-1] * len(self.next), [0] * len(self.next)
        level = [0, 1]
        while level:
            after = []
            for at in level:
                for c, to in self.next[at].items():
                    if piece[to]:
                        self.link[to], self.popped[to] = 1, 1
                    else:
                        z, n = self.link[at], self.popped[at]
                        while z >= 0 and c not in self.next[z]:
                            n += self.popped[z]
                            z = self.link[z]
                        if z >= 0:
                            self.link[to], self.popped[to] = self.next[z][c], n
                    after.append(to)
            level = after
        self.cap, self.new, self.old = cache, {}, {}

    def count(self, word: str) -> int:
        """Pieces of the greedy longest-match segmentation of a word; 1, an unknown token, if there is none."""
        at, n, next_, link, popped = 0, 0, self.next, self.link, self.popped
        for c in word:
            while (to := next_[at].get(c)) is None:
                n += popped[at]
                at = link[at]
                if at < 0:
                    return 1
            at = to
        while at != 1:
            n += popped[at]
            at = link[at]
            if at < 0:
                return 1
        return n

    def total(self, words: list[str]) -> int:
        """Pieces of all words; counts of words that came before are kept, up to a bound."""
        try:
            return sum(map(self.new.__getitem__, words))
        except KeyError:
            pass
        if len(self.new) >= self.cap:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        for w in words:
            if w not in new:
                got = old.get(w)
                new[w] = self.count(w) if got is None else got
        return sum(map(new.__getitem__, words))


def vocabulary(model_file: str) -> tuple[set[str], set[str]]:
    """Pieces of a SentencePiece file: those with a leading space start words, the others go on in them.
    Single characters do both, so a punctuation mark that stands alone is no unknown word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    first, inner = set(), set()
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
            continue
        if p.startswith("▁"):
            first.add(p[1:])
        else:
            inner.add(p)
            if len(p) == 1:
                first.add(p)
    return {p for p in first if p and "▁" not in p}, {p for p in inner if "▁" not in p}


_automata: dict[str, Automaton] = {}


def automaton(model_file: str) -> Automaton:
    """One automaton for each Python worker."""
    if model_file not in _automata:
        _automata[model_file] = Automaton(*vocabulary(model_file))
    return _automata[model_file]


def count_tokens(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """All columns of docs with n_words and n_tokens of the whole text. Words are runs of word characters and
    single other characters; null and empty texts have none of either. Rows are kept as they are."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = automaton(model_file)
        for part in texts:
            out = []
            for t in part:
                words = _TOKEN.findall(t or "")
                out.append((len(words), model.total(words)))
            yield pd.DataFrame(out, columns=["n_words", "n_tokens"])

    counted = F.pandas_udf(run, "n_words long, n_tokens long")(F.coalesce(F.col(text), F.lit("")))
    own = unused(docs, "counts")
    return docs.withColumn(own, counted).withColumns({"n_words": F.col(f"{own}.n_words"), "n_tokens": F.col(f"{own}.n_tokens")}).drop(own)
