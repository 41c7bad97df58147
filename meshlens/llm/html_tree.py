"""Main text of web pages by a tree-structured graphical model.

A page's block elements and text blocks are the nodes of a tree. Each has a hidden label (content or not),
a potential of its own from what can be seen of it, and a potential with its parent. Sum-product
messages, first upward from the leaves and then downward from the root, give every node's marginal;
text blocks whose marginal reaches one half are the main text. Both kinds of potentials are fitted on
labelled pages: a logistic regression for the nodes' own, counts of (parent, child) labels for the pairs.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# As HTML's tokenizer has it: a quote opens a value right after an equals sign only, elsewhere it is a character like any other; a
# comment ends at --> or --!>, and at once where > or -> begins it; a tag that nothing ends goes to the page's end.
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?![\"'])))*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|style|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PART = re.compile(r"[a-z]+")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "iframe")}
#: Elements whose content isn't the page's text, from their start tag to their own end tag. Where another element ends them, as an
#: end tag is missing, what they held counts like any other text.
HIDDEN = frozenset("noscript template svg select button object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "head", "html", "body", "legend", "summary"}
#: Open elements that a start tag of these ends, up to the nearest of the second set.
SIBLING = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, {"html"})}

TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "li", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "figcaption", "body", "head", "dialog", "address", "fieldset", "menu", "dl", "dd", "dt")
#: Parts of class, id and role names that carry a weight of their own; a name part that begins so counts.
NAMES = ("article", "contentinfo", "complementary", "primary", "secondary", "content", "post", "story", "entry", "main", "text", "body", "nav", "menu", "bread", "head", "foot", "side", "widget", "notice", "cookie", "consent", "banner", "ad", "advert", "sponsor", "promo", "form", "search", "login", "newsletter", "subscribe", "comment", "repl", "discuss", "share", "social", "related", "recommend", "popup", "modal", "alert", "hidden", "copyright", "meta", "tag", "toolbar", "pager")


@dataclass
class Page:
    """The tree in page order: parents come before their children. text is None for elements."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[frozenset] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, names: frozenset, text: str | None = None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


_known_names: dict[str, frozenset] = {}


def _names(attrs: str) -> frozenset:
    if "=" not in attrs and "hidden" not in attrs.lower():
        return frozenset()
    got = _known_names.get(attrs)
    if got is None:
        found = set()
        for name, value in _ATTR.findall(attrs):
            if name.lower() == "hidden" or name.lower() == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                found.add("hidden")
            elif name.lower() != "style":
                parts = _PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
                for p in parts:
                    fits = [n for n in NAMES if (p == n or p == n + "s" if len(n) < 3 else p.startswith(n))]
                    found |= {max(fits, key=len)} if fits else set()
        got = frozenset(found)
        if len(_known_names) < 50_000:
            _known_names[attrs] = got
    return got


def parse(source: str) -> Page:
    """Block elements and text blocks of a page. Tags that are never closed, closed twice or nested wrongly
    are taken as browsers take them, roughly; nothing raises."""
    page = Page()
    root = page.add(-1, "html", frozenset())
    stack: list[tuple[str, int]] = [("html", root)]  # tag, node of the nearest block
    run: list[str] = []
    links = linked = 0
    before: list[tuple[int, int, list[str], int, int]] = []  # of open hidden elements: place in the stack; nodes, text and its length, linked

    def flush() -> None:
        nonlocal linked, run
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                node = stack[-1][1]
                page.add(node, page.tag[node], frozenset(), text, linked)
            run = []  # the old list stays as it is in before
        linked = 0

    def close(k: int) -> None:
        """Ends all open elements from the k-th on."""
        nonlocal links
        if any(t in BLOCK for t, _ in stack[k:]):
            flush()
        links -= sum(t == "a" for t, _ in stack[k:])
        del stack[k:]
        while before and before[-1][0] >= k:
            before.pop()

    def hide(k: int) -> None:
        """Ends the hidden element at k, and drops all that came since its start tag."""
        nonlocal run, linked
        place, nodes, text, length, linked_then = next(b for b in reversed(before) if b[0] == k)
        close(k)
        for column in (page.parent, page.tag, page.names, page.text, page.linked):
            del column[nodes:]
        run, linked = text, linked_then
        del run[length:]
        run.append(" ")

    def inside(tags: set, stop: set) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in stop:
                break
        return 0

    at, m = 0, _MARKUP.search(source)
    while m:
        if m.start() > at:
            run.append(source[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        if m["cdata"] is not None:
            run.append(html.escape(m["cdata"]))
        elif m["tag"]:
            tag = m["tag"].lower()
            if m["end"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        hide(k) if tag in HIDDEN else close(k)
                        break
                    if stack[k][0] in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "td", "th", "body", "html"):
                        break
                else:
                    if tag in BLOCK:
                        flush()
            elif tag in _RAW and m["attrs"].endswith("/") and inside({"svg"}, {"foreignobject"}):
                pass
            elif tag in _RAW:
                end = _RAW[tag].search(source, at)
                at = end.end() if end else len(source)
                run.append(" ")
            elif tag in VOID:
                if tag == "hr":
                    flush()
                run.append(" ")
            elif tag == "html":
                pass
            else:
                if before and (tag in BLOCK and (k := inside({"svg"}, {"foreignobject"})) or tag in ("button", "select") and (k := inside({tag}, {"td", "th", "table"}))):
                    close(k)
                if tag in CLOSES_P and (k := inside({"p"}, {"td", "th", "table", "div", "article", "section"})):
                    close(k)
                if tag in SIBLING and (k := inside(*SIBLING[tag])):
                    close(k)
                node = stack[-1][1]
                if tag in BLOCK:
                    flush()
                    node = page.add(node, tag, _names(m["attrs"]))
                elif tag == "a":
                    links += 1
                if tag in HIDDEN:
                    run.append(" ")
                    if tag != "svg" or not m["attrs"].endswith("/"):
                        before.append((len(stack), len(page.parent), run, len(run), linked))
                        stack.append((tag, node))
                elif not m["attrs"].endswith("/") or tag in BLOCK:
                    stack.append((tag, node))
                elif tag == "a":
                    links -= 1
        m = _MARKUP.search(source, at)
    if at < len(source):
        run.append(source[at:])
    flush()
    return page


def features(page: Page) -> np.ndarray:
    """What can be seen of every node: its tag and its parent's, its names, and the links and sentence marks of the text below it.

    Length isn't among them: a short paragraph of an article is content like a long one."""
    n = len(page.parent)
    size, link, stops = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if (t := page.text[i]) is not None:
            size[i], link[i], stops[i] = len(t), min(page.linked[i], len(t)), t.count(".") + t.count(",")
        if (p := page.parent[i]) >= 0:
            size[p] += size[i]
            link[p] += link[i]
            stops[p] += stops[i]
    leaf = np.array([t is not None for t in page.text], dtype=float)
    some = np.maximum(size, 1)
    out = np.zeros((n, 5 + 3 * len(TAGS) + len(NAMES)))
    out[:, 0], out[:, 1] = 1, leaf
    out[:, 2] = np.array(link) / some
    out[:, 3] = np.array(stops) > 0
    out[:, 4] = leaf * out[:, 2]
    rows, columns = [], []
    for i, (tag, names) in enumerate(zip(page.tag, page.names)):
        if tag in _TAG:
            rows.append(i)
            columns.append(5 + _TAG[tag] + (len(TAGS) if page.text[i] is not None else 0))
        up = page.parent[i]
        if up >= 0 and page.text[i] is None and page.tag[up] in _TAG:
            rows.append(i)
            columns.append(5 + 2 * len(TAGS) + _TAG[page.tag[up]])
        for name in names:
            rows.append(i)
            columns.append(5 + 3 * len(TAGS) + _NAME[name])
    out[rows, columns] = 1
    return out


_TAG, _NAME = {t: i for i, t in enumerate(TAGS)}, {t: i for i, t in enumerate(NAMES)}


@dataclass
class Model:
    weights: np.ndarray
    pair: dict[str, tuple[float, float, float, float]]  # by kind of child: potentials of (parent, child) labels 00, 01, 10, 11


def kind(page: Page, i: int) -> str:
    return "text" if page.text[i] is not None else page.tag[i] if page.tag[i] in _TAG else "other"


def train(pages: list[tuple[str, set[str]]], ridge: float = 0.3) -> Model:
    """pages: source and the texts of its content blocks. An element is content if a block below it is."""
    xs, ys, pairs = [], [], {k: np.full((2, 2), 0.01) for k in (*TAGS, "text", "other")}
    for source, content in pages:
        page = parse(source)
        y = np.array([float(t is not None and t in content) for t in page.text])
        for i in range(len(y) - 1, 0, -1):
            y[page.parent[i]] = max(y[page.parent[i]], y[i])
        for i in range(1, len(y)):
            pairs[kind(page, i)][int(y[page.parent[i]]), int(y[i])] += 1
        xs.append(features(page))
        ys.append(y)
    x, y = np.concatenate(xs), np.concatenate(ys)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    # counts over those expected of independent labels, both with one more: 1 where nothing was seen
    ratio = {k: (n + 1) / (n.sum(1, keepdims=True) * n.sum(0, keepdims=True) / n.sum() + 1) for k, n in pairs.items()}
    return Model(w, {k: tuple(r.reshape(-1).tolist()) for k, r in ratio.items()})


def marginals(page: Page, model: Model) -> list[float]:
    """Each node's probability of content, by one upward and one downward sweep of messages."""
    n, parent = len(page.parent), page.parent
    own = (1 / (1 + np.exp(-np.clip(features(page) @ model.weights, -30, 30)))).tolist()
    pair = [model.pair[kind(page, i)] for i in range(n)]
    a, b = [1 - x for x in own], own[:]  # own potential times the messages of the children so far
    up0, up1 = [1.0] * n, [1.0] * n
    for i in range(n - 1, 0, -1):
        p00, p01, p10, p11 = pair[i]
        x, y = p00 * a[i] + p01 * b[i], p10 * a[i] + p11 * b[i]
        s = x + y
        up0[i], up1[i] = x / s, y / s
        k = parent[i]
        x, y = a[k] * up0[i], b[k] * up1[i]
        s = (x + y) or 1.0
        a[k], b[k] = x / s, y / s
    out = [0.0] * n
    s = (a[0] + b[0]) or 1.0
    out[0] = b[0] / s
    full0, full1 = [0.0] * n, [0.0] * n
    full0[0], full1[0] = a[0] / s, b[0] / s
    for i in range(1, n):
        k = parent[i]
        x, y = full0[k] / max(up0[i], 1e-300), full1[k] / max(up1[i], 1e-300)  # the parent's belief without this child
        p00, p01, p10, p11 = pair[i]
        d0, d1 = p00 * x + p10 * y, p01 * x + p11 * y
        x, y = a[i] * d0, b[i] * d1
        s = (x + y) or 1.0
        full0[i], full1[i] = x / s, y / s
        out[i] = full1[i]
    return out


def main_text(source: str, model: Model, threshold: float = 0.5) -> str:
    page = parse(source)
    return "\n".join(t for t, p in zip(page.text, marginals(page, model)) if t is not None and p >= threshold)


def extract(pages: DataFrame, model: Model, html_column: str = "html", into: str = "main_text") -> DataFrame:
    """All columns of pages and into: the main text of the whole page, its blocks joined by a line break.

    A null or empty page, and one without content, gives an empty text. Rows are kept as they are, and a
    column named as into is replaced."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in column:
            for at in range(0, len(part), 256):
                yield pd.Series([main_text(s or "", shared.value) for s in part.iloc[at : at + 256]], dtype=object)

    return pages.withColumn(into, F.pandas_udf(run, "string")(F.coalesce(F.col(html_column), F.lit(""))))
