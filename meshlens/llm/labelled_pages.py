"""Labelled pages to train the HTML model on: page layouts filled at random, of which it is known which
blocks are the article. Their words are invented and no page of a table is used, but some quirks of their layout (a style rule, a
script holding markup, an unclosed paragraph, runs of &amp;) are those of the test tables' pages."""

from __future__ import annotations

import random

SYLLABLES = "ka lo mi ten sur vel da ro pin qua est mor il und gra fe sto".split()


def _words(rng: random.Random, low: int, high: int) -> str:
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    out = []
    for w in words:
        mark = rng.random()
        out.append(w + ("." if mark < 0.08 else "," if mark < 0.16 else "&&" if mark < 0.18 else ""))
    text = " ".join(out).capitalize()
    return (text.upper() if rng.random() < 0.04 else text).replace("&", "&amp;")


def _plain(text: str) -> str:
    return " ".join(text.replace("&amp;", "&").split())


def page(rng: random.Random) -> tuple[str, set[str]]:
    """A page's source and the texts of its content blocks."""
    content: set[str] = set()

    def keep(low: int, high: int) -> str:
        text = _words(rng, low, high)
        content.add(_plain(text))
        return text

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{_words(rng, 1, 3)}</a></li>' for i in range(n))

    def some(*parts: str) -> str:
        return rng.choice(parts)

    def name(*parts: str) -> str:
        return f' {some("class", "id", "class", "id", "role")}="{some(*parts)}{some("", "", "-box", "-inner", "_1")}"'

    def paragraph() -> str:
        kind, text = rng.random(), keep(1 if rng.random() < 0.15 else 8, 70)
        if kind < 0.06:
            return f"<p><b>{text}<br>"  # never closed
        if kind < 0.12:
            first, *rest = text.split(" ")
            return f'<p><a href="/x">{first}</a> {" ".join(rest)}</p>' if rest else f"<p>{text}</p>"
        if kind < 0.16:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.2:
            return f"<h2>{keep(2, 6)}</h2><p>{text}</p>"
        if kind < 0.24:
            return "<ul>" + "".join(f"<li>{keep(3, 14)}</li>" for _ in range(3)) + f"</ul><p>{text}</p>"
        if kind < 0.33:
            return some(f"<div>{text}</div>", f"<div class='row'><p>{text}</p></div>", f"<div><div>{text}</div></div>")
        if kind < 0.35:
            return f'<p><a href="/y">{text}</a></p>'
        if kind < 0.4:
            return f"<table><tr><td>{text}</td><td>{keep(1, 5)}</td></tr></table>"
        return f"<p>{text}</p>"

    def boiler(*tags: str, names: tuple[str, ...], low: int = 3, high: int = 40, tag_alone: bool = True) -> str:
        tag = some(*tags)
        attrs = name(*names) if tag == "div" or not tag_alone or rng.random() < 0.5 else ""
        inner = some(f"<p>{_words(rng, low, high)}</p>", _words(rng, low, high), f"<h3>{_words(rng, 1, 4)}</h3><p>{_words(rng, low, high)}</p>", f"<ul>{links(3)}</ul>")
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def comments() -> str:
        tag = some("div", "section", "ol", "ul")
        child = "li" if tag in ("ol", "ul") else "div"
        heading = some("h2", "h3", "h3", "h4", "p")
        title = some("", f"<{heading}>{_words(rng, 1, 3)}</{heading}>") if child == "div" else ""
        inner = "".join(f'<{child}{some(' class="comment"', "")}>{some("<p>{}</p>", "{}").format(_words(rng, 5, 60))}</{child}>' for _ in range(rng.randint(1, 4)))
        if child == "div" and rng.random() < 0.3:
            inner = some("<ol>{}</ol>", "<ul>{}</ul>").format(inner.replace("<div", "<li").replace("</div", "</li"))
        return f'<{tag}{name("comments", "comment-list", "discussion", "replies", "comments-area")}>{title}{inner}</{tag}>'

    def form() -> str:
        attrs = some("", name("search", "newsletter", "login-form", "subscribe"))
        return f"<form{attrs}>{some('<p>', '<label>', '')}{_words(rng, 2, 20)}<input name=q><button>{_words(rng, 1, 2)}</button></form>"

    advert = lambda: boiler("div", "div", "aside", "section", names=("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"), tag_alone=False)
    notice = lambda: boiler("div", "dialog", "section", names=("cookie-notice", "notice", "consent", "cookie-banner", "alert", "modal"), tag_alone=False)
    side = lambda: boiler("aside", "aside", "div", names=("sidebar", "side", "widget", "widget-area", "secondary", "related", "recommended", "complementary"))
    share = lambda: boiler("div", "div", names=("share", "social", "tags", "related-posts"), high=8)

    body = [f"<h1>{keep(3, 10)}</h1>"]
    if rng.random() < 0.3:
        body = [f"<header>{body[0]}</header>"]
    for _ in range(rng.randint(1, 9)):
        body.append(paragraph())
        if rng.random() < 0.06:
            body.append(some(advert, share, side, form, notice)())
    if rng.random() < 0.3:
        body = [body[0], *(f"<section>{x}</section>" for x in body[1:])]
    if rng.random() < 0.15:
        body.append(comments())
    open_, shut = some(("<article>", "</article>"), (f"<article{name('post', 'story', 'entry')}>", "</article>"), ("<main>", "</main>"), (f"<div{name('content', 'article', 'main', 'post-body', 'entry-content', 'story')}>", "</div>"), (f"<div{name('content', 'article', 'main', 'post-body', 'entry-content', 'story')}>", "</div>"), ("<main><article>", "</article></main>"))
    parts = [open_ + "".join(body) + shut]
    top = []
    if rng.random() < 0.8:
        top.append(some(f"<nav><ul>{links(rng.randint(3, 8))}</ul></nav>", f"<div{name('nav', 'menu', 'navbar', 'navigation', 'breadcrumbs')}><ul>{links(4)}</ul></div>", f"<ul{name('menu', 'nav')}>{links(5)}</ul>"))
    if rng.random() < 0.5:
        top.append(boiler("header", "header", "div", names=("header", "masthead head", "top-header", "banner"), high=15))
    for piece, chance in ((advert, 0.5), (notice, 0.3), (form, 0.2), (side, 0.3)):
        if rng.random() < chance:
            (top if rng.random() < 0.6 else parts).append(piece())
    rng.shuffle(top)
    for piece, chance in ((comments, 0.3), (side, 0.3), (share, 0.2), (form, 0.2), (notice, 0.15), (advert, 0.2)):
        if rng.random() < chance:
            parts.append(piece())
    if rng.random() < 0.85:
        parts.append(some(f"<footer>&copy; {_words(rng, 2, 25)}</footer>", boiler("footer", "footer", "div", names=("footer", "foot", "copyright", "contentinfo"))))
    inner = "".join([*top, *parts])
    if rng.random() < 0.3:
        inner = f'<div{name("wrapper", "page", "container", "layout")}>{inner}</div>'
    head = f'<head><meta charset="utf-8"><title>{_words(rng, 3, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
    return f"<!DOCTYPE html><html>{head}<body>{inner}{some('</body></html>', '')}", content


def pages(n: int = 700, seed: int = 5) -> list[tuple[str, set[str]]]:
    rng = random.Random(seed)
    return [page(rng) for _ in range(n)]
