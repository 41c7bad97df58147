"""Call heads: a lexer as a table function, from files to one row for each name( and each @name.

Brackets, quotes, comments, template holes and regular expressions are told apart token by token, so that a call inside a
string or a comment isn't one, several calls on a line are several, and arguments keep their commas and brackets. What a
head means (a request, a route, a message) is decided by Columns and joins over this table.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_PIECES = "array<struct<kind string, value string>>"
SCHEMA = f"repo string, path string, language string, n int, line int, depth int, receiver string, name string, at boolean, inner_call int, assigned string, args array<struct<kind string, raw string, pieces {_PIECES}>>"
_ARROW = pa.schema([
    *((c, pa.string()) for c in ("repo", "path", "language")), *((c, pa.int32()) for c in ("n", "line", "depth")), ("receiver", pa.string()), ("name", pa.string()), ("at", pa.bool_()), ("inner_call", pa.int32()), ("assigned", pa.string()),
    ("args", pa.list_(pa.struct([("kind", pa.string()), ("raw", pa.string()), ("pieces", pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))]))),
])

_SAME = r"(?P<space>(?:[^\S\n]|\\\n)+)|(?P<line>\n)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)"
_PYTHON = re.compile(r"""(?P<comment>\#[^\n]*)|(?P<text>(?i:[rbfu]{0,2})(?:"{3}(?:\\.|[^\\])*?"{3}|'{3}(?:\\.|[^\\])*?'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'))|""" + _SAME + r"|(?P<op>\*\*|->|:=|[-+*/%&|^=!<>]=|==|.)", re.S)
_CURLY = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<text>"{3}(?:\\.|[^\\])*?"{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|""" + _SAME + r"|(?P<op>=>|\?\.(?!\d)|\?\?|::|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=+|.)", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BODY = re.compile(r"\s*(?:\{|throws\b)")
_BARE_AT = re.compile(r"(?!\s*[.(])")
_GENERIC = re.compile(r"\s*<[\w\s,.?&|\[\]{}:;<>'\"]*>(?=\s*\()")
_ASSIGNED = re.compile(r"([\w$]+)\s*(?::[^=;\n]*)?=\s*(?:await)?$")
_IDENTIFIER, _MEMBER = re.compile(r"[^\W\d][\w$]*|\$[\w$]*"), re.compile(r"[\w$]+(?:\??\.[\w$#]+)+")
_CONSTANTS = {"true", "false", "null", "undefined", "this", "super", "None", "True", "False"}
#: Words that aren't calls before a bracket; behind those that declare stands a new name.
_DECLARE = {True: {"def", "class"}, False: {"function", "class", "interface", "enum"}}
_WORDS = {
    True: set("if elif else for while return raise in and or not is lambda await yield async import from as with assert del try except finally".split()) | _DECLARE[True],
    False: set("if else for while switch case catch return throw in of await yield async import from typeof instanceof delete void do try finally extends implements throws static public private protected final abstract const let var export default".split()) | _DECLARE[False],
}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class _Lexer:
    def __init__(self, source: str, language: str):
        self.s, self.language, self.python = source, language, language == "python"
        self.script = language in ("typescript", "javascript")
        self.token = (_PYTHON if self.python else _CURLY).match
        self.heads: list[dict] = []
        self.comments: list[tuple[int, int]] = []
        self.levels: list[dict] = []
        self.pos, self.line, self.counted = 0, 1, 0

    def line_of(self, at: int) -> int:
        """The line of a place; places come nearly in order, so that counting goes on from the last one."""
        if at >= self.counted:
            self.line += self.s.count("\n", self.counted, at)
        else:
            self.line -= self.s.count("\n", at, self.counted)
        self.counted = at
        return self.line

    def run(self, until: str | None = None) -> None:
        """Read to the end, or to the closing bracket of a template's hole."""
        s, base, words, declare = self.s, len(self.levels), _WORDS[self.python], _DECLARE[self.python]
        last, chain, name, closed, at = "op", None, (0, 0), None, -1
        while self.pos < len(s):
            begin = self.pos
            if s[begin] == "`" and self.script:
                self.template()
                chain, last, closed = begin, "text", None
                continue
            if s[begin] == "/" and self.script and last in ("op", "word") and (m := _REGEX.match(s, begin)):
                self.pos = m.end()
                chain, last, closed = begin, "text", None
                continue
            m = self.token(s, begin)
            kind, text, self.pos = m.lastgroup, m.group(), m.end()
            if kind == "comment":
                self.comments.append((begin, self.pos))
            elif kind == "line":
                if self.python and not self.levels:
                    last, chain, closed = "op", None, None
            elif kind == "name":
                if last not in ("dot", "new") or chain is None:
                    chain, closed = begin, None
                if text == "new" and not self.python and last != "dot":
                    last = "new"
                elif text in words and last != "dot":
                    last = "declares" if text in declare else "word"
                    if self.levels and text in ("for", "in", "lambda"):
                        self.levels[-1]["hold"] = text != "in" and self.python
                else:
                    # behind a word that declares, or in Java behind a type, stands a new name
                    declared = last == "declares" or last == "name" and self.language == "java"
                    last, name = "declared" if declared else "name", (begin, self.pos)
                    if not self.python and not declared and (g := _GENERIC.match(s, self.pos)):
                        self.pos = g.end()
                    if at == chain and _BARE_AT.match(s, self.pos):
                        self.head(chain, name, None, True)
                        last = "op"
            elif kind == "text":
                chain, last, closed = begin, "text", None
            elif kind == "number":
                chain, last, closed = begin, "number", None
            elif kind == "op":
                if text in (".", "?.", "::") or text == "!" and s[self.pos : self.pos + 1] == "." and last in ("name", "close"):
                    last = "dot" if text != "!" else last
                elif text in _OPEN:
                    level = {"close": _OPEN[text], "chain": chain if last in ("name", "close", "text") and text != "{" else begin, "head": None, "from": self.pos, "plus": [], "args": [], "arrow": False, "hold": False}
                    if text == "(" and last == "name":
                        level["head"] = self.head(chain, name, closed, at == chain)
                    self.levels.append(level)
                    last, chain, closed = "op", None, None
                elif text in _CLOSE:
                    if until == text and len(self.levels) == base:
                        return
                    while len(self.levels) > base and self.levels[-1]["close"] != text:
                        self.levels.pop()  # an opening bracket that nothing closes
                    if len(self.levels) > base:
                        level = self.levels.pop()
                        if level["head"] is not None:
                            self.argument(level, begin)
                            head = self.heads[level["head"]]
                            head["args"] = level["args"]
                            head["declares"] = not self.python and head["receiver"] is None and not head["at"] and _BODY.match(s, self.pos) is not None
                        chain, closed, last = level["chain"], level["head"], "close"
                else:
                    if self.levels and len(self.levels) > base:
                        level = self.levels[-1]
                        if text == "," and level["head"] is not None and not level["hold"]:  # not between a loop's or a lambda's names
                            self.argument(level, begin)
                        elif text == ":":
                            level["hold"] = False
                        elif text == "+" and last in ("name", "close", "text", "number"):
                            level["plus"].append(begin)
                        elif text == "=>":
                            level["arrow"] = True
                    if text == "@":
                        at = self.pos
                    last, chain, closed = "op", None, None

    def template(self) -> None:
        """Over a template string; its holes are read like other text."""
        self.pos += 1
        while self.pos < len(self.s):
            c = self.s[self.pos]
            if c == "\\":
                self.pos += 2
            elif c == "`":
                self.pos += 1
                return
            elif c == "$" and self.s[self.pos + 1 : self.pos + 2] == "{":
                self.pos += 2
                depth = len(self.levels)
                self.run("}")
                del self.levels[depth:]
            else:
                self.pos += 1

    def head(self, chain: int, name: tuple[int, int], closed: int | None, at: bool) -> int:
        receiver = re.sub(r"[\s.?!:]+$", "", self.s[chain : name[0]]) if chain < name[0] else None
        left = self.s[max(0, chain - 120) : chain].rstrip()
        before = _ASSIGNED.search(left) if left.endswith(("=", "await")) else None
        self.heads.append({"line": self.line_of(chain), "depth": len(self.levels), "receiver": receiver, "name": self.s[slice(*name)], "at": at, "inner_call": closed, "assigned": before and before[1], "args": [], "declares": False})
        return len(self.heads) - 1

    def bare(self, a: int, b: int) -> str:
        """Source from a to b without its comments, trimmed."""
        out = []
        for begin, end in self.comments[bisect.bisect_left(self.comments, (a, 0)) : bisect.bisect_left(self.comments, (b, 0))]:
            out.append(self.s[a:begin])
            a = end
        return "".join([*out, self.s[a:b]]).strip()

    def argument(self, level: dict, end: int) -> None:
        """Note the argument that ends here: its kind, its source, and the pieces that its value is put together from."""
        raw = self.bare(level["from"], end)
        if raw:
            cuts = [level["from"] - 1, *level["plus"], end]
            operands = [self.operand(self.bare(a + 1, b)) for a, b in zip(cuts, cuts[1:])]
            kind = operands[0][0] if len(operands) == 1 else "sum"
            if level["arrow"] and not raw.startswith(("{", "[")) or re.match(r"(?:async\s+)?function\b", raw):
                kind = "function"
            level["args"].append({"kind": kind, "raw": raw, "pieces": [p for _, pieces in operands for p in pieces]})
        level["from"], level["plus"], level["arrow"], level["hold"] = end + 1, [], False, False

    def operand(self, raw: str) -> tuple[str, list[dict]]:
        """(kind, pieces): text, template, name, member or code; a piece is text, hole, name or code."""
        piece = lambda kind, value: {"kind": kind, "value": value}
        m = self.token(raw, 0) if raw else None
        if m and m.lastgroup == "text" and m.end() == len(raw):
            prefix, quote = re.match(r"([A-Za-z]*)(\"{3}|'{3}|\"|')", raw).groups()
            inner = raw[len(prefix) + len(quote) : -len(quote)]
            if not self.python:
                return "text", [piece("text", inner)]
            parts = re.split(r"\{(\w+)\}", inner)
            return "template" if set(prefix.lower()) & {"f", "b"} else "text", [piece("hole" if i % 2 else "text", p) for i, p in enumerate(parts) if p]
        if self.script and raw.startswith("`") and raw.endswith("`") and len(raw) > 1:
            pieces, at, inner = [], 0, raw[1:-1]
            while (begin := inner.find("${", at)) >= 0:
                end, depth = begin + 2, 1
                while end < len(inner) and depth:
                    depth += {"{": 1, "}": -1}.get(inner[end], 0)
                    end += 1
                pieces += [piece("text", inner[at:begin])] * (begin > at) + [piece("hole", inner[begin + 2 : end - 1].strip())]
                at = end
            return "template" if at else "text", pieces + [piece("text", inner[at:])] * (at < len(inner))
        if _IDENTIFIER.fullmatch(raw) and raw not in _CONSTANTS:
            return "name", [piece("name", raw)]
        return "member" if _MEMBER.fullmatch(raw) else "code", [piece("code", raw)]


def lex(source: str, language: str) -> list[dict]:
    """The heads of one text; the head of a body, a declared method's, isn't a call."""
    lexer = _Lexer(source, language)
    lexer.run()
    for n, head in enumerate(lexer.heads):
        head["n"] = n
    return [h for h in lexer.heads if not h.pop("declares")]


def heads(files: DataFrame) -> DataFrame:
    """files (repo, path, language, content) -> one row for each name( and @name outside strings and comments, n from 0 in
    the file's order: the line where its expression begins, how many brackets are open there, the receiver's source (null
    without one), whether it is an annotation, the n of the call that the receiver ends with, the variable that the
    expression is assigned to, and its arguments. An argument has its kind (text, template, name, member, function, sum,
    code), its source, and pieces: the texts, holes, names and other code whose values together are its value. Files without content give nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, path, language, content in zip(*(c.to_pylist() for c in batch.columns)):
                found = [{"repo": repo, "path": path, "language": language} | h for h in lex(content or "", language or "")]
                for k in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_pylist(found[k : k + 10_000], _ARROW)

    return files.select("repo", "path", "language", "content").mapInArrow(read, SCHEMA)
