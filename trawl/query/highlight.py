"""What each part of the search box is, for colouring it while it is typed."""

from __future__ import annotations

from dataclasses import dataclass

from trawl.query.errors import QueryError
from trawl.query.filters import build_filter, is_filter_key
from trawl.query.lexer import tokenize_spanned
from trawl.query.pattern import Regex


@dataclass(frozen=True)
class Segment:
    start: int
    end: int
    kind: str  # plain, keyword, operator, argument, invalid


def classify(text: str) -> list[Segment]:
    """Segments that tile the input, in bytes: filters as keyword, operator and argument, all else plain."""
    tokens, _ = tokenize_spanned(text)
    marked: list[Segment] = []
    at = 0
    while at < len(tokens):
        token, start, end = tokens[at]
        keyed = token.kind == "word" and (is_filter_key(token.text) or token.text.lower() == "regex")
        ops = 0
        while keyed and ops < 2 and at + 1 + ops < len(tokens) and tokens[at + 1 + ops][0].kind == "op":
            ops += 1
        if not ops:
            at += 1
            continue
        marked.append(Segment(start, end, "keyword"))
        marked.append(Segment(tokens[at + 1][1], tokens[at + ops][2], "operator"))
        op = tokens[at + ops][0].text
        at += 1 + ops
        if at < len(tokens) and tokens[at][0].kind in ("word", "quoted"):
            value, a, b = tokens[at]
            marked.append(Segment(a, b, "argument" if _valid(token.text, op, value.text) else "invalid"))
            at += 1
    out, last = [], 0
    for s in marked:
        if s.start > last:
            out.append(Segment(last, s.start, "plain"))
        out.append(s)
        last = s.end
    size = len(text.encode("utf-8", "surrogatepass"))
    return out + ([Segment(last, size, "plain")] if last < size else [])


def _valid(key: str, op: str, value: str) -> bool:
    try:
        if key.lower() == "regex":
            return op == ":" and bool(Regex(value))
        build_filter(key, op, value)
        return True
    except QueryError:
        return False
