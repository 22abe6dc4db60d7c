"""From the search box to a plan: a term, filters, perhaps a regular expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column

from trawl.query.errors import BadRegex, UnsupportedOp
from trawl.query.filters import build_filter, is_filter_key
from trawl.query.lexer import LexError, Token, tokenize
from trawl.query.pattern import Pattern, Regex


@dataclass
class Query:
    term: str = ""
    pattern: Pattern = field(default_factory=Pattern)
    regex: Regex | None = None
    filters: list[Column] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        """Filters narrow a search but never drive one."""
        return self.pattern.empty and self.regex is None


def parse(text: str) -> Query:
    """Read a query. Half-typed input is never an error: it is searched for as it stands."""
    text = text.replace("\0", "")
    try:
        tokens = tokenize(text)
    except LexError:
        term = text.strip()
        return Query(term, Pattern.of([(term, False)]))
    query, parts, at = Query(), [], 0
    while at < len(tokens):
        token = tokens[at]
        if token.kind == "word" and _kind(tokens, at + 1) == "op":
            used, part = _keyed(tokens, at, query)
            at += used
            if part is not None:
                parts.append((part, False))
            continue
        at += 1
        if token.kind == "word":
            parts.append((token.text, "*" in token.text))
        elif token.kind not in "()":  # quoted; AND, OR and stray signs are words like any other
            parts.append((token.text, False))
    query.term = " ".join(p for p, _ in parts)
    query.pattern = Pattern.of(parts)
    return query


def _kind(tokens: list[Token], at: int) -> str | None:
    return tokens[at].kind if at < len(tokens) else None


def _keyed(tokens: list[Token], at: int, query: Query) -> tuple[int, str | None]:
    """`key op [op] value` at a word: a filter, a regex, or literal text. Tokens used, text to search."""
    key = tokens[at].text
    two = _kind(tokens, at + 2) == "op"
    value_at = at + (3 if two else 2)
    if _kind(tokens, value_at) not in ("word", "quoted"):
        return 2, key + tokens[at + 1].text
    op, value = tokens[value_at - 1].text, tokens[value_at]
    if key.lower() == "regex":
        if op != ":":
            raise UnsupportedOp(key, op)
        if query.regex is not None:
            raise BadRegex("only one regex in a query")
        query.regex = Regex(value.text)
    elif is_filter_key(key):
        query.filters.append(build_filter(key, op, value.text, value.kind == "word"))
    else:
        glued, end = key + op + value.text, value_at + 1
        while _kind(tokens, end) == "op":
            glued += tokens[end].text
            end += 1
            if _kind(tokens, end) in ("word", "quoted"):
                glued += tokens[end].text
                end += 1
        return end - at, glued
    return value_at + 1 - at, None
