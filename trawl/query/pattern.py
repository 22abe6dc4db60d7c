"""Term patterns: literal phrases, wildcards, and regular expressions, as Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.text import ascii_fold, ascii_lower, contains_any_case, count_any_case, count_literal, quoted
from trawl.query.errors import BadRegex

MAX_COUNT = 1000


@dataclass(frozen=True)
class Pattern:
    """What a term asks for. No chunks: nothing. One chunk without stars: a literal."""

    segments: tuple[str, ...] = ()
    star: bool = False
    leading: bool = False
    trailing: bool = False

    @classmethod
    def of(cls, parts: list[tuple[str, bool]]) -> Pattern:
        """Parts (text, stars are wildcards) joined by single spaces."""
        flat: list[str | None] = []  # None is a star
        for i, (text, glob) in enumerate(parts):
            pieces = text.split("*") if glob else [text]
            for k, piece in enumerate(pieces):
                if k:
                    flat.append(None)
                flat.append((" " if i and not k else "") + piece)
        merged: list[str | None] = []
        for x in flat:
            if x == "":
                continue
            if merged and (x is None) == (merged[-1] is None):
                merged[-1] = None if x is None else merged[-1] + x
            else:
                merged.append(x)
        segments = tuple(x for x in merged if x is not None)
        if not segments:
            return cls()
        return cls(segments, None in merged, merged[0] is None, len(merged) > 1 and merged[-1] is None)

    @property
    def empty(self) -> bool:
        return not self.segments

    @property
    def literal(self) -> str | None:
        return self.segments[0] if self.segments and not self.star else None

    @property
    def chars(self) -> int:
        return sum(map(len, self.segments))

    def _java(self, joint: str, ci: bool, anchored: bool) -> str:
        # (?d): only \n ends a line, as elsewhere; \z: not before a final line break either.
        core = joint.join(map(quoted, self.segments))
        if anchored:
            core = "\\A" + (".*" if self.leading else "") + core + (".*" if self.trailing else "") + "\\z"
        return ("(?diu)" if ci else "(?d)") + core

    def whole(self, col: Column, ci: bool) -> Column:
        """The text as a whole is the term."""
        if self.literal is not None:
            return ascii_fold(col) == ascii_lower(self.literal) if ci else col == F.lit(self.literal)
        return self.holds_all(col, ci) & F.regexp_like(col, F.lit(self._java(".*", ci, True)))

    def inside(self, col: Column, ci: bool) -> Column:
        """The text holds the term."""
        if self.literal is not None:
            return contains_any_case(col, self.literal) if ci else col.contains(self.literal)
        return F.regexp_like(col, F.lit(self._java(".*?", ci, False)))

    def holds_all(self, col: Column, ci: bool = True) -> Column:
        """A cheap condition every match meets: all literal pieces occur, ASCII case ignored."""
        test: Column = F.lit(True)
        for s in self.segments:
            test = test & (contains_any_case(col, s) if ci else col.contains(s))
        return test

    def count(self, col: Column, ci: bool) -> Column:
        """Occurrences that don't overlap, at most MAX_COUNT for wildcards."""
        if self.literal is not None:
            return count_any_case(col, self.literal) if ci else count_literal(col, self.literal)
        return F.least(F.regexp_count(col, F.lit(self._java(".*?", ci, False))), F.lit(MAX_COUNT))

    def python(self, ci: bool) -> re.Pattern:
        """For cutting snippets on the few rows that come out."""
        joint = "[^\\n]*?"
        flags = re.I | re.A if ci else 0
        return re.compile(joint.join(map(re.escape, self.segments)), flags)


@dataclass(frozen=True)
class Regex:
    """A linear-time regular expression (RE2), case-insensitive and multi-line."""

    source: str

    def __post_init__(self):
        probes = ["", "a", "a b", "a\nb", "1-1", "_ ."]
        try:
            marked = pc.replace_substring_regex(pa.array(probes), self.pattern, "\x01").to_pylist()
        except pa.ArrowInvalid as e:
            raise BadRegex(str(e)) from e
        # Where it matches and nothing but the mark is new, it matched the empty text.
        if any(m != t and m.replace("\x01", "") == t for t, m in zip(probes, marked)):
            raise BadRegex("matches the empty text")

    @property
    def pattern(self) -> str:
        return f"(?im){self.source}"
