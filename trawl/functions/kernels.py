"""Arrow kernels for what the JVM has no expression for: RE2, approximate matching, snippets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from trawl.functions.text import contains_any_case

SNIPPET = StructType(
    [
        StructField("window", StringType()),
        StructField(
            "ranges", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
        ),
        StructField("truncated_start", BooleanType()),
        StructField("truncated_end", BooleanType()),
    ]
)
MAX_COUNT = 1000


def re2_match(col: Column, pattern: str) -> Column:
    """The text holds a match; linear time. False for NULL."""

    @F.arrow_udf(BooleanType())
    def match(text: pa.Array) -> pa.Array:
        return pc.fill_null(pc.match_substring_regex(text, pattern), False)

    return match(col)


def re2_count(col: Column, pattern: str) -> Column:
    """Matches that don't overlap, at most 1000; 0 for NULL."""

    @F.arrow_udf(IntegerType())
    def count(text: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.count_substring_regex(text, pattern), 0)
        return pc.cast(pc.min_element_wise(n, pa.scalar(MAX_COUNT, n.type)), pa.int32())

    return count(col)


def edit_budget(size: int, cap: int) -> int | None:
    """Edits allowed for a term of so many bytes: one in three, up to the cap; None: no fuzzy search."""
    return min(size // 3, cap) if 3 <= size <= 64 and cap > 0 else None


class Approximate:
    """Substring matching with up to k edits on bytes, by bit-parallel simulation (Wu and Manber)."""

    def __init__(self, pattern: bytes, k: int):
        self.size, self.k = len(pattern), k
        self.hit = 1 << (self.size - 1)
        self.masks: dict[int, int] = {}
        for i, b in enumerate(pattern):
            self.masks[b] = self.masks.get(b, 0) | 1 << i
        self.fresh = [(1 << d) - 1 for d in range(k + 1)]
        cuts = [self.size * i // (k + 1) for i in range(k + 2)]
        self.pieces = {pattern[a:b] for a, b in zip(cuts, cuts[1:])}

    def regions(self, text: bytes) -> list[tuple[int, int]]:
        """Where matches may lie: of k + 1 pieces of the pattern one is intact, and the match is not far longer than it."""
        if b"" in self.pieces:
            return [(0, len(text))] if text else []
        reach, found = self.size + self.k, []
        for piece in self.pieces:
            at = text.find(piece)
            while at >= 0:
                found.append((max(0, at - reach), min(len(text), at + len(piece) + reach)))
                at = text.find(piece, at + 1)
        return merge_ranges(found)

    def ends(self, text: bytes, restart: bool) -> Iterator[tuple[int, int]]:
        """(end, edits) wherever a match ends; with `restart` the search begins anew behind each."""
        rows, masks, hit = list(self.fresh), self.masks, self.hit
        for i, b in enumerate(text):
            mask = masks.get(b, 0)
            above = old = 0
            for d, row in enumerate(rows):
                grown = (row << 1 | 1) & mask
                if d:
                    grown |= old | old << 1 | above << 1 | 1
                old, above, rows[d] = row, grown, grown
            for d, row in enumerate(rows):
                if row & hit:
                    yield i + 1, d
                    if restart:
                        rows = list(self.fresh)
                    break

    def best(self, text: bytes) -> int | None:
        """The fewest edits any substring needs; None beyond k."""
        least = None
        for _, d in self.ends(text, False):
            if least is None or d < least:
                least = d
                if d == 0:
                    break
        return least

    def count(self, text: bytes) -> int:
        return sum(1 for _ in self.ends(text, True))

    def many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """best() (-1 for none) and count() of many texts, by the places where matches may lie.

        No match reaches from one such place to another, so they are searched by themselves.
        """
        places = [(i, text[a:b]) for i, text in enumerate(texts) for a, b in self.regions(text)]
        best, count = np.full(len(texts), self.k + 1, np.int32), np.zeros(len(texts), np.int32)
        if places:
            of = np.array([i for i, _ in places])
            b, c = self._many([x for _, x in places])
            np.minimum.at(best, of, np.where(b < 0, self.k + 1, b))
            np.add.at(count, of, c)
        return np.where(best > self.k, -1, best).astype(np.int32), count

    def _many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """best() and count() of many texts, the same step for all of like length at once; few are gone through one by one."""
        best, count = np.full(len(texts), -1, np.int32), np.zeros(len(texts), np.int32)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        masks = np.zeros(256, np.uint64)
        for b, m in self.masks.items():
            masks[b] = m
        at = 0
        while at < len(order):  # texts of like length, a few megabytes at a time
            end, longest = at, 0
            while end < len(order) and (end + 1 - at) * max(longest, len(texts[order[end]]), 1) <= 4_000_000:
                longest = max(longest, len(texts[order[end]]))
                end += 1
            end = max(end, at + 1)
            part = order[at:end]
            if len(part) <= 8:
                for i in part:
                    best[i], count[i] = -1 if (b := self.best(texts[i])) is None else b, self.count(texts[i])
                at = end
                continue
            longest = len(texts[part[-1]])
            grid = np.frombuffer(b"".join(texts[i].ljust(longest, b"\0") for i in part), np.uint8).reshape(len(part), longest)
            sizes = np.array([len(texts[i]) for i in part])
            b, c = self._grid(masks[grid.T.copy()], sizes)
            best[part], count[part] = b, c
            at = end
        return best, count

    def _grid(self, masks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, one, hit = len(sizes), np.uint64(1), np.uint64(self.hit)
        least, count = np.full(n, self.k + 1, np.int32), np.zeros(n, np.int32)
        free = [np.full(n, f, np.uint64) for f in self.fresh]  # goes on over matches, for the best
        anew = [np.full(n, f, np.uint64) for f in self.fresh]  # begins again behind each, for the count
        first = 0  # texts are in order of length: those before `first` are through
        for at, row in enumerate(masks):
            while first < n and sizes[first] <= at:
                first += 1
            live = slice(first, n)
            mask = row[live]
            for rows, fresh in ((free, False), (anew, True)):
                above = old = None
                for d in range(self.k + 1):
                    cur = rows[d][live]
                    grown = (cur << one | one) & mask
                    if d:
                        grown |= old | old << one | above << one | one
                    old, above = cur.copy(), grown
                    rows[d][live] = grown
                if fresh:
                    over = (rows[self.k][live] & hit) != 0  # a row of more edits holds those of fewer
                    if over.any():
                        count[live] += over
                        for d in range(self.k + 1):
                            rows[d][live] = np.where(over, np.uint64(self.fresh[d]), rows[d][live])
                else:
                    for d in range(self.k, -1, -1):
                        over = (rows[d][live] & hit) != 0
                        if not over.any():
                            break
                        np.minimum(least[live], np.where(over, d, self.k + 1), out=least[live])
        return np.where(least > self.k, -1, least), count

    def first(self, text: bytes, pattern: bytes) -> tuple[int, int] | None:
        """Byte range of the first match, at its cheapest end within k bytes."""
        for end, edits in self.ends(text, True):
            best = (edits, end)
            window = text[: end + self.k]
            for e, d in self.ends(window, False):
                if end <= e <= end + self.k and d < best[0]:
                    best = (d, e)
            edits, end = best
            back = Approximate(pattern[::-1], edits)
            start = max(0, end - self.size - edits)
            tail = text[start:end][::-1]
            lengths = [e for e, d in back.ends(tail, False) if d <= edits]
            near = min(lengths, key=lambda n: (abs(n - self.size), n)) if lengths else len(tail)
            return end - near, end
        return None


_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _over_bytes(col: Column, folded_term: str, k: int, counted: bool) -> Column:
    @F.pandas_udf(IntegerType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = Approximate(folded_term.encode(), k)
        for texts in batches:
            there = np.flatnonzero(texts.notna().to_numpy())
            best, count = machine.many([texts.iat[i].encode().translate(_FOLD) for i in there])
            out = np.full(len(texts), -1, np.int32)
            out[there] = count if counted else best
            yield pd.Series(out, dtype="Int32").mask(out < 0)

    return run(col)


def best_distance(col: Column, folded_term: str, k: int) -> Column:
    """Fewest edits between the term and any substring, ASCII case ignored; NULL beyond k and for NULL."""
    return _over_bytes(col, folded_term, k, False)


def fuzzy_count(col: Column, folded_term: str, k: int) -> Column:
    """Matches within k edits, each search starting behind the last match; NULL for NULL."""
    return _over_bytes(col, folded_term, k, True)


def may_be_near(col: Column, folded_term: str, k: int) -> Column:
    """True wherever a match within k edits may be: of k + 1 pieces of the term one is intact."""
    n, pieces = len(folded_term), k + 1
    cuts = [n * i // pieces for i in range(pieces + 1)]
    return contains_any_case(col, *[folded_term[a:b] for a, b in zip(cuts, cuts[1:])])


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that touch or overlap become one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _left(data: bytes, i: int) -> int:
    while 0 < i < len(data) and data[i] & 0xC0 == 0x80:
        i -= 1
    return max(0, min(i, len(data)))


def _right(data: bytes, i: int) -> int:
    while 0 < i < len(data) and data[i] & 0xC0 == 0x80:
        i += 1
    return min(i, len(data))


def clamp_range(data: bytes, start: int, end: int, most: int) -> tuple[int, int]:
    """The range cut to at most so many bytes, whole characters only."""
    return (start, end) if end - start <= most else (start, max(start, _left(data, start + most)))


def cut_window(text: str, ranges: list[tuple[int, int]], budget: int = 600) -> dict:
    """About `budget` bytes of text around its first match, a third of them before it.

    Ranges are byte ranges of the text; those returned are merged, clipped and relative to
    the window. A match that runs over the right edge is kept whole, up to twice the
    budget. Without matches: the head of the text.
    """
    data = text.encode()
    ranges = merge_ranges([clamp_range(data, a, b, 2 * budget) for a, b in ranges])
    start = max(0, ranges[0][0] - budget // 3) if ranges else 0
    end = min(len(data), start + budget)
    start, end = _left(data, start), _right(data, end)
    for a, b in ranges:
        if a < end < b:
            end = _right(data, b)
    inside = [(max(a, start) - start, min(b, end) - start) for a, b in ranges if a < end and b > start]
    return {
        "window": data[start:end].decode("utf-8", "replace"),
        "ranges": [{"start": a, "end": b} for a, b in inside],
        "truncated_start": start > 0,
        "truncated_end": end < len(data),
    }


def byte_ranges(text: str, pattern: re.Pattern, most: int = MAX_COUNT) -> list[tuple[int, int]]:
    out, at, chars = [], 0, 0
    for m in pattern.finditer(text):
        if m.end() == m.start():
            continue
        at += len(text[chars : m.start()].encode())
        size = len(m[0].encode())
        out.append((at, at + size))
        at, chars = at + size, m.end()
        if len(out) == most:
            break
    return out


def snippets(text: Column, stage: Column, term: str, exact: re.Pattern | None, folded: re.Pattern | None, k: int | None, budget: int = 600) -> Column:
    """Snippet of the matched field. For the few rows left after the top-k.

    Stages 1, 3, 5, 9 mark matches in their case, 2, 4, 6, 10 in any case, 7, 8, 11 the
    approximate match; names and paths are shown whole.
    """
    low = term.encode().translate(_FOLD)

    @F.pandas_udf(SNIPPET)
    def cut(texts: pd.Series, stages: pd.Series) -> pd.DataFrame:
        machine = Approximate(low, k) if k is not None else None
        rows = []
        for t, s in zip(texts, stages):
            if t is None:
                rows.append({"window": None, "ranges": None, "truncated_start": None, "truncated_end": None})
                continue
            if s in (7, 8, 11) and machine is not None:
                one = machine.first(t.encode().translate(_FOLD), low)
                ranges = [one] if one else []
            else:
                pattern = exact if s in (1, 3, 5, 9) and exact is not None else folded
                ranges = byte_ranges(t, pattern) if pattern is not None else []
            rows.append(cut_window(t, ranges, budget if s in (5, 6, 8) else max(budget, 3 * len(t.encode()) + 3)))
        return pd.DataFrame(rows, columns=["window", "ranges", "truncated_start", "truncated_end"])

    return cut(text, stage)


def first_difference(a: Column, b: Column) -> Column:
    """Offset of the first byte in which two binaries differ; NULL if neither does or one is NULL."""

    @F.pandas_udf(LongType())
    def differ(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            at = None
            if p is not None and q is not None and p != q:
                n = min(len(p), len(q))
                lo, hi = 0, n
                while lo < hi:  # the longest equal head, by halves
                    mid = (lo + hi + 1) // 2
                    lo, hi = (mid, hi) if p[:mid] == q[:mid] else (lo, mid - 1)
                at = lo
            out.append(at)
        return pd.Series(out, dtype="Int64")

    return differ(a, b)
