"""Text that looks the same brought to one form, by a transducer over grapheme clusters."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trawl.runtime import spill

# Letters drawn alike in one ordinary font, by script. Each line maps the
# letters of the first word to those of the second, one by one. Letters that merely
# resemble each other (Greek alpha and a, Cyrillic ka and k) are not listed, nor is
# anything within ASCII (l and 1, O and 0).
LOOK_ALIKES = (
    ("АВЕЅІЈКМНОРСТҮХԚԜӀ", "ABESIJKMHOPCTYXQWI"),
    ("аеорсухѕіјһԁԛԝӏү", "aeopcyxsijhdqwly"),
    ("ӘәӨөӠӡӔӕ", "ƏəƟɵƷʒÆæ"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿͿ", "ABEZHIKMNOPTYXCƆJ"),
    ("νοϲϳ", "vocj"),
    ("ΓΠΦƩ", "ГПФΣ"),
    ("ՕօԼ", "OoL"),
    ("ĐƉ", "ÐÐ"),
    ("ɡᴏᴠᴡᴢᴄꜱǃ", "govwzcs!"),
    ("µ", "μ"),
    ("ʼʻ", "’‘"),
    ("‐‑", "--"),
)
# Several characters drawn like others; a dot above takes the place of the dot of i and j.
SEQUENCES = (("i\u0307", "i"), ("j\u0307", "j"), ("\u0131\u0307", "i"), ("\u0237\u0307", "j"))

# First and last of the ranges of characters that show nothing (Default_Ignorable).
_INVISIBLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F),
    (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0xE0000, 0xE0FFF),
)
_INVISIBLE_SET = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _INVISIBLE)
_IGNORABLE = re.compile(f"[{_INVISIBLE_SET}]")
# Ligatures, digraph letters, dot leaders, number forms: drawn as the letters they stand for.
_SPELT_OUT = ((0x132, 0x133), (0x1C7, 0x1CC), (0x1F1, 0x1F3), (0x2024, 0x2026), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17))


class MappingConflict(ValueError):
    """Two rules send one text to different forms, or a form is itself mapped on."""


def _rules() -> Iterator[tuple[str, str]]:
    """(characters, what they are brought to) from the Unicode tables and the lists above."""
    listed = {a: b for froms, tos in LOOK_ALIKES for a, b in zip(froms, tos, strict=True)}
    yield from listed.items()
    yield from SEQUENCES
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if _IGNORABLE.match(ch):
            yield ch, ""
            continue
        if unicodedata.category(ch) == "Zs" and cp != 0x1680:
            yield ch, " "
            continue
        how = unicodedata.decomposition(ch)
        if not how.startswith("<"):
            continue
        kind, *points = how.split()
        to = "".join(chr(int(p, 16)) for p in points)
        if kind in ("<wide>", "<narrow>", "<noBreak>") or any(a <= cp <= b for a, b in _SPELT_OUT):
            to = unicodedata.normalize("NFD", to)
            yield ch, "".join(listed.get(c, "" if _IGNORABLE.match(c) else c) for c in to)


class Trie:
    """The rules, compiled: at each place the longest one that fits is applied."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        self.rules: dict[str, str] = {}
        for key, to in rules:
            if not key or key.isascii():
                raise MappingConflict(f"{key!r} is ASCII and stands for itself")
            if self.rules.setdefault(key, to) != to:
                raise MappingConflict(f"{key!r} goes to {self.rules[key]!r} and to {to!r}")
        for key, to in self.rules.items():
            node = self.root
            for c in key:
                node = node.setdefault(c, {})
            node[""] = to
        for key, to in self.rules.items():
            if (again := self.rewrite(to)) != to:
                raise MappingConflict(f"{key!r} goes to {to!r}, which goes to {again!r}")

    def rewrite(self, text: str) -> str:
        out, i, n = [], 0, len(text)
        while i < n:
            node, to, end, j = self.root, None, i, i
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                if "" in node:
                    to, end = node[""], j
            if to is None:
                out.append(text[i])
                i += 1
            else:
                out.append(to)
                i = end
        return "".join(out)


class Transducer:
    """Rewrites text in one pass, a grapheme cluster at a time.

    Clusters are those of Unicode (extended grapheme clusters): a character with the
    combining, spacing and invisible ones that follow it, a Hangul syllable in whichever
    spelling, a joined sequence. The scanner stops only at runs of non-ASCII characters
    (with the ASCII one before, which they may belong to). A cluster is decomposed, its
    characters are rewritten by the longest rules that fit, and the result is composed
    again, so the order and spelling of accents don't matter. The rules are compiled into a
    trie and checked for conflicts beforehand; outputs of clusters and runs are kept.
    """

    def __init__(self, rules: Iterable[tuple[str, str]] | None = None):
        self.trie = Trie(_rules() if rules is None else rules)
        self.cluster = regex.compile(r"\X")
        self.region = re.compile("[\x00-\x7f]?[^\x00-\x7f]+")
        self.out: dict[str, str] = {}
        self.seen: dict[str, str] = {}

    def _region(self, m: re.Match) -> str:
        s = m[0]
        to = self.seen.get(s)
        if to is None:
            to = "".join(map(self._cluster, self.cluster.findall(s)))
            # Parts of a syllable that invisible characters held apart, or that were rewritten, meet here.
            to = unicodedata.normalize("NFC", to)
            if len(self.seen) < 1 << 20:
                self.seen[s] = to
        return to

    def _cluster(self, s: str) -> str:
        if s.isascii():
            return s
        to = self.out.get(s)
        if to is None:
            # Once as it is spelt (a character may have a rule of its own), once taken apart.
            to = self.trie.rewrite(unicodedata.normalize("NFD", self.trie.rewrite(unicodedata.normalize("NFC", s))))
            to = unicodedata.normalize("NFC", to)
            if len(self.out) < 1 << 20:
                self.out[s] = to
        return to

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        return self.region.sub(self._region, text)


_shared: Transducer | None = None


def transducer() -> Transducer:
    """This process's transducer."""
    global _shared
    if _shared is None:
        _shared = Transducer()
    return _shared


@F.pandas_udf(StringType())
def _one_form(text: pd.Series) -> pd.Series:
    change = transducer()
    return text.map(lambda t: None if t is None else change(t)).astype(object)


def one_form(col):
    """Column: the text in its one form. NULL stays NULL, '' stays ''; idempotent."""
    return _one_form(F.col(col) if isinstance(col, str) else col)


def looks(df: DataFrame, key: str = "id", text: str = "path") -> DataFrame:
    """(id, t, form): each row's text and its one form; only non-ASCII texts go through Python, once."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("t")).filter("id is not null and t is not null")
    plain = F.octet_length("t") == F.length("t")
    told = spill(rows.filter(~plain).withColumn("form", one_form("t")))
    return rows.filter(plain).withColumn("form", F.col("t")).unionByName(told)


def same_looking(df: DataFrame, key: str = "id", text: str = "path") -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts differ in characters but look the same.

    Two texts that are both in their one form already are either equal or look different,
    so each pair has a changed member: the changed rows alone are joined, by the form, with
    all rows. Equal texts under several ids make no pair with each other. NULL keys or
    texts are no row; other columns are not read. An empty table gives no pairs.

    All pairs of a set come out, so the result grows with the square of the largest set;
    look_classes tells the same in one row per row of the table.
    """
    whole = looks(df, key, text)
    a = whole.filter("form != t").select(F.col("id").alias("a"), F.col("t").alias("ta"), "form")
    b = whole.select(F.col("id").alias("b"), F.col("t").alias("tb"), (F.col("form") != F.col("t")).alias("moved"), "form")
    pairs = a.join(b, "form").filter((F.col("ta") != F.col("tb")) & (~F.col("moved") | (F.col("a") < F.col("b"))))
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def look_classes(df: DataFrame, key: str = "id", text: str = "path") -> DataFrame:
    """(id, class_id, links): of each row that looks like a different text, the smallest id of its set and its number of links.

    Links go to rows with another text of the same look, as in same_looking, but nothing is
    paired: the sizes of sets and of equal texts in them are counted before they are joined.
    """
    whole = looks(df, key, text)
    texts = whole.groupBy("form", "t").agg(F.count("*").alias("same"), F.min("id").alias("first"))
    sets = texts.groupBy("form").agg(F.sum("same").alias("all"), F.min("first").alias("class_id"), F.count("*").alias("texts"))
    rows = whole.join(texts, ["form", "t"]).join(sets.filter("texts > 1"), "form")
    return rows.select("id", "class_id", (F.col("all") - F.col("same")).alias("links"))
