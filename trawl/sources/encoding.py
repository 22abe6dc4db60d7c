"""Bytes to text: byte order marks, UTF-8, legacy encodings by what reads best; binary is no text."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_CONTROL = bytes(b for b in range(32) if b not in (7, 8, 9, 10, 12, 13, 27))


def encoding_of(data: bytes, cut: bool = False) -> str | None:
    """The encoding of some bytes, None for binary. `cut`: a character may be cut off at the end.

    NUL bytes, or more than a tenth of control characters, are binary. Without a byte order
    mark text is UTF-8 if it is valid, else the legacy encoding it reads best in.
    """
    for mark, name in _MARKS:
        if data.startswith(mark):
            return name
    if b"\0" in data or len(data.translate(None, _CONTROL)) < 0.9 * len(data):
        return None
    try:
        codecs.getincrementaldecoder("utf-8")().decode(data, not cut)
        return "utf-8"
    except UnicodeDecodeError:
        return legacy_encoding(data)


# The letters written most in languages of each one-byte encoding.
_LETTERS = {
    "cp1252": "éèàùâêîôûçëïäöüßñáíóúãõåæøìò¿¡«»’“”–…°§", "cp1250": "ąćęłńóśźżáčďéěíňřšťúůýžőűăâîşţđ",
    "cp1251": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфё", "koi8-r": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфё", "cp866": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфё",
    "cp1253": "αοιετσνηυρπκμλςωίόάέύήώ", "cp1255": "אבגדהוזחטיכלמנסעפצקרשתםןץףך", "cp1254": "ıİşŞğĞçöü",
}
_ORDER = ("cp1252", "cp1250", "cp1251", "koi8-r", "cp866", "cp1253", "cp1255", "cp1254", "cp932", "euc_jp", "gbk", "big5", "euc_kr")


def _typical(ch: str, raw: bytes, name: str) -> float:
    """How much a non-ASCII character speaks for an encoding, 1 at most."""
    if name in _LETTERS:
        return 1.0 if ch in _LETTERS[name] else 0.4 if ch.lower() in _LETTERS[name] else -0.5 if ch.isalpha() else -1.0
    cp = ord(ch)
    if name in ("cp932", "euc_jp"):  # kana run through all Japanese text
        return 1.2 if 0x3041 <= cp <= 0x30FC else 0.6 if 0x4E00 <= cp < 0xA000 or 0x3000 <= cp < 0x3003 else -1.0
    if name == "euc_kr":
        return 1.1 if 0xAC00 <= cp < 0xD7A4 else -0.5  # syllables of Korean are common characters of Chinese as well
    level = raw[0]  # the first byte tells the frequent characters from the rare ones
    often = 0xB0 <= level <= 0xD7 and raw[-1] >= 0xA1 if name == "gbk" else 0xA4 <= level <= 0xC6
    return 1.0 if often else 0.5 if 0x3000 <= cp < 0x3020 or 0xFF00 <= cp < 0xFF60 else -1.0


def legacy_encoding(data: bytes, most: int = 1 << 16) -> str:
    """The encoding some bytes that are no UTF-8 read best in; Windows-1252 if none reads well.

    Each candidate that can decode the bytes is judged by how typical its characters are.
    Western letters stand among ASCII ones, others mostly among their like; words that mix
    the case the wrong way round speak against a reading. Judged are the first `most` bytes;
    an encoding is a property of the file.
    """
    head, best, top = data[:most], "cp1252", 0.0
    for name in _ORDER:
        try:
            text = codecs.getincrementaldecoder(name)("strict").decode(head, len(head) == len(data))
        except UnicodeDecodeError:
            continue
        score, n, last = 0.0, 0, " "
        for ch in text:
            if ch > "\x7f":
                n += 1
                score += _typical(ch, ch.encode(name, "replace"), name)
                if name in _LETTERS:
                    near = last > "\x7f" or not last.isalpha()
                    score += (-0.3 if last > "\x7f" and last.isalpha() else 0.0) if name in ("cp1252", "cp1250", "cp1254") else (0.2 if near else -1.0)
                    score -= 1.0 if ch.isupper() and last.islower() else 0.0
            last = ch
        if n and score / n > top:
            best, top = name, score / n
    return best


def decode(data: bytes) -> str:
    """The text of a whole file; ValueError for binary."""
    name = encoding_of(data)
    if name is None:
        raise ValueError("text looks binary")
    for mark, _ in _MARKS:
        if data.startswith(mark):
            data = data[len(mark) :]
            break
    return data.decode(name, "replace")


def looks_like_text(head: Column) -> Column:
    """The head of a file reads as text; an empty one does not."""

    @F.pandas_udf(BooleanType())
    def test(heads: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in heads:
            yield pd.Series([bool(x) and encoding_of(bytes(x), True) is not None for x in h], dtype=bool)

    return test(head)
