"""Structured filters over the catalog, as Columns that reach the scan."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.text import ascii_fold, ascii_lower
from trawl.model import FileType
from trawl.query.errors import BadDate, UnknownProperty, UnsupportedOp
from trawl.query.lexer import Op

_ALIASES = {
    "type": "type", "modified": "modified", "mtime": "modified", "path": "path", "folder": "path",
    "includefolder": "path", "name": "name", "filename": "name", "mime": "mime",
}
_DAY = 86_400


def is_filter_key(word: str) -> bool:
    return word.lower() in _ALIASES


def day_start(text: str) -> int:
    """Unix seconds of a day's midnight, UTC; Y-M-D, padded or not, 1970 to 9999."""
    m = re.fullmatch(r"(\d{1,4})-(\d{1,2})-(\d{1,2})", text.strip(), re.A)
    try:
        d = date(*map(int, m.groups())) if m else None
    except ValueError:
        d = None
    if d is None or d.year < 1970:
        raise BadDate(f"not a date: {text}")
    return (d - date(1970, 1, 1)) // timedelta(days=1) * _DAY


def build_filter(key: str, op: str, value: str, glob: bool = False) -> Column:
    """One condition. `glob`: stars of an unquoted name are wildcards."""
    kind = _ALIASES.get(key.lower())
    if kind is None:
        raise UnknownProperty(key)
    allowed = {"modified": tuple(Op), "name": (Op.CONTAINS,)}.get(kind, (Op.CONTAINS, Op.EQUAL))
    if op not in allowed:
        raise UnsupportedOp(key, op)
    if kind == "type":
        bits = FileType.named(value)
        if bits is None:
            raise UnknownProperty(f"type {value}")
        return F.col("type").bitwiseAND(int(bits)) != 0
    if kind == "modified":
        at, mtime = day_start(value), F.col("mtime")
        if op in (":", "="):
            return (mtime >= at) & (mtime < at + _DAY)
        return {"<": mtime < at, "<=": mtime <= at, ">": mtime > at, ">=": mtime >= at}[op]
    if kind == "path":
        base = value.strip().rstrip("/\\")
        if not base:
            return F.lit(True)
        return (F.col("parent") == base) | ascii_fold("parent").startswith(ascii_lower(base) + "/")
    if kind == "name":
        name = ascii_fold("name")
        if not (glob and "*" in value):
            return name.contains(ascii_lower(value))
        pieces = [re.sub(r"([%_\\])", r"\\\1", p) for p in ascii_lower(value).split("*")]
        return name.like(f"%{'%'.join(pieces)}%")
    return F.col("mime") == value
