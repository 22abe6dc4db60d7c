"""Text expressions that stay in the JVM."""

from __future__ import annotations

import fnmatch
import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_TO_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def ascii_lower(text: str) -> str:
    return text.translate(_TO_LOWER)


def ascii_fold(col: Column | str) -> Column:
    """Lower case for A to Z only; other letters keep their case."""
    return F.translate(F.col(col) if isinstance(col, str) else col, string.ascii_uppercase, string.ascii_lowercase)


def quoted(text: str) -> str:
    """A Java pattern for the text as it stands."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def like_escaped(text: str) -> str:
    """The text as a LIKE pattern that means itself, for ESCAPE '\\\\'."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def root_path(path: str) -> str:
    """A root as catalog paths begin: absolute, links and dots resolved, no separator at the end."""
    import os

    return os.path.realpath(os.path.expanduser(path)).rstrip("/")


def contains_any_case(col: Column, *texts: str) -> Column:
    """One of the texts occurs, ASCII case ignored.

    Java's (?i) without (?u) folds ASCII only, and one scan costs a fraction of folding the
    whole column first.
    """
    return F.regexp_like(col, F.lit("(?i)" + "|".join(map(quoted, texts))))


def count_any_case(col: Column, text: str) -> Column:
    """Occurrences that don't overlap, ASCII case ignored."""
    return F.regexp_count(col, F.lit("(?i)" + quoted(text)))


def count_literal(col: Column, text: str) -> Column:
    """Occurrences of a literal that don't overlap."""
    return ((F.length(col) - F.length(F.replace(col, F.lit(text), F.lit("")))) / F.lit(len(text))).cast("int")


def count_fraction(n: Column) -> Column:
    """0 to 1, smaller for more occurrences; saturates at 1000."""
    return (F.lit(1000) - F.least(n, F.lit(1000))) / F.lit(1000.0)


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def extension_of(name: Column) -> Column:
    """Lower case, without the dot; '' for none and for dot files."""
    return ascii_fold(F.regexp_extract(name, r"[^.].*\.([^.]*)$", 1))


def ancestors(path: Column) -> Column:
    """All folders above a path, topmost first."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts) - 1)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "/"),
    )


def under(path: Column, folder: str) -> Column:
    """The path lies in the folder, at any depth; a range, so it prunes row groups."""
    base = folder.rstrip("/")
    return (path >= base + "/") & (path < base + "0")


def below(path: Column, root: str) -> Column:
    """What follows the root in a path under it."""
    return F.substring(path, len(root.rstrip("/")) + 1, 1 << 30) if root else path


def ignored(path: Column, patterns: tuple[str, ...] | list[str], root: str = "") -> Column:
    """The path is ignored: a pattern without separator fits one of its components below the
    root, or a pattern with one fits the path or a folder above it. '*' crosses separators."""
    component, whole, literal = [], [], []
    for p in (p.strip() for p in patterns):
        p = p.rstrip("/\\") or p
        if not p or p.startswith("#"):
            continue
        if "/" in p or "\\" in p:
            whole.append(p.replace("\\", "/"))
        elif any(c in p for c in "*?["):
            component.append(p)
        else:
            literal.append(p)
    test: Column = F.lit(False)
    parts = F.split(below(path, root), "/")
    if literal:
        test = test | F.arrays_overlap(parts, F.array(*map(F.lit, literal)))
    for p in component:
        test = test | F.exists(parts, _fits(p))
    for p in whole:
        test = test | F.regexp_like(path, F.lit(glob_regex(p)[:-2] + "(?:/.*)?\\z"))
    return test


def _fits(pattern: str):
    return lambda c: F.regexp_like(c, F.lit(glob_regex(pattern)))


def glob_regex(pattern: str) -> str:
    """An anchored Java pattern for a glob."""
    body = fnmatch.translate(pattern)
    body = re.sub(r"^\(\?s:(.*)\)\\[Zz]$", r"\1", body, flags=re.S)
    return f"(?s)\\A{body}\\z"


def hidden(path: Column, root: str = "") -> Column:
    """A component below the root begins with a dot; the root itself is exempt."""
    return F.exists(F.split(below(path, root), "/"), lambda c: c.startswith("."))
