"""Figures as people read them."""

from __future__ import annotations

from datetime import datetime, timezone


def human_size(n: int) -> str:
    """Bytes in steps of 1000."""
    size, units = float(max(0, n)), ["B", "KB", "MB", "GB", "TB", "PB"]
    while size >= 1000 and len(units) > 1:
        size /= 1000
        units.pop(0)
    return f"{size:.0f} {units[0]}" if units[0] == "B" else f"{size:.1f} {units[0]}"


def group_thousands(n: int) -> str:
    return f"{n:,}".replace(",", " ")


def clock(seconds: float) -> str:
    """h:mm:ss, or m:ss below an hour."""
    h, rest = divmod(int(max(0, seconds)), 3600)
    m, s = divmod(rest, 60)
    return f"{h}:{m:02}:{s:02}" if h else f"{m}:{s:02}"


def ago(then: int, now: int) -> str:
    """How long since, in the largest whole unit."""
    gone = max(0, now - then)
    for unit, size in (("day", 86_400), ("hour", 3_600), ("minute", 60)):
        if gone >= size:
            n = gone // size
            return f"{n} {unit}{'s' * (n > 1)} ago"
    return "just now"


def when(mtime: int) -> str:
    return datetime.fromtimestamp(mtime, timezone.utc).strftime("%Y-%m-%d %H:%M")


def rate(n: float, seconds: float) -> str:
    return f"{n / seconds:.1f}/s" if seconds > 0 else "-"


def shorten_middle(text: str, most: int) -> str:
    """At most so many characters, the middle left out."""
    if len(text) <= most or most < 1:
        return text
    head = most // 2
    tail = most - 1 - head
    return f"{text[:head]}…{text[len(text) - tail:] if tail else ''}"


def ignore_patterns(path: str) -> list[str]:
    """Ignore patterns a hit suggests: its extension, its name, its folder."""
    folder, _, name = path.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    return ([f"*.{ext}"] if dot and stem else []) + [name, f"{folder}/*"]
