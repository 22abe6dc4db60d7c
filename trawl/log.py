"""The newest log lines, kept in memory, and warnings that don't flood."""

from __future__ import annotations

import logging
from collections import Counter, deque
from dataclasses import dataclass


@dataclass(frozen=True)
class Line:
    at: float
    level: int
    text: str


class Ring(logging.Handler):
    """A handler that keeps the newest lines; of each kind of warning the first few, then only how many.

    The kind of a warning is its message before its arguments are put in.
    """

    def __init__(self, size: int = 5000, most: int = 20):
        super().__init__()
        self.lines: deque[Line] = deque(maxlen=size)
        self.most, self.seen = most, Counter()

    def emit(self, record: logging.LogRecord) -> None:
        if record.levelno >= logging.WARNING:
            self.seen[record.msg] += 1
            if self.seen[record.msg] > self.most:
                return
        self.lines.append(Line(record.created, record.levelno, record.getMessage()))

    def left_out(self) -> dict[str, int]:
        """How many warnings of a kind were counted only."""
        return {m: n - self.most for m, n in self.seen.items() if n > self.most}

    def shown(self, warnings: bool = False, holding: str = "") -> list[Line]:
        """Lines oldest first; warnings and worse only, or those that hold a text, ASCII case aside."""
        low = holding.lower()
        return [x for x in self.lines if (not warnings or x.level >= logging.WARNING) and low in x.text.lower()]
