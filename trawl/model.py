"""Schemas, type bits, content states, settings."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from enum import IntEnum, IntFlag

FILES = (
    "id long, name string, path string, parent string, size long, mtime long, mime string, "
    "type int, content_state int, hash binary"
)
DOCUMENTS_TEXT = "file_id long, text string"
FAILED_FILES = "file_id long, reason string, ts long"
META = "key string, value string"
EVENTS = "seq long, ts timestamp, op string, path string, to_path string"
HITS = "file_id long, name string, path string, size long, mtime long, rank double, stage int, match_field string"


class FileType(IntFlag):
    AUDIO = 1
    IMAGE = 2
    VIDEO = 4
    DOCUMENT = 8
    TEXT = 16
    ARCHIVE = 32
    PRESENTATION = 64
    SPREADSHEET = 128
    FOLDER = 256

    @classmethod
    def named(cls, name: str) -> FileType | None:
        return cls.__members__.get(name.strip().upper())


class ContentState(IntEnum):
    PENDING = 0
    DONE = 1
    FAILED = 2
    NOT_APPLICABLE = 3


@dataclass(frozen=True)
class Config:
    """Settings with their defaults; `load` merges a TOML file over them."""

    roots: tuple[str, ...] = ()
    ignore: tuple[str, ...] = (".git", "node_modules", "*.tmp", ".venv", "venv")
    content_extensions: tuple[str, ...] = ()
    include_hidden: bool = False
    follow_symlinks: bool = False
    hash_length: int = 8 * 1024
    maximum_text_size: int = 256 * 1024
    maximum_text_file_size: int = 2 * 1024 * 1024
    tokenize: str = "trigram"
    store_text: bool = True
    display_limit: int = 1000
    fuzzy_default: bool = False
    fuzzy_max_edits: int = 2
    auto_index: bool = True
    interval_minutes: int = 60

    def __post_init__(self):
        if self.tokenize.split()[0] != "trigram":
            raise ValueError(f"tokenizer {self.tokenize!r} is not supported, only trigram")
        if self.fuzzy_max_edits > 3:
            import warnings

            warnings.warn("more than 3 edits match nearly anything", stacklevel=2)

    @classmethod
    def load(cls, path: str) -> Config:
        """Settings of a TOML file, in sections or flat; unknown keys are an error; ~ is expanded."""
        with open(os.path.expanduser(path), "rb") as f:
            doc = tomllib.load(f)
        flat = {}
        for key, value in doc.items():
            flat |= value if isinstance(value, dict) else {key: value}
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(flat) - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        flat = {k: tuple(v) if isinstance(v, list) else v for k, v in flat.items()}
        if "roots" in flat:
            flat["roots"] = tuple(os.path.expanduser(r) for r in flat["roots"])
        return cls(**flat)


    def save(self, path: str) -> None:
        """All settings as TOML; load() gives them back."""
        import json

        lines = []
        for f in fields(self):
            v = getattr(self, f.name)
            # JSON strings, numbers, booleans and lists of strings are TOML as well.
            lines.append(f"{f.name} = {json.dumps(list(v) if isinstance(v, tuple) else v, ensure_ascii=False)}")
        with open(os.path.expanduser(path), "w", encoding="utf-8") as out:
            out.write("\n".join(lines) + "\n")

    @classmethod
    def place(cls, catalog: str) -> str:
        """Where the settings of a catalog lie: beside it if such a file is there (portable), else in the user's settings."""
        beside = os.path.join(catalog, "trawl.toml")
        return beside if os.path.exists(beside) else os.path.expanduser("~/.config/trawl/trawl.toml")


@dataclass
class Outcome:
    """How a search ended: rows returned, and whether more matched."""

    total: int = 0
    limited: bool = False
    columns: list[str] = field(default_factory=list)

    def label(self) -> str:
        return f"{self.total}+" if self.limited else str(self.total)
