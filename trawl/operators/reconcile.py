"""Keeping the catalog what the settings say it is."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import extension_of, hidden, ignored, under
from trawl.model import Config, ContentState
from trawl.operators import tables


@dataclass(frozen=True)
class IndexWork:
    """What a change of settings asks for."""

    rebuild: bool = False
    drop_roots: frozenset[str] = frozenset()
    prune_scope: bool = False
    drop_aliases: bool = False
    reconcile_content: bool = False
    restore_text: bool = False
    drop_text: bool = False
    reindex: bool = False

    @property
    def nothing(self) -> bool:
        return self == IndexWork()

    def merge(self, other: IndexWork) -> IndexWork:
        """Both pieces of work; storing text again and dropping it: the later one counts."""
        both = {f: getattr(self, f) | getattr(other, f) for f in self.__dataclass_fields__}
        if other.restore_text and not other.drop_text:
            both["drop_text"] = False
        if other.drop_text and not other.restore_text:
            both["restore_text"] = False
        return IndexWork(**both)


def _set(values: Iterable[str]) -> frozenset[str]:
    return frozenset(v.strip().rstrip("/\\") or v.strip() for v in values if v.strip() and not v.strip().startswith("#"))


def _extensions(config: Config) -> frozenset[str]:
    return frozenset(e.strip().lower().lstrip(".") for e in config.content_extensions if e.strip() and not e.strip().startswith("#"))


def diff_actions(old: Config, new: Config) -> IndexWork:
    """The work between two settings. Order and spelling of lists don't matter."""
    if old.hash_length != new.hash_length or old.tokenize != new.tokenize:
        return IndexWork(rebuild=True)
    roots = _set(old.roots), _set(new.roots)
    globs = _set(old.ignore), _set(new.ignore)
    exts = _extensions(old), _extensions(new)
    widened = exts[0] != exts[1] and (not exts[1] or bool(exts[0] and exts[1] - exts[0]))
    return IndexWork(
        drop_roots=roots[0] - roots[1],
        prune_scope=bool(globs[1] - globs[0]) or (old.include_hidden and not new.include_hidden),
        drop_aliases=old.follow_symlinks and not new.follow_symlinks,
        reconcile_content=exts[0] != exts[1],
        restore_text=new.store_text and not old.store_text,
        drop_text=old.store_text and not new.store_text,
        reindex=bool(roots[1] - roots[0])
        or bool(globs[0] - globs[1])
        or (new.include_hidden and not old.include_hidden)
        or (new.follow_symlinks and not old.follow_symlinks)
        or (new.store_text and not old.store_text)
        or widened,
    )


def nested_roots(roots: Iterable[str]) -> list[tuple[str, str]]:
    """(inner, outer) for every root that lies in another, or is listed twice."""
    roots = [r.rstrip("/") for r in roots]
    return [
        (a, b) for i, a in enumerate(roots) for j, b in enumerate(roots)
        if i != j and (a.startswith(b + "/") or (a == b and i > j))
    ]


def covers(config: Config, path: Column) -> Column:
    """A walk under these settings would still come to this path."""
    inside: Column = F.lit(False)
    for root in config.roots:
        here = under(path, root) & ~ignored(path, config.ignore, root)
        if not config.include_hidden:
            here = here & ~hidden(path, root)
        inside = inside | here
    return inside


def content_allowed(config: Config, name: Column) -> Column:
    """The extension is on the list of those to extract; an empty list allows all, '(none)' files without one."""
    exts = _extensions(config)
    if not exts:
        return F.lit(True)
    ext = extension_of(name)
    return ext.isin(*sorted(exts - {"(none)"})) | (F.lit("(none)" in exts) & (ext == ""))


def reconcile(
    files: DataFrame, texts: DataFrame, failed: DataFrame, config: Config, work: IndexWork, extractable: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, texts, failed) with the work done that needs no disk: whole tables by three conditions.

    Files out of scope go, with what depends on them. Files that need no content lose it;
    files that need it and were left out become pending again, failed ones stay failed.
    """
    keep: Column = F.lit(True)
    for root in work.drop_roots:
        keep = keep & (~under(F.col("path"), root) | covers(config, F.col("path")))
    if work.prune_scope:
        keep = keep & covers(config, F.col("path"))
    if work.drop_aliases and "aliased" in files.columns:
        keep = keep & ~F.coalesce("aliased", F.lit(False))
    out = files.filter(keep)
    wants = (F.col("size") <= config.maximum_text_file_size) & content_allowed(config, F.col("name"))
    if extractable is not None:
        wants = wants & extractable
    wants = F.coalesce(wants, F.lit(False))
    state = F.col("content_state")
    if work.reconcile_content or work.restore_text:
        again = wants & ((state == ContentState.NOT_APPLICABLE) | (F.lit(work.restore_text) & (state == ContentState.DONE)))
        new = F.when(~wants, F.lit(int(ContentState.NOT_APPLICABLE))).when(again, F.lit(int(ContentState.PENDING))).otherwise(state)
        out = out.withColumn("content_state", new)
    texts = tables.dependents(texts, out.filter(F.col("content_state") != ContentState.NOT_APPLICABLE))
    if work.drop_text:
        texts = texts.filter("false")
    return out, texts, tables.dependents(failed, out.filter(F.col("content_state") == ContentState.FAILED))


def stale(files: DataFrame, scan: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """(path): catalog rows a finished scan did not come to.

    Nothing under a folder that could not be read is stale, nor are aliased rows: absence
    there proves nothing. `unreadable` has (path) of such folders; they are matched with the
    folders above each candidate, by key, not by comparing all pairs.
    """
    gone = files.join(scan.select("path").distinct(), "path", "left_anti")
    if "aliased" in files.columns:
        gone = gone.filter(~F.coalesce("aliased", F.lit(False)))
    if unreadable is not None:
        from trawl.functions.text import ancestors

        above = gone.select("path", F.explode(ancestors(F.col("path"))).alias("folder"))
        shielded = above.join(unreadable.select(F.col("path").alias("folder")), "folder", "left_semi").select("path").distinct()
        gone = gone.join(shielded, "path", "left_anti")
    return gone.select("path")


@dataclass
class Fingerprint:
    """Under which settings the catalog was built; kept in its meta table."""

    config: Config = field(default_factory=Config)
    KEYS = ("hash_length", "tokenize", "roots", "ignore", "content_extensions", "include_hidden", "follow_symlinks", "store_text")

    def rows(self) -> list[tuple[str, str]]:
        import json

        return [(f"config.{k}", json.dumps(getattr(self.config, k))) for k in self.KEYS]

    @classmethod
    def read(cls, meta: dict[str, str]) -> Fingerprint:
        import json

        known = {k: json.loads(meta[f"config.{k}"]) for k in cls.KEYS if f"config.{k}" in meta}
        return cls(replace(Config(), **{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()}))

    def conflicts(self, now: Config) -> list[tuple[str, str, str]]:
        """(key, stored, current) of settings that only a rebuild can change."""
        return [
            (k, str(getattr(self.config, k)), str(getattr(now, k)))
            for k in ("hash_length", "tokenize") if getattr(self.config, k) != getattr(now, k)
        ]
