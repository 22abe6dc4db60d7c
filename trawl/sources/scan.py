"""Directory trees as DataFrames, and file heads as hashes."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from trawl.functions.text import hidden, ignored, name_of, parent_of
from trawl.model import Config

_SCHEMA = "root string, path string, name string, parent string, size long, mtime long, aliased boolean, unreadable boolean"


def binary_scan(spark: SparkSession, roots: Sequence[str], config: Config | None = None, content: bool = False) -> DataFrame:
    """Files below roots on any Hadoop file system: path, name, parent, size, mtime, perhaps content.

    Listing is Spark's; hidden and ignored paths are left out by a filter. Without `content`
    no file is opened.
    """
    config = config or Config()
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([r.rstrip("/") for r in dict.fromkeys(roots)])
    path = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^file:/+", "/")
    rows = rows.select(
        path.alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"),
        *([F.col("content")] if content else []),
    )
    keep: Column = F.lit(False)
    for r in roots:
        base = r.rstrip("/")
        inside = F.col("path").startswith(base + "/") & ~ignored(F.col("path"), config.ignore, base)
        keep = keep | (inside if config.include_hidden else inside & ~hidden(F.col("path"), base))
    rows = rows.filter(keep).dropDuplicates(["path"])
    return rows.select("path", name_of(F.col("path")).alias("name"), parent_of(F.col("path")).alias("parent"), *[c for c in rows.columns if c != "path"])


class _Folder(InputPartition):
    def __init__(self, root: str, paths: list[str], deep: bool):
        self.root, self.paths, self.deep = root, paths, deep


class _TreeReader(DataSourceReader):
    """Tasks of a few folders each; ignored and hidden folders are not entered.

    The driver lists the top levels, one after another, until there are `tasks` folders to
    walk or no more; so one deep root is many tasks as well. `paths`, if given, are looked
    at themselves, files by their status alone, folders with all beneath them.
    """

    def __init__(self, options):
        import json

        self.roots = [os.path.realpath(r) for r in json.loads(options["roots"])]
        self.paths = json.loads(options.get("paths", "null"))
        self.ignore = json.loads(options.get("ignore", "[]"))
        self.hidden = options.get("hidden", "false") == "true"
        self.follow = options.get("follow", "false") == "true"
        self.tasks = int(options.get("tasks", "64"))

    def partitions(self):
        if self.paths is not None:
            size = max(1, -(-len(self.paths) // self.tasks))
            return [_Folder(self._root_of(self.paths[i]), self.paths[i : i + size], True) for i in range(0, len(self.paths), size)]
        out: list[InputPartition] = []
        for root in dict.fromkeys(self.roots):
            level, listed, seen = [root], [], {root}
            while level and len(level) < self.tasks:
                listed += level
                below = []
                for folder in level:
                    try:
                        with os.scandir(folder) as entries:
                            inner = [e.path for e in entries if self._enters(root, e)]
                    except OSError:
                        inner = []  # told by the shallow read of the folder
                    for path in sorted(inner):
                        if (real := os.path.realpath(path)) not in seen:
                            seen.add(real)
                            below.append(path)
                level = below
            out += [_Folder(root, listed[i::8], False) for i in range(min(8, len(listed)))]
            out += [_Folder(root, level[i :: self.tasks], True) for i in range(min(self.tasks, len(level)))]
        return out

    def _root_of(self, path: str) -> str:
        return max((r for r in self.roots if path == r or path.startswith(r + "/")), key=len, default=os.path.dirname(path))

    def _kept(self, root: str, path: str) -> bool:
        import fnmatch

        rel = path[len(root) + 1 :]
        name = rel.rsplit("/", 1)[-1]
        if name.startswith(".") and not self.hidden:
            return False
        for p in self.ignore:
            p = p.rstrip("/\\") or p
            if fnmatch.fnmatchcase(name if "/" not in p else path, p):
                return False
        return True

    def _enters(self, root: str, e: os.DirEntry) -> bool:
        return e.is_dir(follow_symlinks=self.follow) and self._kept(root, e.path)

    def _row(self, root: str, path: str, linked: bool) -> tuple:
        target = os.path.realpath(path) if linked else path
        st = os.stat(target)
        return (root, target, os.path.basename(target), os.path.dirname(target), st.st_size, int(st.st_mtime), linked, False)

    def read(self, part: _Folder) -> Iterator[tuple]:
        for start in part.paths:
            root = part.root if self.paths is None else self._root_of(start)
            if self.paths is not None and not os.path.isdir(start):
                try:
                    yield self._row(root, start, os.path.islink(start))
                except OSError:
                    pass  # not there: told by its absence
                continue
            yield from self._walk(root, start, part.deep)

    def _walk(self, root: str, start: str, deep: bool) -> Iterator[tuple]:
        # A link back to a folder above ends a way down; one to another part of the tree is walked there again, and
        # its files come out once, as all paths do.
        todo = [(start, frozenset())]
        while todo:
            folder, above = todo.pop()
            real = os.path.realpath(folder)
            if real in above:
                continue
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                yield (root, folder, os.path.basename(folder), os.path.dirname(folder), None, None, False, True)
                continue
            for e in entries:
                if not self._kept(root, e.path):
                    continue
                try:
                    if e.is_dir(follow_symlinks=self.follow):
                        if deep:
                            todo.append((e.path, above | {real} if self.follow else above))
                    elif e.is_file(follow_symlinks=self.follow):
                        yield self._row(root, e.path, e.is_symlink())
                except OSError:
                    yield (root, e.path, e.name, folder, None, None, False, True)


class TreeSource(DataSource):
    """A pruned walk of local or mounted trees: spark.read.format("trawl_tree")."""

    @classmethod
    def name(cls):
        return "trawl_tree"

    def schema(self):
        return _SCHEMA

    def reader(self, schema: StructType):
        return _TreeReader(self.options)


def tree_scan(spark: SparkSession, config: Config, paths: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, unreadable folders) below the roots of the settings, or at and below `paths` only. Each path once, over all roots."""
    import json

    spark.dataSource.register(TreeSource)
    only = {} if paths is None else {"paths": json.dumps(list(paths))}
    rows = (
        spark.read.format("trawl_tree").option("roots", json.dumps(list(config.roots))).option("ignore", json.dumps(list(config.ignore)))
        .option("hidden", str(config.include_hidden).lower()).option("follow", str(config.follow_symlinks).lower())
        .option("tasks", str(8 * spark.sparkContext.defaultParallelism)).options(**only).load()
    )
    files = rows.filter("not unreadable").drop("unreadable", "root").dropDuplicates(["path"])
    return files, rows.filter("unreadable").select("path").distinct()


def entry_count(spark: SparkSession, config: Config) -> int:
    """How many files a full run will come to, for its progress; nothing is opened."""
    return tree_scan(spark, config)[0].count()


def head_hash(size: Column, head: Column, length: int = 8 * 1024) -> Column:
    """SHA-256 of the size, as 8 bytes from the lowest, and the first `length` bytes."""
    hex16 = F.lpad(F.hex(size), 16, "0")
    little = F.unhex(F.concat(*[F.substring(hex16, 15 - 2 * i, 2) for i in range(8)]))
    return F.unhex(F.sha2(F.concat(little, F.substring(head, 1, length)), 256))


def classify(scan: DataFrame, files: DataFrame) -> DataFrame:
    """scan with `action`: skip for an unchanged mtime, update for another, insert for a new path."""
    known = files.select("path", F.col("mtime").alias("__mtime"), F.lit(True).alias("__known"))
    action = F.when(F.col("__known").isNull(), "insert").when(F.col("__mtime").eqNullSafe(F.col("mtime")), "skip").otherwise("update")
    return scan.join(known, "path", "left").withColumn("action", action).drop("__mtime", "__known")
