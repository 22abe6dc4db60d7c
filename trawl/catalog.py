"""Versioned tables on a Hadoop file system: new rows are written beside the old, then named in one commit."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.commits import Folder
from trawl.model import DOCUMENTS_TEXT, FAILED_FILES, FILES, META

SCHEMA_VERSION = "2"
TABLES = {"files": FILES, "documents_text": DOCUMENTS_TEXT, "failed_files": FAILED_FILES, "meta": META}
KEYS = {"files": "id", "documents_text": "file_id", "failed_files": "file_id", "meta": "key"}
SMALL = 200_000  # keys of a change that may be sent out to where a table is read


class CatalogDrift(RuntimeError):
    """The catalog on disk is of another version."""


@dataclass(frozen=True)
class Change:
    """What becomes of a table: rows that come in, and the keys whose rows go first (theirs included)."""

    rows: DataFrame
    gone: DataFrame


class Catalog:
    """A folder of table parts and numbered commits, each naming the parts every table consists of.

    A table is written whole, or changed by a part of new rows and a part of keys that are
    gone; readers lay the changes over the whole. Readers use the last commit; of two
    writers of the same number one fails (see trawl.commits). `merge` writes tables with
    many changes whole again, old parts go with `compact`. A run that dies leaves parts no
    commit names.
    """

    def __init__(self, spark: SparkSession, base: str, create: bool = True):
        self.spark, self.folder = spark, Folder(spark, base)
        self.base = self.folder.base
        if not self.folder.numbers():
            if not create:
                raise FileNotFoundError(f"no catalog at {base}")
            self.folder.make()
            self.commit({}, 0)
        elif (found := self._read()["version"]) != SCHEMA_VERSION:
            raise CatalogDrift(f"catalog version {found}, expected {SCHEMA_VERSION}; it has to be built anew")

    @classmethod
    def anew(cls, spark: SparkSession, base: str) -> Catalog:
        """The catalog at `base`, emptied if it is of another version. Nothing else empties one unasked."""
        try:
            return cls(spark, base)
        except CatalogDrift:
            folder = Folder(spark, base)
            folder.publish(folder.numbers()[-1] + 1, json.dumps({"version": SCHEMA_VERSION, "tables": {}}))
            return cls(spark, base)

    def _read(self, number: int | None = None) -> dict:
        return json.loads(self.folder.read(self.epoch if number is None else number))

    @property
    def epoch(self) -> int:
        """Number of the last commit; it changes whenever the catalog does."""
        return self.folder.numbers()[-1]

    def table(self, name: str) -> DataFrame:
        parts = self._read()["tables"].get(name, [])
        key, read = KEYS[name], lambda part: self.spark.read.parquet(f"{self.base}/{part}")
        out = None
        for part in parts:
            if out is not None:
                gone = read(part["gone"])
                out = out.join(F.broadcast(gone) if part["keys"] <= SMALL else gone, key, "left_anti")
            out = read(part["rows"]) if out is None else out.unionByName(read(part["rows"]), allowMissingColumns=True)
        return self.spark.createDataFrame([], TABLES[name]) if out is None else out

    def meta(self) -> dict[str, str]:
        return {r.key: r.value for r in self.table("meta").collect()}

    def _write(self, df: DataFrame, name: str) -> str:
        part = f"{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.base}/{part}")
        return part

    def commit(self, tables: Mapping[str, DataFrame | Change], seen: int, fresh: bool = False) -> int:
        """Write tables or changes of them and make them current; those not given stay. `seen` is the epoch they came from."""
        names = {} if fresh or not seen else dict(self._read(seen)["tables"])
        for name, new in tables.items():
            if isinstance(new, Change) and name in names:
                gone = self._write(new.gone.select(KEYS[name]).distinct(), f"{name}-gone")
                part = {"rows": self._write(new.rows, name), "gone": gone, "keys": self.spark.read.parquet(f"{self.base}/{gone}").count()}
                names[name] = [*names[name], part]
            else:
                names[name] = [{"rows": self._write(new.rows if isinstance(new, Change) else new, name)}]
        self.folder.publish(seen + 1, json.dumps({"version": SCHEMA_VERSION, "tables": names}))
        return seen + 1

    def merge(self, slack: int = 16) -> int | None:
        """Write tables with more than `slack` changes whole; the new epoch, None if there are none."""
        seen = self.epoch
        long = [n for n, parts in self._read(seen)["tables"].items() if len(parts) > slack + 1]
        return self.commit({n: self.table(n) for n in long}, seen) if long else None

    def set_meta(self, values: Mapping[str, str]) -> int:
        seen = self.epoch
        return self.commit({"meta": self.meta_rows(self.meta() | dict(values))}, seen)

    def meta_rows(self, values: Mapping[str, str]) -> DataFrame:
        return self.spark.createDataFrame(sorted(values.items()), META)

    def clear(self) -> int:
        return self.commit({}, self.epoch, fresh=True)

    def compact(self, keep: int = 2) -> int:
        """Delete parts that none of the last `keep` commits names; how many."""
        commits = self.folder.numbers()
        named = {
            part[k] for n in commits[-keep:] for parts in self._read(n)["tables"].values() for part in parts for k in ("rows", "gone") if k in part
        }
        gone = 0
        for s in self.folder.fs.listStatus(self.folder.path()):
            name = s.getPath().getName()
            old = name.startswith("commit-") and int(name[7:-5]) not in commits[-keep:]
            if (s.isDirectory() and name not in named) or old:
                gone += s.isDirectory()
                self.folder.fs.delete(s.getPath(), True)
        return gone
