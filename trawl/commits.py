"""Commit files: small files that appear whole, and never in the place of another."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# File systems whose rename is one step at the name node and refuses a target that exists.
_RENAMES = ("hdfs", "viewfs", "abfs", "abfss")


class Taken(RuntimeError):
    """Another writer made the commit of that number first."""


class Folder:
    """A folder of numbered commit files on a Hadoop file system.

    A commit is written under another name and then given its own: by a hard link on local
    disks, by a rename where the file system refuses an existing target in the same step.
    Of any number of writers of one number exactly one succeeds. Other file systems (object
    stores whose rename copies and deletes) are refused when a commit is made, since two
    writers could both succeed there.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self._path(f"{self.base}/{name}" if name else self.base)

    def make(self) -> None:
        self.fs.mkdirs(self.path())

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path())] if self.fs.exists(self.path()) else []

    def numbers(self) -> list[int]:
        return sorted(int(n[7:-5]) for n in self.names() if n.startswith("commit-") and n.endswith(".json"))

    def read(self, number: int) -> str:
        stream = self.fs.open(self.path(f"commit-{number}.json"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, number: int, content: str) -> None:
        """Make the commit of that number, or raise Taken."""
        scheme, name = self.fs.getUri().getScheme(), f"commit-{number}.json"
        draft = f".draft-{uuid.uuid4().hex}"
        if scheme == "file":
            local = self.fs.makeQualified(self.path()).toUri().getPath()
            draft, name = os.path.join(local, draft), os.path.join(local, name)
            with open(draft, "w") as f:
                f.write(content)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(draft, name)
            except FileExistsError:
                raise Taken(f"commit {number} was made by another writer") from None
            finally:
                os.unlink(draft)
            return
        if scheme not in _RENAMES:
            raise RuntimeError(f"no commit can be made safely on {scheme}: its rename is not one step")
        stream = self.fs.create(self.path(draft), False)
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()
        if not self.fs.rename(self.path(draft), self.path(name)):
            self.fs.delete(self.path(draft), False)
            raise Taken(f"commit {number} was made by another writer")
