"""Results that come in parts, can be called off, and are kept in step with the catalog."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from trawl.operators import search


def admit(kept: Iterable, found: Iterable, limit: int) -> list:
    """The best `limit` of two lists of hits by rank and path, each file once."""
    best: dict = {}
    for r in (*kept, *found):
        was = best.get(r.file_id)
        if was is None or (r.rank, r.path) < (was.rank, was.path):
            best[r.file_id] = r
    return sorted(best.values(), key=lambda r: (r.rank, r.path))[:limit]


@dataclass
class Search:
    """A search whose hits come as they are found: names and paths first, then those in bodies.

    `parts` yields what is best so far, `limit` hits at most; the last part is the result.
    `cancel`, from any thread, ends the running jobs; the search then yields no more.
    """

    files: DataFrame
    texts: DataFrame | None
    text: str
    limit: int = search.DEFAULT_LIMIT
    options: dict = field(default_factory=dict)
    cancelled: bool = False

    def __post_init__(self):
        self.tag = f"search-{uuid.uuid4().hex}"

    def parts(self) -> Iterator[list[Row]]:
        spark, kept = self.files.sparkSession, []
        spark.addTag(self.tag)
        try:
            for texts in (None, self.texts) if self.texts is not None else (None,):
                if self.cancelled:
                    return
                try:
                    found = search.search(self.files, texts, self.text, self.limit, **self.options).collect()
                except Exception:
                    if self.cancelled:
                        return
                    raise
                kept = admit(kept, found, self.limit)
                yield kept
        finally:
            spark.removeTag(self.tag)

    def cancel(self) -> None:
        self.cancelled = True
        self.files.sparkSession.interruptTag(self.tag)


def live_rows(shown: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, path, status, now_path): what became of hits shown earlier (file_id, path, mtime).

    'gone', 'renamed' (the file has another path now), 'changed' (another mtime) or 'same'.
    A renamed file counts as renamed though it changed as well.
    """
    now = files.select(F.col("id").alias("file_id"), F.col("path").alias("now_path"), F.col("mtime").alias("__m"))
    rows = shown.select("file_id", "path", "mtime").join(now, "file_id", "left")
    status = (
        F.when(F.col("now_path").isNull(), "gone")
        .when(F.col("now_path") != F.col("path"), "renamed")
        .when(~F.col("mtime").eqNullSafe(F.col("__m")), "changed")
        .otherwise("same")
    )
    return rows.select("file_id", "path", status.alias("status"), "now_path")
