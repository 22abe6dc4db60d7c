"""One catalog and its settings: full runs, targeted refreshes, changed settings, searches."""

from __future__ import annotations

import logging
import time
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trawl.catalog import TABLES, Catalog, Change
from trawl.model import Config, Outcome
from trawl.operators import ingest, reconcile, reports, search
from trawl.runtime import cut
from trawl.streaming.events import Schedule, verb_for, watch


log = logging.getLogger(__name__)


@dataclass(frozen=True)
class State:
    mode: str
    last_run: int | None
    files: int
    pending: int
    epoch: int
    roots: dict[str, tuple[int, int]]
    outstanding: bool = False
    degraded: bool = False


class Engine:
    """Single writer by contract; every change is one commit of the catalog.

    A catalog of another version is an error unless `renew` agrees to empty it.
    """

    def __init__(self, spark: SparkSession, base: str, config: Config | None = None, renew: bool = False):
        self.spark, self.catalog = spark, (Catalog.anew if renew else Catalog)(spark, base)
        stored = reconcile.Fingerprint.read(self.catalog.meta()).config
        self.config = config or stored
        self.schedule = Schedule(mode="auto" if self.config.auto_index else "stopped")

    def reindex(self, now: int | None = None) -> dict[str, int]:
        """A full run, whatever the mode; the mode is the same afterwards."""
        before, self.schedule = self.schedule, self.schedule.during_run()
        try:
            return ingest.full_run(self.spark, self.catalog, self.config, now)
        finally:
            self.schedule = before

    def refresh(self, paths: Sequence[str], now: int | None = None) -> int:
        """Bring single paths up to date, contents included; those under no root are left alone. How many were looked at."""
        import os

        ops = [(p, verb_for(os.path.lexists(p))) for p in dict.fromkeys(paths)]
        return ingest.targeted_run(self.spark, self.catalog, self.config, ops, now).get("looked_at", 0)

    def watch(self, events: DataFrame, checkpoint: str, once: bool = False, settle: str = "2 seconds") -> StreamingQuery | None:
        """Keep the catalog in step with a stream of events, or (`once`) with what has arrived so far.

        A batch is what came in `settle`, so no event waits longer than that and a batch. If
        the stream can't be started the engine is degraded: None, and periodic runs go on.
        Batches are committed under their number, so one that is replayed after a failure
        changes nothing; too many paths in a batch make a full run.
        """
        def apply(ops: DataFrame, number: int) -> None:
            rows = [(r.path, r.op) for r in ops.select("path", "op").collect()]  # OVERFLOW of them at most
            ingest.targeted_run(self.spark, self.catalog, self.config, rows, batch=number)

        try:
            return watch(events, apply, self.reindex, checkpoint, settle, once)
        except Exception:
            log.warning("events can't be watched, periodic runs only", exc_info=True)
            self.schedule = replace(self.schedule, degraded=True)
            return None

    def apply_config(self, config: Config) -> reconcile.IndexWork:
        """Take up new settings. What needs no disk is done at once; a rebuild is left to the caller.

        Tables, settings and the full run that is still due are one commit; see outstanding().
        """
        work = reconcile.diff_actions(self.config, config)
        if work.rebuild:
            return work
        if not work.nothing:
            seen = self.catalog.epoch
            parts = [self.catalog.table(t) for t in ("files", "documents_text", "failed_files")]
            files, texts, failed = reconcile.reconcile(*parts, config, work, ingest.extractable())
            meta = self.catalog.meta() | dict(reconcile.Fingerprint(config).rows())
            if work.reindex:
                meta["outstanding"] = "reindex"
            self.catalog.commit({"files": files, "documents_text": texts, "failed_files": failed, "meta": self.catalog.meta_rows(meta)}, seen)
        self.config = config
        return work

    def outstanding(self) -> bool:
        """A full run is still due for settings taken up earlier; it stays due until one has ended."""
        return "outstanding" in self.catalog.meta()

    def set_mode(self, mode: str) -> None:
        """auto, stopped or running; others are an error."""
        if mode not in ("auto", "stopped", "running"):
            raise ValueError(f"unknown mode {mode!r}")
        self.schedule = replace(self.schedule, mode=mode)

    def clear(self) -> None:
        """An empty catalog; nothing runs by itself until it is asked to."""
        self.catalog.clear()
        self.set_mode("stopped")

    def rebuild(self, now: int | None = None) -> dict[str, int]:
        self.catalog.clear()
        return self.reindex(now)

    def due(self, now: float | None = None) -> bool:
        from datetime import datetime, timezone

        last = self.catalog.meta().get("last_full_index")
        at = lambda s: datetime.fromtimestamp(float(s), timezone.utc)
        if self.schedule.mode == "auto" and self.outstanding():
            return True
        return self.schedule.due(at(last) if last else None, at(time.time() if now is None else now))

    def state(self) -> State:
        files, meta = self.catalog.table("files"), self.catalog.meta()
        count = files.agg(F.count("*"), F.count_if(F.col("content_state") == 0)).head()
        roots = {r.root: (r.files, r.with_content) for r in reports.counts_by_root(files, self.config.roots).collect()}
        last = meta.get("last_full_index")
        return State(self.schedule.mode, int(last) if last else None, count[0], count[1], self.catalog.epoch, roots, "outstanding" in meta, self.schedule.degraded)

    def search(self, text: str, limit: int | None = None, **options) -> tuple[list, Outcome]:
        options.setdefault("fuzzy", self.config.fuzzy_default)
        options.setdefault("max_edits", self.config.fuzzy_max_edits)
        return search.run(self.catalog.table("files"), self.catalog.table("documents_text"), text, limit or self.config.display_limit, **options)

    def forget(self, path: str) -> None:
        """Drop one path from the catalog."""
        gone = cut(self.catalog.table("files").filter(F.col("path") == path).select("id"))
        keys = gone.select(F.col("id").alias("file_id"))
        none = {t: self.spark.createDataFrame([], TABLES[t]) for t in ("files", "documents_text", "failed_files")}
        self.catalog.commit({t: Change(df, gone if t == "files" else keys) for t, df in none.items()}, self.catalog.epoch)
