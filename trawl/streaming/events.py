"""Change events: cleaned, coalesced, split, collapsed; applied in micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trawl.functions.text import ancestors, parent_of
from trawl.runtime import spill

OVERFLOW = 100_000


def deduplicated(events: DataFrame) -> DataFrame:
    """Each seq once: of rows delivered under one seq the latest by (ts, op, path, to_path)."""
    last = events.filter("seq is not null").groupBy("seq").agg(F.max(F.struct("ts", "op", "path", "to_path")).alias("e"))
    return last.select("seq", "e.ts", "e.op", "e.path", "e.to_path")


def split_renames(events: DataFrame) -> DataFrame:
    """(seq, step, ts, op, path): a rename is a removal and a creation; without a target only the removal."""
    gone = F.struct(F.lit(0).alias("step"), F.lit("remove").alias("op"), F.col("path").alias("path"))
    come = F.struct(F.lit(1).alias("step"), F.lit("create").alias("op"), F.col("to_path").alias("path"))
    same = F.struct(F.lit(0).alias("step"), F.col("op").alias("op"), F.col("path").alias("path"))
    parts = F.when(F.col("op") == "rename", F.array(gone, come)).otherwise(F.array(same))
    return events.select("seq", "ts", F.inline(parts)).filter("path is not null").select("seq", "step", "ts", "op", "path")


def coalesce(events: DataFrame) -> DataFrame:
    """(path, op, seq): the last operation of a path counts; created and then removed is nothing.

    A fixed-size aggregate: a path with very many events is combined where they are read.
    """
    at = F.struct("seq", "step")
    per = events.groupBy("path").agg(
        F.min_by("op", at).alias("first"), F.max_by("op", at).alias("op"), F.max("seq").alias("seq")
    )
    return per.filter(~((F.col("first") == "create") & (F.col("op") == "remove"))).select("path", "op", "seq")


def collapse_removals(ops: DataFrame) -> DataFrame:
    """Removals under a removed folder go; creations and changes stay."""
    removed = ops.filter("op = 'remove'")
    above = removed.select("path", F.explode(ancestors(F.col("path"))).alias("folder"))
    folders = removed.select(F.col("path").alias("folder"))
    covered = above.join(folders, "folder", "left_semi").filter(F.col("folder") != F.col("path")).select("path").distinct()
    return ops.filter("op != 'remove'").unionByName(removed.join(covered, "path", "left_anti"))


def normalise(events: DataFrame) -> DataFrame:
    """(path, op, seq) ready to apply, from events as delivered."""
    return collapse_removals(coalesce(split_renames(deduplicated(events))))


def quiet_sessions(events: DataFrame, gap_seconds: int = 30) -> DataFrame:
    """(parent, started, ended, events): bursts of a folder, apart by a quiet gap. Batch or streaming."""
    rows = events.withColumn("parent", parent_of(F.col("path")))
    return (
        rows.groupBy("parent", F.session_window("ts", f"{gap_seconds} seconds").alias("w"))
        .agg(F.count("*").alias("events"))
        .select("parent", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")
    )


def flushes(events: DataFrame, gap_seconds: int = 30) -> DataFrame:
    """(parent, at, kind, events): when a folder's events are handed on.

    The first of a burst at once ('lead'), the others together once the folder was quiet
    for `gap_seconds` ('trail'). Batch or streaming; a stream forgets a folder when its
    watermark has passed the burst.
    """
    s = quiet_sessions(events, gap_seconds)
    lead = F.struct(F.col("started").alias("at"), F.lit("lead").alias("kind"), F.lit(1).cast("long").alias("events"))
    trail = F.struct(F.col("ended").alias("at"), F.lit("trail").alias("kind"), (F.col("events") - 1).alias("events"))
    return s.select("parent", F.inline(F.when(F.col("events") > 1, F.array(lead, trail)).otherwise(F.array(lead))))


def with_open_sessions(closed: DataFrame, events: DataFrame, gap_seconds: int = 30) -> DataFrame:
    """The sessions a stopped stream has emitted, and those of the events it still held.

    Sessions of a folder lie one after another, so what is open begins at the end of the last
    one emitted or later; those events go through the batch. A folder is done over as a whole
    if the stream dropped late events of it, or if a seq came with another ts or path, of
    which the stream keeps the first and the batch the latest.
    """
    rows = deduplicated(events).withColumn("parent", parent_of(F.col("path")))
    at = F.struct("ts", "path")
    moved = events.groupBy("seq").agg(F.min(at).alias("a"), F.max(at).alias("b")).filter("a <> b")
    moved = events.join(moved, "seq", "left_semi").select(parent_of(F.col("path")).alias("folder"))
    upto = closed.groupBy(F.col("parent").alias("folder")).agg(F.max("ended").alias("upto"), F.sum("events").alias("n"))
    same = F.col("parent").eqNullSafe(F.col("folder"))
    seen = upto.join(rows, same & (F.col("ts") < F.col("upto")), "left").groupBy("folder", "n").agg(F.count("seq").alias("m"))
    kept = closed.join(seen.filter("m <> n").select("folder").unionByName(moved).distinct(), same, "left_anti")
    ends = kept.groupBy(F.col("parent").alias("folder")).agg(F.max("ended").alias("upto"))
    rest = rows.join(ends, same, "left").filter("upto is null or ts >= upto")
    return kept.unionByName(quiet_sessions(rest.select(*events.columns), gap_seconds))


def late_by(events: DataFrame) -> DataFrame:
    """(seq, late_seconds): how far an event's time lies behind the latest time seen before it, in blocks of seq.

    Running maxima are taken inside blocks of 2^16 numbers and carried over from block to
    block, and in the same way over blocks of blocks, so no task orders all events.
    """
    rows = deduplicated(events).withColumn("block", F.shiftright("seq", 16)).withColumn("far", F.shiftright("seq", 32))
    tops = rows.groupBy("far", "block").agg(F.max("ts").alias("top"))
    farther = tops.groupBy("far").agg(F.max("top").alias("top"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    # One row per 2^32 numbers, then 2^16 rows per such block.
    over = farther.select("far", F.max("top").over(before(F.lit(0), "far")).alias("over"))
    carried = tops.join(over, "far").select("block", F.greatest(F.max("top").over(before("far", "block")), F.col("over")).alias("carried"))
    w = Window.partitionBy("block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.join(carried, "block").withColumn("seen", F.greatest(F.max("ts").over(w), F.col("carried")))
    return seen.select("seq", ((F.unix_micros("seen") - F.unix_micros("ts")) / 1e6).alias("late_seconds"))


def apply_to(files: DataFrame, ops: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """The catalog after a batch: removals with all beneath them first, then what was created or changed.

    `scanned` holds the rows of created and changed paths as found on disk; a path with the
    mtime it had is left alone, and a path it lacks has vanished again and is removed too.
    """
    from trawl.operators import tables

    gone = ops.filter("op = 'remove'").select("path")
    touched = ops.filter("op != 'remove'").select("path")
    if scanned is not None:
        gone = gone.unionByName(touched.join(scanned.select("path"), "path", "left_anti"))
    gone = spill(gone.select(F.col("path").alias("folder")).distinct())
    # A batch has OVERFLOW paths at most: they are sent to where the catalog is read, not the other way round.
    sent = F.broadcast(gone) if gone.count() <= OVERFLOW else gone
    above = files.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("folder"))
    hit = above.join(sent, "folder", "left_semi").select("path").distinct()
    out = files.join(hit, "path", "left_anti").select(*files.columns)
    if scanned is None:
        return out
    found = scanned.join(touched.distinct(), "path", "left_semi")
    changed = found.join(out.select("path", F.col("mtime").alias("__m")), "path").filter("mtime <> __m").drop("__m")
    return tables.insert_missing(tables.update_basic(out, changed), found)


def read_events(spark, path: str):
    """A stream of event files (JSON lines) put into a folder."""
    return spark.readStream.schema("seq long, ts timestamp, op string, path string, to_path string").json(path)


def watch(
    events: DataFrame,
    apply: Callable[[DataFrame, int], None],
    full_run: Callable[[], None],
    checkpoint: str,
    settle: str = "2 seconds",
    once: bool = False,
    overflow: int = OVERFLOW,
) -> StreamingQuery:
    """Apply events batch by batch; beyond `overflow` paths in one batch a full run takes over.

    The checkpoint makes each batch exactly one batch number; `apply` gets that number and
    must ignore one it has committed, which makes a replay after a failure harmless.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            ops = normalise(batch)
            if ops.limit(overflow + 1).count() > overflow:
                full_run()
            else:
                apply(ops, number)
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=settle)).start()


@dataclass
class Schedule:
    """When a full run is due, and in which mode."""

    interval: timedelta = timedelta(hours=1)
    mode: str = "auto"  # auto, stopped, running
    degraded: bool = False  # events can't be had: periodic runs alone keep the catalog in step

    @property
    def watches(self) -> bool:
        return self.mode == "auto" and not self.degraded

    def during_run(self) -> Schedule:
        """While a run that was asked for goes on; stopped ones go back to stopped afterwards."""
        return replace(self, mode="running") if self.mode == "stopped" else self

    def due(self, last: datetime | None, now: datetime) -> bool:
        """Never run, the interval is over, or the clock went back."""
        return self.mode == "auto" and (last is None or now - last >= self.interval or now < last)


def verb_for(exists: bool | None) -> str | None:
    """What a targeted path asks for: a file there is a change, one gone a removal, unknown nothing."""
    return None if exists is None else "modify" if exists else "remove"
