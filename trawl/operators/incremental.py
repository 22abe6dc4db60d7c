"""Processing only what is new: interval ledgers, gap runs, and commits with the output."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from trawl.commits import Folder
from trawl.runtime import scratch

Interval = tuple[int, int]


def merge(intervals: Iterable[Interval]) -> list[Interval]:
    """Disjoint, sorted, closed intervals; neighbours (3..5, 6..9) become one."""
    out: list[list[int]] = []
    for lo, hi in sorted((a, b) for a, b in intervals if a <= b):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def subtract(available: Iterable[Interval], processed: Iterable[Interval]) -> list[Interval]:
    """The parts of `available` that `processed` does not cover."""
    done, out = merge(processed), []
    for lo, hi in merge(available):
        for a, b in done:
            if b < lo or a > hi:
                continue
            if a > lo:
                out.append((lo, a - 1))
            lo = b + 1
            if lo > hi:
                break
        if lo <= hi:
            out.append((lo, hi))
    return out


def within(col: Column, intervals: Iterable[Interval], inline: int = 200) -> Column:
    """Predicate: the number lies in one of the intervals.

    Up to `inline` intervals are one pushed-down test each; more are looked up by binary
    search behind a pushed-down range.
    """
    intervals = merge(intervals)
    if len(intervals) > inline:
        lows, highs = np.array(intervals, np.int64).T

        @F.pandas_udf(BooleanType())
        def inside(n: pd.Series) -> pd.Series:
            x = n.to_numpy(np.int64)
            return pd.Series(x <= highs[np.maximum(np.searchsorted(lows, x, side="right") - 1, 0)])

        reach = F.coalesce(col.between(F.lit(intervals[0][0]), F.lit(intervals[-1][1])), F.lit(False))
        return reach & inside(F.coalesce(col, F.lit(intervals[0][0])).cast("long"))
    test: Column = F.lit(False)
    for lo, hi in intervals:
        test = test | col.between(F.lit(lo), F.lit(hi))
    return test


def available_intervals(df: DataFrame, seq: str) -> list[Interval]:
    """The sequence numbers present, as runs without a gap.

    Numbers are made distinct and numbered inside blocks of 2^20, so that no task has to
    order all of them; what comes to the driver is one row per run of a block.
    """
    from pyspark.sql import Window

    nums = df.select(F.col(seq).cast("long").alias("n")).filter("n is not null").distinct()
    nums = nums.withColumn("block", F.shiftright("n", 20))
    w = Window.partitionBy("block").orderBy("n")
    runs = (
        nums.withColumn("run", F.col("n") - F.row_number().over(w))
        .groupBy("block", "run")
        .agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    )
    return merge((r.lo, r.hi) for r in runs.select("lo", "hi").toLocalIterator())


@dataclass(frozen=True)
class Committed:
    version: int
    intervals: list[Interval]
    outputs: list[str]


class Ledger:
    """Which sequence numbers are processed, and the outputs they went into.

    A commit is one small file holding the merged intervals together with the list of
    output folders; see trawl.commits: of two writers of the same number one fails, and a
    run that dies at any point leaves either the old state or the new one. Folders no
    commit names are leftovers of dead runs; readers never see them.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.folder = spark, Folder(spark, base)
        self.base = self.folder.base
        self.folder.make()

    def read(self) -> Committed:
        versions = self.folder.numbers()
        if not versions:
            return Committed(0, [], [])
        doc = json.loads(self.folder.read(versions[-1]))
        return Committed(versions[-1], [tuple(x) for x in doc["intervals"]], doc["outputs"])

    def commit(self, seen: Committed, gaps: list[Interval], output: str | None = None) -> Committed:
        """Name the gaps as processed, with the folder they went into (none if they were processed elsewhere)."""
        outputs = seen.outputs if output is None else [*seen.outputs, output]
        new = Committed(seen.version + 1, merge([*seen.intervals, *gaps]), outputs)
        self.folder.publish(new.version, json.dumps({"intervals": new.intervals, "outputs": new.outputs}))
        return new

    def output(self) -> DataFrame | None:
        outputs = self.read().outputs
        return self.spark.read.parquet(*[f"{self.base}/{o}" for o in outputs]) if outputs else None


def run_incremental(
    source: DataFrame, seq: str, ledger: Ledger, process: Callable[[DataFrame, list[Interval]], DataFrame]
) -> Committed:
    """Process every sequence number that is available but not committed, exactly once.

    `process` gets the rows of the gaps, and the gaps. Numbers that turn up late, below
    ones already done, lie in a gap and are taken in too. A number is the unit of delivery:
    rows added under a number already committed are not seen again. With nothing new,
    nothing is written and the state stays. Rows with a NULL number belong to no delivery
    and are left out.
    """
    state = ledger.read()
    gaps = subtract(available_intervals(source, seq), state.intervals)
    if not gaps:
        return state
    name = f"part-{state.version + 1}-{uuid.uuid4().hex}"
    process(source.filter(within(F.col(seq), gaps)), gaps).write.parquet(f"{ledger.base}/{name}")
    return ledger.commit(state, gaps, name)


def last_good_batch(runs: DataFrame) -> int | None:
    """last_batch of the last run, by run_no, that ended well; None if none did."""
    row = runs.filter("status = 'ok'").orderBy(F.desc("run_no")).select("last_batch").head()
    return row[0] if row else None


def news(fresh: DataFrame, readings: DataFrame, gaps: list[Interval], files: DataFrame) -> DataFrame:
    """(path): paths of the fresh readings whose newest reading of all is fresh too and tells something files lacks.

    Only paths with a fresh reading can have a fresh newest one, so the history is reduced
    to these first; it is aggregated with map-side combine, so a path read over and over is
    no hot key.
    """
    sound = "mtime is not null and path is not null"
    paths = fresh.filter(sound).select("path").distinct()
    newest = (
        readings.filter(sound)
        .join(paths, "path", "left_semi")
        .groupBy("path")
        .agg(F.max(F.struct("seen_at", "batch_no", "rec_id", "mtime", "size")).alias("r"))
        .filter(within(F.col("r.batch_no"), gaps))
        .select("path", F.col("r.mtime").alias("r_mtime"), F.col("r.size").alias("r_size"))
    )
    have = files.filter("path is not null").select(
        "path", F.col("mtime").alias("f_mtime"), F.col("size").alias("f_size"), F.lit(True).alias("f_is")
    )
    same = F.col("f_mtime").eqNullSafe(F.col("r_mtime")) & F.col("f_size").eqNullSafe(F.col("r_size"))
    return newest.join(have, "path", "left").filter(F.col("f_is").isNull() | ~same).select("path")


def changed_paths(files: DataFrame, readings: DataFrame, runs: DataFrame, base: str | None = None) -> DataFrame:
    """(path): pending files, and paths whose newest reading is unprocessed and tells news.

    An incremental run over the readings with their batches as sequence numbers. The ledger
    at `base` says which are processed; a ledger without a commit (a scratch one, by
    default) starts with what the log of runs says: every batch up to the last one of the
    last good run. The gaps are what is available beyond, and what is found in them is
    written and committed together with them; the run's own output comes out.

    The newest reading of a path is taken over all batches: latest seen_at, then highest
    batch_no, then rec_id. Readings without mtime don't count, NULL sorts first, a NULL size
    differs from any number. A NULL path is never a case. Further columns are not read.
    """
    spark = files.sparkSession
    ledger = Ledger(spark, base or scratch(spark, "ledger"))
    before = ledger.read()
    if not before.version:
        good = last_good_batch(runs)
        before = ledger.commit(before, [] if good is None else [(-(2**62), good)])
    after = run_incremental(readings, "batch_no", ledger, lambda fresh, gaps: news(fresh, readings, gaps, files))
    pending = files.filter("content_state = 0 and path is not null").select("path")
    own = after.outputs[len(before.outputs) :]
    if own:
        pending = pending.unionByName(spark.read.schema("path string").parquet(*[f"{ledger.base}/{o}" for o in own]))
    return pending.distinct()
