"""Change events: queries over fs_events and events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators import reports
from trawl.runtime import scratch, table
from trawl.streaming import events as ev


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fs_events")


def events_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return ev.deduplicated(_events(spark, d)).select("seq", "op", "path", "to_path")


def events_split(spark: SparkSession, d: str) -> DataFrame:
    return ev.split_renames(ev.deduplicated(_events(spark, d))).select("seq", "step", "op", "path")


def events_coalesced(spark: SparkSession, d: str) -> DataFrame:
    return ev.coalesce(ev.split_renames(ev.deduplicated(_events(spark, d))))


def events_normalised(spark: SparkSession, d: str) -> DataFrame:
    return ev.normalise(_events(spark, d))


def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = ev.quiet_sessions(ev.deduplicated(_events(spark, d)), 3600)
    return s.select("parent", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "events")


def debounce_flushes(spark: SparkSession, d: str) -> DataFrame:
    s = ev.flushes(ev.deduplicated(_events(spark, d)), 3600)
    return s.select("parent", F.unix_micros("at").alias("at_us"), "kind", "events")


def events_late(spark: SparkSession, d: str) -> DataFrame:
    return ev.late_by(_events(spark, d)).filter("late_seconds > 0")


def events_applied(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the catalog after all removals of the stream."""
    return ev.apply_to(table(spark, d, "files"), ev.normalise(_events(spark, d))).select("id", "path")


def events_upserted(spark: SparkSession, d: str) -> DataFrame:
    """The catalog after the stream, what was created or changed as the newest reading of the walker has it."""
    r = table(spark, d, "scan_records").filter("mtime is not null")
    newest = r.groupBy("path").agg(F.max(F.struct("seen_at", "batch_no", "rec_id", "mtime", "size")).alias("r"))
    found = newest.select("path", F.col("r.mtime").alias("mtime"), F.col("r.size").alias("size"))
    files = table(spark, d, "files")
    rest = [F.lit(None).cast(files.schema[c].dataType).alias(c) for c in files.columns if c not in ("id", "path", "mtime", "size")]
    return ev.apply_to(files, ev.normalise(_events(spark, d)), found.select("*", *rest)).select("path", "mtime", "size")


def rolling_rate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("done"))
    return reports.rolling_rate(e, 3600)


def sessions_streamed(spark: SparkSession, d: str) -> DataFrame:
    """Quiet sessions found by a stream of the events table, with a watermark, until all is read.

    The stream emits what ended before the watermark; what it still holds when all is read
    is closed through the batch.
    """
    schema = spark.read.parquet(f"{d}/fs_events.parquet").schema
    # A file source wants a folder; the glob makes one of the single file or the folder there is.
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/fs_events.parque[t]")
    stream = ev.quiet_sessions(source.filter("seq is not null").withWatermark("ts", "7 days").dropDuplicatesWithinWatermark(["seq"]), 3600)
    out = scratch(spark, "sessions")
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    closed = spark.read.schema("parent string, started timestamp, ended timestamp, events long").parquet(f"{out}/data")
    every = ev.with_open_sessions(closed, _events(spark, d), 3600)
    return every.select("parent", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "events")


QUERIES = {
    f.__name__: f
    for f in (
        events_deduplicated, events_split, events_coalesced, events_normalised, debounce_sessions, debounce_flushes, events_late,
        events_applied, events_upserted, rolling_rate, sessions_streamed,
    )
}

_DEDUP = """d AS (SELECT seq, ts, op, path, to_path FROM (SELECT *, row_number() OVER (
    PARTITION BY seq ORDER BY ts DESC, op DESC, path DESC NULLS LAST, to_path DESC NULLS LAST) AS rn FROM fs_events WHERE seq IS NOT NULL) WHERE rn = 1)"""
_SPLIT = f"""{_DEDUP}, s AS (
    SELECT seq, 0 AS step, ts, CASE WHEN op = 'rename' THEN 'remove' ELSE op END AS op, path FROM d
    UNION ALL SELECT seq, 1, ts, 'create', to_path FROM d WHERE op = 'rename' AND to_path IS NOT NULL)"""
_COAL = f"""{_SPLIT}, c AS (
    SELECT path, arg_min(op, seq * 2 + step) AS first_op, arg_max(op, seq * 2 + step) AS op, max(seq) AS seq FROM s GROUP BY path),
    k AS (SELECT path, op, seq FROM c WHERE NOT (first_op = 'create' AND op = 'remove'))"""
_NORM = f"""{_COAL}, gone AS (SELECT path FROM k WHERE op = 'remove'),
    n AS (SELECT * FROM k WHERE op <> 'remove' OR NOT EXISTS (
        SELECT 1 FROM (SELECT unnest(list_transform(range(2, len(string_split(k.path, '/'))),
            lambda i: array_to_string(string_split(k.path, '/')[1:i], '/'))) AS folder) a JOIN gone g ON g.path = a.folder))"""

SQL = {
    "events_deduplicated": f"WITH {_DEDUP} SELECT seq, op, path, to_path FROM d",
    "events_split": f"WITH {_SPLIT} SELECT seq, step, op, path FROM s WHERE path IS NOT NULL",
    "events_coalesced": f"WITH {_COAL} SELECT path, op, seq FROM k",
    "events_normalised": f"WITH {_NORM} SELECT path, op, seq FROM n",
    "debounce_sessions": f"""WITH {_DEDUP}, p AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS parent FROM d),
        g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (PARTITION BY parent ORDER BY ts)),
        b AS (SELECT *, sum(fresh) OVER (PARTITION BY parent ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
        SELECT parent, epoch_us(min(ts)) AS started, epoch_us(max(ts)) + 3600000000 AS ended, count(*) AS events FROM b GROUP BY parent, burst""",
    "events_late": f"""WITH {_DEDUP}, m AS (SELECT seq, epoch_us(max(ts) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)) - epoch_us(ts) AS us FROM d)
        SELECT seq, us / 1e6 AS late_seconds FROM m WHERE us > 0""",
    "events_applied": f"""WITH {_NORM}, r AS (SELECT path FROM n WHERE op = 'remove')
        SELECT id, path FROM files f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.path = f.path) AND NOT EXISTS (
            SELECT 1 FROM (SELECT unnest(list_transform(range(2, len(string_split(f.path, '/'))),
                lambda i: array_to_string(string_split(f.path, '/')[1:i], '/'))) AS folder) a JOIN r ON r.path = a.folder)""",
    "events_upserted": f"""WITH {_NORM}, found AS (SELECT path, mtime, size FROM (
            SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, batch_no DESC, rec_id DESC) AS rn
            FROM scan_records WHERE mtime IS NOT NULL) WHERE rn = 1),
        t AS (SELECT DISTINCT path FROM n WHERE op <> 'remove'), sc AS (SELECT found.* FROM found JOIN t USING (path)),
        r AS (SELECT path FROM n WHERE op = 'remove' UNION SELECT path FROM t WHERE path NOT IN (SELECT path FROM sc)),
        kept AS (SELECT path, mtime, size FROM files f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.path = f.path) AND NOT EXISTS (
            SELECT 1 FROM (SELECT unnest(list_transform(range(2, len(string_split(f.path, '/'))),
                lambda i: array_to_string(string_split(f.path, '/')[1:i], '/'))) AS folder) a JOIN r ON r.path = a.folder))
        SELECT k.path, CASE WHEN sc.mtime <> k.mtime THEN sc.mtime ELSE k.mtime END AS mtime,
               CASE WHEN sc.mtime <> k.mtime THEN sc.size ELSE k.size END AS size FROM kept k LEFT JOIN sc USING (path)
        UNION ALL SELECT path, mtime, size FROM sc WHERE path NOT IN (SELECT path FROM kept)""",
    "rolling_rate": """WITH e AS (SELECT epoch_us(ts) AS at_us, max(event_id) AS done FROM events GROUP BY 1),
        f AS (SELECT at_us, done, first_value(at_us) OVER w AS a_us, first_value(done) OVER w AS a FROM e
              WINDOW w AS (ORDER BY at_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))
        SELECT at_us, CASE WHEN at_us > a_us THEN (done - a) * 1e6 / (at_us - a_us) END AS rate FROM f""",
}
SQL["sessions_streamed"] = SQL["debounce_sessions"]
SQL["debounce_flushes"] = f"""WITH s AS ({SQL["debounce_sessions"]}) SELECT parent, started AS at_us, 'lead' AS kind, 1::BIGINT AS events FROM s
    UNION ALL SELECT parent, ended, 'trail', events - 1 FROM s WHERE events > 1"""
