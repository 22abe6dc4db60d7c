"""A full indexing run: scan, classify, hash, type, extract, sweep, commit."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from trawl.catalog import SMALL, TABLES, Catalog, Change
from trawl.functions.text import ancestors
from trawl.model import Config, ContentState
from trawl.operators import reconcile, reports, tables
from trawl.runtime import cut
from trawl.sources.extract import extract_texts, extractor_for, head_of
from trawl.sources.mime import BY_EXTENSION, guess_mime, type_bits
from trawl.sources.scan import classify, head_hash, tree_scan


def extractable() -> Column:
    """The MIME type is one an extractor takes."""
    known = sorted({m for m in BY_EXTENSION.values() if extractor_for(m)} | {"text/plain", "audio/mpeg", "audio/flac", "audio/ogg"})
    return F.col("mime").isin(*known)


def records(spark: SparkSession, scan: DataFrame, config: Config) -> DataFrame:
    """scan with hash, mime, type and content_state; heads are read, not whole files."""
    head = _heads(config.hash_length)
    rows = scan.withColumn("head", head("path"))
    rows = rows.withColumn("hash", F.when(F.col("head").isNotNull(), head_hash(F.col("size"), F.col("head"), config.hash_length)))
    rows = rows.withColumn("mime", guess_mime(F.col("name"), F.col("head"))).drop("head")
    wants = (F.col("size") <= config.maximum_text_file_size) & extractable() & reconcile.content_allowed(config, F.col("name"))
    state = F.when(F.coalesce(wants, F.lit(False)), int(ContentState.PENDING)).otherwise(int(ContentState.NOT_APPLICABLE))
    return rows.withColumn("type", F.coalesce(type_bits(F.col("mime")), F.lit(0))).withColumn("content_state", state.cast("int"))


def _heads(n: int):
    """Column function: the first n bytes of a file, NULL if it can't be read."""

    @F.pandas_udf(BinaryType())
    def read(paths: pd.Series) -> pd.Series:
        return pd.Series([head_of(p, n) for p in paths], dtype=object)

    return read


def with_contents(files: DataFrame, texts: DataFrame, failed: DataFrame, config: Config, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, texts, failed) after the contents of all pending files were extracted."""
    pending = files.filter((F.col("content_state") == int(ContentState.PENDING)) & (F.col("size") <= config.maximum_text_file_size))
    got = cut(extract_texts(pending.select("id", "mime", "path"), config.maximum_text_size, config.maximum_text_file_size))
    done = got.filter(F.col("content_state") == int(ContentState.DONE)).select(F.col("id").alias("file_id"), "text")
    bad = got.filter(F.col("content_state") == int(ContentState.FAILED)).select(F.col("id").alias("file_id"), "reason", F.lit(now).cast("long").alias("ts"))
    nothing = got.filter(F.col("content_state") == int(ContentState.NOT_APPLICABLE)).select("id")
    files, texts, failed = tables.content_done(files, texts, failed, done if config.store_text else done.withColumn("text", F.lit("")))
    files, failed = tables.content_failed(files, failed, bad)
    return tables.content_not_applicable(files, texts, failed, nothing)


def full_run(spark: SparkSession, catalog: Catalog, config: Config, now: int | None = None, stopped: bool = False) -> dict[str, int]:
    """Bring the catalog in line with the disk; counts of what was done.

    One commit at the end: a run that breaks off leaves the catalog as it was. A stopped run
    deletes nothing and stamps nothing.
    """
    now = int(time.time()) if now is None else now
    seen, files = catalog.epoch, catalog.table("files")
    texts, failed = catalog.table("documents_text"), catalog.table("failed_files")
    scan, unreadable = tree_scan(spark, config)
    scan = cut(classify(scan, files))
    counts = {r.action: r["count"] for r in scan.groupBy("action").count().collect()}
    fresh = cut(records(spark, scan.filter("action != 'skip'"), config))
    out = tables.update_basic(files, fresh.filter("action = 'update'"))
    changed = fresh.filter("action = 'update'").join(files.select("path", "id"), "path").select(F.col("id").alias("file_id"))
    texts, failed = (t.join(changed, "file_id", "left_anti").select(*t.columns) for t in (texts, failed))
    out = tables.insert_missing(out, fresh.filter("action = 'insert'").drop("action", "aliased"))
    if not stopped:
        gone = cut(reconcile.stale(files, scan, unreadable))
        counts["removed"] = gone.count()
        out = tables.without_paths(out, gone)
    out, texts, failed = with_contents(cut(out), texts, failed, config, now)
    texts, failed = tables.dependents(texts, out), tables.dependents(failed, out)
    meta = dict(catalog.meta())
    if not stopped:
        roots = {r.root: f"{r.files} {r.with_content}" for r in reports.counts_by_root(out, config.roots).collect()}
        meta = {k: v for k, v in meta.items() if not k.startswith("root.")} | {f"root.{k}": v for k, v in roots.items()}
        meta |= dict(reconcile.Fingerprint(config).rows()) | {"last_full_index": str(now), "version": "1", "tokenize": config.tokenize}
        meta.pop("outstanding", None)
    catalog.commit({"files": out, "documents_text": texts, "failed_files": failed, "meta": catalog.meta_rows(meta)}, seen)
    return counts


def targeted_run(
    spark: SparkSession, catalog: Catalog, config: Config, ops: list[tuple[str, str]], now: int | None = None, batch: int | None = None
) -> dict[str, int]:
    """Apply (path, op) pairs to the catalog: removals with all beneath them first, then what was created or changed.

    Created and changed paths are looked at on disk, a folder with all beneath it; a path
    that is not there any more is removed. Contents of what is new or changed are extracted
    at once. One commit of changes, however large the catalog: only rows that differ are
    written. `batch` is the number of the batch of events; a batch whose number is committed
    already, or an earlier one, is not applied again.
    """
    import os

    now = int(time.time()) if now is None else now
    seen, meta = catalog.epoch, catalog.meta()
    if batch is not None and batch <= int(meta.get("event_batch", -1)):
        return {}
    files = catalog.table("files")
    below = [r.rstrip("/") for r in config.roots]
    mine = [(p, op) for p, op in dict.fromkeys(ops) if any(p == r or p.startswith(r + "/") for r in below)]
    here = sorted({p for p, op in mine if op != "remove" and os.path.lexists(p)})
    gone_paths = sorted({p for p, op in mine} - set(here))
    sent = lambda rows, col: F.broadcast(spark.createDataFrame([(r,) for r in rows], f"{col} string"))
    scan, _ = tree_scan(spark, config, here)
    found = cut(records(spark, scan.filter(reconcile.covers(config, F.col("path"))), config).drop("aliased"))
    # As few paths as events: they are sent to where the catalog is read.
    folders = F.concat(ancestors(F.col("path")), F.array("path"))
    gone = files.select("id", F.explode(folders).alias("folder")).join(sent(gone_paths, "folder"), "folder", "left_semi").select("id").distinct()
    paths = found.select("path")
    old = cut(files.join(F.broadcast(paths) if paths.count() <= SMALL else paths, "path", "left_semi"))
    differs = found.join(old.select("path", F.col("mtime").alias("__m")), "path").filter("not (mtime <=> __m)").drop("__m")
    changed = tables.update_basic(old, differs).join(differs.select("path"), "path", "left_semi")
    state = differs.select("path", F.col("content_state").alias("__s"))
    changed = changed.join(state, "path").withColumn("content_state", F.col("__s")).select(*files.columns)
    last = files.agg(F.max("id")).head()[0] or 0
    new = tables.numbered(found.join(old.select("path"), "path", "left_anti").dropDuplicates(["path"]), last).select(*files.columns)
    rows = cut(changed.unionByName(new))
    keys = cut(gone.unionByName(rows.select("id"))).select(F.col("id").alias("file_id"))
    none = [spark.createDataFrame([], TABLES[t]) for t in ("documents_text", "failed_files")]
    rows, texts, failed = with_contents(rows, *none, config, now)
    changes = {
        "files": Change(rows, keys.select(F.col("file_id").alias("id"))),
        "documents_text": Change(texts, keys),
        "failed_files": Change(failed, keys),
    }
    if batch is not None:
        changes["meta"] = catalog.meta_rows(meta | {"event_batch": str(batch)})
    catalog.commit(changes, seen)
    catalog.merge()
    return {"looked_at": len(mine), "found": found.count(), "removed": gone.count()}
