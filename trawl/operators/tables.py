"""Changes to catalog tables, each as a new table computed from the old one.

Parquet has no row updates; see trawl.catalog for how results replace what they came from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.text import under
from trawl.model import ContentState

BASIC = ("name", "parent", "size", "mtime", "mime", "type", "hash")


def numbered(rows: DataFrame, after: int, order: str = "path") -> DataFrame:
    """Rows with ids after `after`, in path order, without gathering them in one task.

    Rows are range-partitioned; each partition numbers its own and starts where the counts of
    those before it end (one row per partition comes to the driver).
    """
    n = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    parted = rows.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id())
    from trawl.runtime import spill

    parted = spill(parted)
    sizes = {r["__p"]: r["count"] for r in parted.groupBy("__p").count().collect()}
    starts, total = {}, after
    for p in sorted(sizes):
        starts[p] = total
        total += sizes[p]
    if not starts:
        return parted.withColumn("id", F.lit(None).cast("long")).drop("__p")
    base = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[F.col("__p")]
    w = Window.partitionBy("__p").orderBy(order)
    return parted.withColumn("id", (base + F.row_number().over(w)).cast("long")).drop("__p")


def insert_missing(files: DataFrame, new: DataFrame) -> DataFrame:
    """files with the rows of `new` whose path it lacks; of equal new paths the first by (mtime, size) goes in."""
    w = Window.partitionBy("path").orderBy(F.desc("mtime"), F.desc("size"))
    fresh = new.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "id").join(files.select("path"), "path", "left_anti")
    last = files.agg(F.max("id")).head()[0] or 0
    return files.unionByName(numbered(fresh, last), allowMissingColumns=True).select(*files.columns)


def update_basic(files: DataFrame, new: DataFrame) -> DataFrame:
    """Metadata of known paths replaced; their content is to be extracted again. The id stays."""
    n = new.select("path", *[F.col(c).alias(f"__{c}") for c in BASIC], F.lit(True).alias("__new")).dropDuplicates(["path"])
    joined = files.join(n, "path", "left")
    return joined.select(
        *[
            F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in BASIC
            else F.when(F.col("__new"), F.lit(int(ContentState.PENDING))).otherwise(F.col(c)).alias(c) if c == "content_state"
            else F.col(c)
            for c in files.columns
        ]
    )


def set_states(files: DataFrame, ids: DataFrame, state: ContentState) -> DataFrame:
    """content_state of the given ids (column id)."""
    marked = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return files.join(marked, "id", "left").withColumn(
        "content_state", F.when(F.col("__hit"), F.lit(int(state))).otherwise(F.col("content_state"))
    ).select(*files.columns)


def content_done(files: DataFrame, texts: DataFrame, failed: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, texts, failed) after bodies (file_id, text) were extracted; empty bodies are not stored."""
    ids = done.select(F.col("file_id").alias("id"))
    keep = texts.join(done.select("file_id"), "file_id", "left_anti")
    stored = done.filter("text != ''").select("file_id", "text")
    return (
        set_states(files, ids, ContentState.DONE),
        keep.unionByName(stored, allowMissingColumns=True),
        failed.join(done.select("file_id"), "file_id", "left_anti"),
    )


def content_failed(files: DataFrame, failed: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, failed) after extractions failed with (file_id, reason, ts)."""
    return (
        set_states(files, new.select(F.col("file_id").alias("id")), ContentState.FAILED),
        failed.join(new.select("file_id"), "file_id", "left_anti").unionByName(new.select("file_id", "reason", "ts")),
    )


def content_not_applicable(files: DataFrame, texts: DataFrame, failed: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    gone = ids.select(F.col("id").alias("file_id"))
    return (
        set_states(files, ids, ContentState.NOT_APPLICABLE),
        texts.join(gone, "file_id", "left_anti"),
        failed.join(gone, "file_id", "left_anti"),
    )


def oversize_not_applicable(files: DataFrame, most: int, folder: str | None = None) -> DataFrame:
    """Pending files beyond `most` bytes need no extraction."""
    hit = (F.col("content_state") == ContentState.PENDING) & (F.col("size") > most)
    if folder is not None:
        hit = hit & under(F.col("path"), folder)
    state = F.when(F.coalesce(hit, F.lit(False)), F.lit(int(ContentState.NOT_APPLICABLE))).otherwise(F.col("content_state"))
    return files.withColumn("content_state", state)


def reset_pending(files: DataFrame, where: Column) -> DataFrame:
    return files.withColumn(
        "content_state", F.when(F.coalesce(where, F.lit(False)), F.lit(int(ContentState.PENDING))).otherwise(F.col("content_state"))
    )


def without_paths(files: DataFrame, paths: DataFrame) -> DataFrame:
    return files.join(paths.select("path"), "path", "left_anti").select(*files.columns)


def without_ids(files: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return files.join(ids.select(F.col("id").alias(id_col)), id_col, "left_anti").select(*files.columns)


def without_subtree(files: DataFrame, folder: str) -> DataFrame:
    """Without the folder's files, at any depth."""
    return files.filter(~under(F.col("path"), folder))


def only_under(files: DataFrame, folders: Sequence[str]) -> DataFrame:
    """Rows in none of the folders go; an empty list removes nothing."""
    if not folders:
        return files
    keep: Column = F.lit(False)
    for f in folders:
        keep = keep | under(F.col("path"), f)
    return files.filter(keep)


def dependents(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of a side table whose file is still there."""
    return rows.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi").select(*rows.columns)
