"""Reports over the catalog: duplicates and their verification, states, failures, sizes, counts."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.kernels import first_difference
from trawl.functions.text import under
from trawl.model import ContentState
from trawl.runtime import spill

_STATES = {s.value: s.name.lower() for s in ContentState}


def duplicate_groups(files: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(hash_hex, copies, total_size, redundant_size), most redundant bytes first.

    Rows without a hash and empty files are in no group. The hash covers size and head of
    a file, so a group is a candidate; see verify_groups.
    """
    groups = (
        files.filter("hash is not null and size > 0")
        .groupBy("hash")
        .agg(F.count("*").alias("copies"), F.sum("size").alias("total_size"), (F.sum("size") - F.max("size")).alias("redundant_size"))
        .filter("copies > 1")
        .select(F.lower(F.hex("hash")).alias("hash_hex"), "copies", "total_size", "redundant_size")
    )
    if limit is None and not offset:
        return groups
    paged = groups.orderBy(F.desc("redundant_size"), "hash_hex").offset(offset)
    return paged if limit is None else paged.limit(limit)


def duplicate_members(files: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(hash_hex, file_id, name, path, size, mtime): the files of each group, one row each.

    One join instead of a lookup per group. Rows, not lists: a group may hold a third of
    the catalog.
    """
    groups = duplicate_groups(files) if groups is None else groups
    rows = files.filter("hash is not null and size > 0").select(
        F.lower(F.hex("hash")).alias("hash_hex"), F.col("id").alias("file_id"), "name", "path", "size", "mtime"
    )
    return rows.join(groups.select("hash_hex"), "hash_hex", "left_semi")


def verify_groups(members: DataFrame, contents: DataFrame, group: str = "hash_hex") -> DataFrame:
    """(group, path, verdict, offset): each member compared byte for byte with the first readable one.

    `contents` has (path, content); a path without one, or with NULL, is 'unreadable'. The
    others are 'identical', 'length_differs' or 'differs' with the offset of the first
    differing byte. The reference member is the first path of the group with a content.

    Digests and lengths, taken where contents are read, settle all but members of the
    reference's length with another digest; only their contents and those of their
    references are fetched, and a reference is joined with its odd members by path, so a
    group of any size is spread like any other rows.
    """
    stamp = contents.filter("content is not null").select("path", F.sha2("content", 256).alias("digest"), F.length("content").alias("n"))
    read = spill(members.select(group, "path").join(stamp, "path", "left"))
    first = read.filter("n is not null").groupBy(group).agg(F.min(F.struct("path", "digest", "n")).alias("r"))
    rows = read.join(first, group, "left")
    same = F.col("digest") == F.col("r.digest")
    odd = rows.filter((F.col("n") == F.col("r.n")) & ~same).select("path", F.col("r.path").alias("ref_path")).distinct()
    bodies = contents.filter("content is not null").select("path", "content")
    mine = odd.join(bodies, "path")
    refs = bodies.select(F.col("path").alias("ref_path"), F.col("content").alias("ref")).join(odd.select("ref_path").distinct(), "ref_path", "left_semi")
    at = mine.join(refs, "ref_path").select("path", "ref_path", first_difference(F.col("content"), F.col("ref")).alias("offset"))
    verdict = (
        F.when(F.col("n").isNull(), "unreadable").when(same, "identical").when(F.col("n") != F.col("r.n"), "length_differs").otherwise("differs")
    )
    return rows.withColumn("ref_path", F.col("r.path")).withColumn("verdict", verdict).join(at, ["path", "ref_path"], "left").select(group, "path", "verdict", "offset")


def verify_on_disk(files: DataFrame) -> DataFrame:
    """verify_groups over the files themselves, read from the disk in the tasks that need them."""
    from trawl.sources.extract import head_of

    @F.pandas_udf("binary")
    def whole(paths: pd.Series) -> pd.Series:
        return pd.Series([head_of(p, -1) for p in paths], dtype=object)

    members = duplicate_members(files)
    return verify_groups(members, members.select("path", whole("path").alias("content")))


def status_of_paths(paths: DataFrame, files: DataFrame, failed: DataFrame) -> DataFrame:
    """(path, status, reason): not_indexed, or the state of the content and why it failed."""
    reasons = failed.select(F.col("file_id").alias("id"), "reason")
    known = files.select("id", "path", "content_state").join(reasons, "id", "left")
    state = F.col("content_state")
    named = F.create_map(*[F.lit(x) for kv in _STATES.items() for x in kv])
    return paths.select("path").join(known, "path", "left").select(
        "path", F.when(F.col("id").isNull(), "not_indexed").otherwise(F.try_element_at(named, state)).alias("status"), "reason"
    )


def failures(files: DataFrame, failed: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, reason, ts), newest first when limited."""
    rows = failed.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "reason", "ts")
    return rows if limit is None else rows.orderBy(F.desc("ts"), "path").limit(limit)


def size_breakdown(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(files, stored_texts, raw_bytes, stored_bytes, ratio); the ratio is NULL without raw bytes."""
    count = files.agg(F.count("*").alias("files"))
    sizes = texts.agg(
        F.count("text").alias("stored_texts"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("raw_bytes"),
        F.coalesce(F.sum(F.octet_length("text_zstd")) if "text_zstd" in texts.columns else F.lit(None), F.lit(0)).cast("long").alias("stored_bytes"),
    )
    ratio = F.when(F.col("raw_bytes") > 0, F.col("stored_bytes") / F.col("raw_bytes"))
    return count.crossJoin(F.broadcast(sizes)).select("*", ratio.alias("ratio"))  # one row each


def counts_by_root(files: DataFrame, roots: Sequence[str]) -> DataFrame:
    """(root, files, with_content) for each root; a file counts for every root it lies under.

    One scan with a conditional sum per root, however the roots lie inside one another.
    """
    roots = list(dict.fromkeys(roots))
    if not roots:
        return files.filter("false").select(F.col("path").alias("root"), F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("with_content"))
    aggs = []
    for i, r in enumerate(roots):
        inside = under(F.col("path"), r)
        aggs += [F.count_if(inside).alias(f"f{i}"), F.count_if(inside & (F.col("content_state") == ContentState.DONE)).alias(f"c{i}")]
    one = files.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(r).alias("root"), F.col(f"f{i}").alias("files"), F.col(f"c{i}").alias("with_content")) for i, r in enumerate(roots)])
    return one.select(F.inline(rows))


def extract_scope(files: DataFrame, most: int) -> DataFrame:
    """(to_extract, extracted): pending files of at most `most` bytes, and files done."""
    return files.agg(
        F.count_if((F.col("content_state") == ContentState.PENDING) & (F.col("size") <= most)).alias("to_extract"),
        F.count_if(F.col("content_state") == ContentState.DONE).alias("extracted"),
    )


def pending_count(files: DataFrame) -> DataFrame:
    return files.agg(F.count_if(F.col("content_state") == ContentState.PENDING).alias("pending"))


def parents_under(files: DataFrame, folder: str) -> DataFrame:
    """(parent): the distinct folders under a folder, itself included."""
    inside = (F.col("parent") == folder.rstrip("/")) | under(F.col("parent"), folder)
    return files.filter(inside).select("parent").distinct()


def page_by_id(files: DataFrame, after: int, size: int, most: int | None = None) -> DataFrame:
    """The next pending files behind an id, in id order: keyset paging."""
    rows = files.filter((F.col("content_state") == ContentState.PENDING) & (F.col("id") > after))
    rows = rows if most is None else rows.filter(F.col("size") <= most)
    return rows.select("id", "path", "size", "mime").orderBy("id").limit(size)


def page_by_path(files: DataFrame, folder: str, after: str, size: int) -> DataFrame:
    """The next files of a folder behind a path, in path order."""
    return files.filter(under(F.col("path"), folder) & (F.col("path") > after)).select("id", "path", "size", "mtime").orderBy("path").limit(size)


def rolling_rate(points: DataFrame, seconds: int = 30) -> DataFrame:
    """(at_us, rate): at every point, progress per second over the `seconds` before it, from its first to its last point.

    NULL where a window holds one moment only. Points are split into stretches of `seconds`;
    a point looks back into its own stretch and the one before, so no task orders them all.
    Of points at one moment the most advanced counts.
    """
    us = F.unix_micros("ts")
    span = seconds * 1_000_000
    each = points.filter("ts is not null").groupBy(us.alias("at_us")).agg(F.max("done").alias("done"))
    slot = F.floor(F.col("at_us") / span)
    # Every point stands in its own stretch and, as history, in the next one.
    rows = each.select("at_us", "done", F.inline(F.array(F.struct(slot.alias("slot"), F.lit(True).alias("own")), F.struct((slot + 1).alias("slot"), F.lit(False).alias("own")))))
    w = Window.partitionBy("slot").orderBy("at_us").rangeBetween(-span, 0)
    rate = F.when(F.col("at_us") > F.col("a_us"), (F.col("done") - F.col("a")) * 1e6 / (F.col("at_us") - F.col("a_us")))
    seen = rows.select("*", F.first("at_us").over(w).alias("a_us"), F.first("done").over(w).alias("a"))
    return seen.filter("own").select("at_us", rate.alias("rate"))


def overall_progress(files: DataFrame, roots: Sequence[str], most: int) -> DataFrame:
    """(walked, to_extract, extracted, failed, share): how far a run has come over all roots; share NULL without work."""
    inside = F.lit(False)
    for r in dict.fromkeys(roots):
        inside = inside | under(F.col("path"), r)
    state, small = F.col("content_state"), F.coalesce(F.col("size") <= most, F.lit(False))
    out = files.filter(inside).agg(
        F.count("*").alias("walked"),
        F.count_if((state == ContentState.PENDING) & small).alias("to_extract"),
        F.count_if(state == ContentState.DONE).alias("extracted"),
        F.count_if(state == ContentState.FAILED).alias("failed"),
    )
    settled = F.col("extracted") + F.col("failed")
    return out.withColumn("share", F.when(settled + F.col("to_extract") > 0, settled / (settled + F.col("to_extract"))))


def progress_by_root(files: DataFrame, roots: Sequence[str], most: int) -> DataFrame:
    """(root, walked, to_extract, extracted): what there is to do and done below each root, in one scan."""
    state, aggs, out = F.col("content_state"), [], []
    small = F.coalesce(F.col("size") <= most, F.lit(False))
    for i, r in enumerate(dict.fromkeys(roots)):
        inside = under(F.col("path"), r)
        tests = {"walked": inside, "to_extract": inside & (state == ContentState.PENDING) & small, "extracted": inside & (state == ContentState.DONE)}
        aggs += [F.count_if(t).alias(f"{n}{i}") for n, t in tests.items()]
        out.append(F.struct(F.lit(r).alias("root"), *[F.col(f"{n}{i}").alias(n) for n in tests]))
    return files.agg(*aggs).select(F.inline(F.array(*out)))


def mtimes_of(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, mtime) of known paths."""
    return files.join(paths.select("path").distinct(), "path", "left_semi").select("path", "mtime")


def rows_in(files: DataFrame, folder: str) -> DataFrame:
    """(id, path, mtime, size): files of the folder itself, not of those in it."""
    return files.filter(F.col("parent") == folder.rstrip("/")).select("id", "path", "mtime", "size")


def newest_per_parent(files: DataFrame, n: int) -> DataFrame:
    """The n newest files of every folder."""
    w = Window.partitionBy("parent").orderBy(F.desc_nulls_last("mtime"), "path")
    return files.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n).select("parent", "path", "mtime", "n")
