"""Queries on deliveries: unprocessed records, differences of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawl.operators.incremental import changed_paths
from trawl.operators.snapshots import snapshot_changes
from trawl.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_paths(
        table(spark, sf_dir, "files"), table(spark, sf_dir, "scan_records"), table(spark, sf_dir, "index_runs")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "file_snapshots"))


QUERIES = {"p2_found": p2_found, "p5_found": p5_found}

SQL = {
    "p2_found": """
        WITH good AS (SELECT last_batch AS b FROM index_runs WHERE status = 'ok' ORDER BY run_no DESC LIMIT 1),
        newest AS (
            SELECT * FROM (
                SELECT path, batch_no, mtime, size, row_number() OVER (
                    PARTITION BY path ORDER BY seen_at DESC, batch_no DESC, rec_id DESC) AS rn
                FROM scan_records WHERE mtime IS NOT NULL)
            WHERE rn = 1 AND batch_no > (SELECT b FROM good))
        SELECT path FROM files WHERE content_state = 0
        UNION
        SELECT n.path FROM newest n LEFT JOIN files f ON f.path = n.path
        WHERE f.path IS NULL OR f.mtime IS DISTINCT FROM n.mtime OR f.size IS DISTINCT FROM n.size
    """,
    "p5_found": """
        WITH held AS (
            SELECT snap_no, path, mtime, size FROM (
                SELECT *, row_number() OVER (PARTITION BY snap_no, path ORDER BY loaded_at DESC) AS rn
                FROM file_snapshots) WHERE rn = 1),
        nums AS (SELECT snap_no AS s, lag(snap_no) OVER (ORDER BY snap_no) AS prev
                 FROM (SELECT DISTINCT snap_no FROM file_snapshots)),
        n AS (SELECT nums.s, h.* FROM nums JOIN held h ON h.snap_no = nums.s WHERE prev IS NOT NULL),
        o AS (SELECT nums.s, h.* FROM nums JOIN held h ON h.snap_no = nums.prev)
        SELECT coalesce(n.s, o.s) AS snap_no, coalesce(n.path, o.path) AS path,
               CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
        FROM n FULL JOIN o ON n.s = o.s AND n.path = o.path
        WHERE o.path IS NULL OR n.path IS NULL
           OR o.mtime IS DISTINCT FROM n.mtime OR o.size IS DISTINCT FROM n.size
    """,
}
