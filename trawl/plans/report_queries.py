"""Reports, table changes, reconciliation, scans: queries over the file tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.packed import packed, unpacked
from trawl.functions.text import extension_of, ignored, like_escaped, under
from trawl.model import Config, ContentState
from trawl.operators import live, reconcile, reports, search, tables
from trawl.runtime import table
from trawl.sources import mime, scan

_ROOTS = ("/srv/share", "/srv/share/scratch", "/srv/share-old", "/home", "/mnt/archive")
_IGNORE = ("inbox", "*.mp3", "/srv/share/scratch/*")
_LISTED = Config(roots=_ROOTS, ignore=_IGNORE, content_extensions=("txt", ".MD", "(none)"), maximum_text_file_size=50_000)


def _t(name):
    return lambda spark, d: table(spark, d, name)


_files, _texts, _failed = _t("files"), _t("documents_text"), _t("failed_files")


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return reports.duplicate_groups(_files(spark, d))


def duplicate_page(spark: SparkSession, d: str) -> DataFrame:
    return reports.duplicate_groups(_files(spark, d), 20, 5)


def duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    return reports.duplicate_members(_files(spark, d))


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    body = _texts(spark, d).select(F.col("file_id").alias("id"), F.encode("text", "UTF-8").alias("content"))
    return _files(spark, d).select("id", "path").join(body, "id").select("path", "content")


def verify_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return reports.verify_groups(reports.duplicate_members(_files(spark, d)), _bodies(spark, d))


def status_of_paths(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "scan_records").select("path").distinct()
    return reports.status_of_paths(paths, _files(spark, d), _failed(spark, d))


def list_failed(spark: SparkSession, d: str) -> DataFrame:
    return reports.failures(_files(spark, d), _failed(spark, d))


def newest_failures(spark: SparkSession, d: str) -> DataFrame:
    return reports.failures(_files(spark, d), _failed(spark, d), 25)


def size_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return reports.size_breakdown(_files(spark, d), _texts(spark, d))


def root_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.counts_by_root(_files(spark, d), _ROOTS)


def extract_scope(spark: SparkSession, d: str) -> DataFrame:
    return reports.extract_scope(_files(spark, d), 2 * 1024 * 1024)


def pending_count(spark: SparkSession, d: str) -> DataFrame:
    return reports.pending_count(_files(spark, d))


def parents_under(spark: SparkSession, d: str) -> DataFrame:
    return reports.parents_under(_files(spark, d), "/srv/share")


def page_by_id(spark: SparkSession, d: str) -> DataFrame:
    return reports.page_by_id(_files(spark, d), 100, 50, 2 * 1024 * 1024)


def page_by_path(spark: SparkSession, d: str) -> DataFrame:
    return reports.page_by_path(_files(spark, d), "/srv/share", "/srv/share/inbox/m", 50)


def newest_per_parent(spark: SparkSession, d: str) -> DataFrame:
    return reports.newest_per_parent(_files(spark, d), 3)


def delete_subtree(spark: SparkSession, d: str) -> DataFrame:
    return tables.without_subtree(_files(spark, d), "/srv/share").select("id", "path")


def delete_outside(spark: SparkSession, d: str) -> DataFrame:
    return tables.only_under(_files(spark, d), ["/srv/share", "/home"]).select("id", "path")


def delete_ids(spark: SparkSession, d: str) -> DataFrame:
    return tables.without_ids(_files(spark, d), _failed(spark, d).select(F.col("file_id").alias("id"))).select("id", "path")


def delete_paths(spark: SparkSession, d: str) -> DataFrame:
    return tables.without_paths(_files(spark, d), table(spark, d, "scan_records")).select("id", "path")


def dependents(spark: SparkSession, d: str) -> DataFrame:
    left = tables.without_subtree(_files(spark, d), "/home")
    return tables.dependents(_texts(spark, d), left).select("file_id")


def oversize_states(spark: SparkSession, d: str) -> DataFrame:
    return tables.oversize_not_applicable(_files(spark, d), 10_000, "/srv/share").groupBy("content_state").agg(F.count("*").alias("files"))


def reset_pending(spark: SparkSession, d: str) -> DataFrame:
    return tables.reset_pending(_files(spark, d), F.col("mime") == "text/plain").groupBy("content_state").agg(F.count("*").alias("files"))


def _newest_scan(spark: SparkSession, d: str) -> DataFrame:
    """The newest reading of each path, as a scan."""
    r = table(spark, d, "scan_records").filter("mtime is not null")
    newest = r.groupBy("path").agg(F.max(F.struct("seen_at", "batch_no", "rec_id", "mtime", "size")).alias("r"))
    return newest.select("path", F.col("r.mtime").alias("mtime"), F.col("r.size").alias("size"))


def classify_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.classify(_newest_scan(spark, d), _files(spark, d)).select("path", "action")


def stale_paths(spark: SparkSession, d: str) -> DataFrame:
    unreadable = spark.createDataFrame([("/home/pilo",), ("/srv/share/inbox",)], "path string")
    return reconcile.stale(_files(spark, d), _newest_scan(spark, d), unreadable)


def insert_missing(spark: SparkSession, d: str) -> DataFrame:
    new = _newest_scan(spark, d).select("*", F.regexp_extract("path", r"[^/]*$", 0).alias("name"))
    return tables.insert_missing(_files(spark, d), new).select("id", "path", "mtime", "size")


def update_basic(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    old = files.select("path", *[c for c in tables.BASIC if c not in ("mtime", "size")])
    new = _newest_scan(spark, d).join(old, "path")
    return tables.update_basic(files, new).select("id", "path", "mtime", "size", "content_state")


def mime_to_type(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).filter("mime is not null").select("mime").distinct().select("mime", mime.type_bits(F.col("mime")).alias("bits"))


def guess_mime(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("id", mime.guess_mime(F.col("name"), F.lit(None).cast("binary")).alias("mime"))


def head_hash(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d).select("file_id", F.encode("text", "UTF-8").alias("b"))
    return t.select("file_id", F.lower(F.hex(scan.head_hash(F.length("b").cast("long"), F.col("b")))).alias("hash_hex"))


def scope_covers(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).filter(reconcile.covers(_LISTED, F.col("path"))).select("id", "path")


def content_allowed(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).filter(reconcile.content_allowed(_LISTED, F.col("name"))).select("id", "name")


def reconcile_content(spark: SparkSession, d: str) -> DataFrame:
    work = reconcile.IndexWork(prune_scope=True, reconcile_content=True)
    files, _, _ = reconcile.reconcile(_files(spark, d), _texts(spark, d), _failed(spark, d), _LISTED, work)
    return files.select("id", "content_state")


def reconcile_texts(spark: SparkSession, d: str) -> DataFrame:
    work = reconcile.IndexWork(prune_scope=True, reconcile_content=True)
    _, texts, _ = reconcile.reconcile(_files(spark, d), _texts(spark, d), _failed(spark, d), _LISTED, work)
    return texts.select("file_id")


def prune_counts(spark: SparkSession, d: str) -> DataFrame:
    why = F.when(ignored(F.col("path"), _IGNORE), "ignored").when(under(F.col("path"), "/srv"), "kept under /srv").otherwise("kept")
    return _files(spark, d).groupBy(why.alias("reason")).agg(F.count("*").alias("files"))


def extensions(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).groupBy(extension_of(F.col("name")).alias("ext")).agg(F.count("*").alias("files"))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_EXT = f"translate(regexp_extract(name, '[^.].*\\.([^.]*)$', 1), '{_UP}', '{_LOW}')"
_IGNORED = (
    "(list_contains(string_split(path, '/'), 'inbox') OR len(list_filter(string_split(path, '/'), lambda c: c LIKE '%.mp3')) > 0 "
    "OR path LIKE '/srv/share/scratch/%')"
)
_BELOW = {r: f"substr(path, {len(r) + 1})" for r in _ROOTS}


def _covered() -> str:
    tests = []
    for r, below in _BELOW.items():
        part = f"string_split({below}, '/')"
        tests.append(
            f"(path >= '{r}/' AND path < '{r}0' AND NOT list_contains({part}, 'inbox') AND len(list_filter({part}, lambda c: c LIKE '%.mp3')) = 0 "
            f"AND path NOT LIKE '/srv/share/scratch/%' AND len(list_filter({part}, lambda c: c LIKE '.%')) = 0)"
        )
    return "(" + " OR ".join(tests) + ")"


_NEWEST = """newest AS (SELECT path, mtime, size FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, batch_no DESC, rec_id DESC) AS rn
    FROM scan_records WHERE mtime IS NOT NULL) WHERE rn = 1)"""
_STATE = f"""CASE WHEN NOT (coalesce(size, 1e18) <= 50000 AND ({_EXT} IN ('txt', 'md') OR {_EXT} = '')) THEN 3
             WHEN content_state = 3 THEN 0 ELSE content_state END"""

_GROUPS = """SELECT lower(hex(hash)) AS hash_hex, count(*) AS copies, sum(size)::BIGINT AS total_size,
    (sum(size) - max(size))::BIGINT AS redundant_size FROM files WHERE hash IS NOT NULL AND size > 0 GROUP BY hash HAVING count(*) > 1"""


_TYPES = """(VALUES ('application/json', 16), ('application/pdf', 8), ('application/rtf', 8), ('application/toml', 16),
    ('application/vnd.oasis.opendocument.text', 8), ('application/vnd.openxmlformats-officedocument.presentationml.presentation', 72),
    ('application/vnd.openxmlformats-officedocument.spreadsheetml.sheet', 136), ('application/vnd.openxmlformats-officedocument.wordprocessingml.document', 8),
    ('application/zip', 32), ('audio/mpeg', 1), ('image/jpeg', 2), ('image/png', 2), ('text/csv', 16), ('text/html', 24), ('text/markdown', 16),
    ('text/plain', 16), ('text/x-python', 16), ('video/mp4', 4)) AS t(mime, bits)"""
_GUESSES = """(VALUES ('txt', 'text/plain'), ('md', 'text/markdown'), ('pdf', 'application/pdf'), ('csv', 'text/csv'), ('jpg', 'image/jpeg'),
    ('log', 'text/plain'), ('html', 'text/html'), ('json', 'application/json'), ('py', 'text/x-python'), ('png', 'image/png'), ('rtf', 'application/rtf'),
    ('zip', 'application/zip'), ('mp3', 'audio/mpeg'), ('toml', 'application/toml'), ('mp4', 'video/mp4'), ('odt', 'application/vnd.oasis.opendocument.text'),
    ('docx', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'),
    ('xlsx', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'),
    ('pptx', 'application/vnd.openxmlformats-officedocument.presentationml.presentation')) AS t(ext, mime)"""


def mtimes_of(spark: SparkSession, d: str) -> DataFrame:
    return reports.mtimes_of(_files(spark, d), table(spark, d, "scan_records"))


def rows_in_folder(spark: SparkSession, d: str) -> DataFrame:
    return reports.rows_in(_files(spark, d), "/srv/share/inbox/")


def texts_unpacked(spark: SparkSession, d: str) -> DataFrame:
    """Every body from its zstd frame."""
    return _texts(spark, d).select("file_id", unpacked(F.col("text_zstd")).alias("text"))


def texts_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every body packed and unpacked again, with the size of its frame against that of the stored one."""
    rows = _texts(spark, d).select("file_id", "text", "text_zstd", packed(F.col("text")).alias("z"))
    return rows.select("file_id", (F.col("z") == F.col("text_zstd")).alias("same_frame"), (unpacked(F.col("z")) == F.col("text")).alias("same_text")).select("file_id", "same_text")


def like_escaped_names(spark: SparkSession, d: str) -> DataFrame:
    names = _files(spark, d).select("id", "name")
    return names.filter(F.col("name").like("%" + like_escaped("_") + "%")).select("id")


def live_rows(spark: SparkSession, d: str) -> DataFrame:
    """Hits of an earlier search against the catalog after a rename, a removal and newer readings."""
    files = _files(spark, d)
    shown = search.hits(files, None, "report").select("file_id", "path", "mtime")
    now = tables.update_basic(tables.without_subtree(files, "/home"), _newest_scan(spark, d).join(files.drop("mtime", "size"), "path"))
    moved = F.when(under(F.col("path"), "/mnt/archive"), F.concat(F.lit("/mnt/vault"), F.substring("path", 13, 10_000))).otherwise(F.col("path"))
    return live.live_rows(shown, now.withColumn("path", moved))


def progress_by_root(spark: SparkSession, d: str) -> DataFrame:
    return reports.progress_by_root(_files(spark, d), _ROOTS, 10_000)


def overall_progress(spark: SparkSession, d: str) -> DataFrame:
    return reports.overall_progress(_files(spark, d), _ROOTS, 10_000)


QUERIES = {
    f.__name__: f
    for f in (
        duplicate_groups, duplicate_page, duplicate_members, verify_duplicates, status_of_paths, list_failed,
        newest_failures, size_breakdown, root_counts, extract_scope, pending_count, parents_under, page_by_id,
        page_by_path, newest_per_parent, delete_subtree, delete_outside, delete_ids, delete_paths, dependents,
        oversize_states, reset_pending, classify_scan, stale_paths, insert_missing, update_basic, mime_to_type,
        guess_mime, head_hash, scope_covers, content_allowed, reconcile_content, reconcile_texts, prune_counts, extensions,
        mtimes_of, rows_in_folder, overall_progress, progress_by_root, texts_unpacked, texts_packed, like_escaped_names, live_rows,
    )
}

SQL = {
    "duplicate_groups": _GROUPS,
    "duplicate_page": _GROUPS + " ORDER BY redundant_size DESC, hash_hex LIMIT 20 OFFSET 5",
    "duplicate_members": """SELECT lower(hex(hash)) AS hash_hex, id AS file_id, name, path, size, mtime FROM files
        WHERE hash IS NOT NULL AND size > 0 AND hash IN (
            SELECT hash FROM files WHERE hash IS NOT NULL AND size > 0 GROUP BY hash HAVING count(*) > 1)""",
    "status_of_paths": """SELECT p.path, CASE WHEN f.id IS NULL THEN 'not_indexed'
            ELSE CASE f.content_state WHEN 0 THEN 'pending' WHEN 1 THEN 'done' WHEN 2 THEN 'failed' WHEN 3 THEN 'not_applicable' END
        END AS status, x.reason
        FROM (SELECT DISTINCT path FROM scan_records) p LEFT JOIN files f ON f.path = p.path LEFT JOIN failed_files x ON x.file_id = f.id""",
    "list_failed": "SELECT path, reason, ts FROM failed_files x JOIN files f ON f.id = x.file_id",
    "newest_failures": "SELECT path, reason, ts FROM failed_files x JOIN files f ON f.id = x.file_id ORDER BY ts DESC, path LIMIT 25",
    "size_breakdown": """SELECT (SELECT count(*) FROM files) AS files, count(text) AS stored_texts,
        sum(strlen(text))::BIGINT AS raw_bytes, sum(octet_length(text_zstd))::BIGINT AS stored_bytes,
        sum(octet_length(text_zstd))::DOUBLE / sum(strlen(text))::DOUBLE AS ratio FROM documents_text""",
    "root_counts": " UNION ALL ".join(
        f"SELECT '{r}' AS root, count(*) AS files, count_if(content_state = 1)::BIGINT AS with_content FROM files WHERE path >= '{r}/' AND path < '{r}0'"
        for r in _ROOTS
    ),
    "extract_scope": """SELECT count_if(content_state = 0 AND size <= 2097152)::BIGINT AS to_extract,
        count_if(content_state = 1)::BIGINT AS extracted FROM files""",
    "pending_count": "SELECT count_if(content_state = 0)::BIGINT AS pending FROM files",
    "parents_under": "SELECT DISTINCT parent FROM files WHERE parent = '/srv/share' OR (parent >= '/srv/share/' AND parent < '/srv/share0')",
    "page_by_id": """SELECT id, path, size, mime FROM files WHERE content_state = 0 AND id > 100 AND size <= 2097152
        ORDER BY id LIMIT 50""",
    "page_by_path": """SELECT id, path, size, mtime FROM files WHERE path >= '/srv/share/' AND path < '/srv/share0'
        AND path > '/srv/share/inbox/m' ORDER BY path LIMIT 50""",
    "newest_per_parent": """SELECT parent, path, mtime, n FROM (SELECT parent, path, mtime,
        row_number() OVER (PARTITION BY parent ORDER BY mtime DESC NULLS LAST, path)::INT AS n FROM files) WHERE n <= 3""",
    "delete_subtree": "SELECT id, path FROM files WHERE NOT (path >= '/srv/share/' AND path < '/srv/share0')",
    "delete_outside": "SELECT id, path FROM files WHERE (path >= '/srv/share/' AND path < '/srv/share0') OR (path >= '/home/' AND path < '/home0')",
    "delete_ids": "SELECT id, path FROM files WHERE id NOT IN (SELECT file_id FROM failed_files)",
    "delete_paths": "SELECT id, path FROM files f WHERE NOT EXISTS (SELECT 1 FROM scan_records r WHERE r.path = f.path)",
    "dependents": "SELECT file_id FROM documents_text WHERE file_id IN (SELECT id FROM files WHERE NOT (path >= '/home/' AND path < '/home0'))",
    "oversize_states": """SELECT CASE WHEN content_state = 0 AND size > 10000 AND path >= '/srv/share/' AND path < '/srv/share0'
        THEN 3 ELSE content_state END AS content_state, count(*) AS files FROM files GROUP BY 1""",
    "reset_pending": """SELECT CASE WHEN mime = 'text/plain' THEN 0 ELSE content_state END AS content_state, count(*) AS files
        FROM files GROUP BY 1""",
    "classify_scan": f"""WITH {_NEWEST} SELECT n.path, CASE WHEN f.path IS NULL THEN 'insert'
        WHEN f.mtime IS NOT DISTINCT FROM n.mtime THEN 'skip' ELSE 'update' END AS action FROM newest n LEFT JOIN files f ON f.path = n.path""",
    "stale_paths": f"""WITH {_NEWEST} SELECT path FROM files f WHERE NOT EXISTS (SELECT 1 FROM newest n WHERE n.path = f.path)
        AND NOT starts_with(path, '/home/pilo/') AND NOT starts_with(path, '/srv/share/inbox/')""",
    "insert_missing": f"""WITH {_NEWEST}, fresh AS (SELECT * FROM newest n WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.path = n.path))
        SELECT id, path, mtime, size FROM files UNION ALL
        SELECT (SELECT max(id) FROM files) + row_number() OVER (ORDER BY path) AS id, path, mtime, size FROM fresh""",
    "update_basic": f"""WITH {_NEWEST} SELECT f.id, f.path, CASE WHEN n.path IS NULL THEN f.mtime ELSE n.mtime END AS mtime,
        CASE WHEN n.path IS NULL THEN f.size ELSE n.size END AS size,
        CASE WHEN n.path IS NULL THEN f.content_state ELSE 0 END AS content_state FROM files f LEFT JOIN newest n ON n.path = f.path""",
    "mime_to_type": f"SELECT DISTINCT f.mime, t.bits::INT AS bits FROM files f LEFT JOIN {_TYPES} ON t.mime = f.mime WHERE f.mime IS NOT NULL",
    "guess_mime": f"SELECT id, t.mime FROM files LEFT JOIN {_GUESSES} ON t.ext = {_EXT}",
    "mtimes_of": "SELECT path, mtime FROM files WHERE path IN (SELECT path FROM scan_records)",
    "rows_in_folder": "SELECT id, path, mtime, size FROM files WHERE parent = '/srv/share/inbox'",
    "overall_progress": f"""SELECT *, CASE WHEN extracted + failed + to_extract > 0 THEN (extracted + failed) / (extracted + failed + to_extract)::DOUBLE END AS share
        FROM (SELECT count(*) AS walked, count_if(content_state = 0 AND size <= 10000)::BIGINT AS to_extract, count_if(content_state = 1)::BIGINT AS extracted,
              count_if(content_state = 2)::BIGINT AS failed FROM files WHERE {' OR '.join(f"starts_with(path, '{r}/')" for r in _ROOTS)})""",
    "progress_by_root": " UNION ALL ".join(
        f"""SELECT '{r}' AS root, count(*) AS walked, count_if(content_state = 0 AND size <= 10000)::BIGINT AS to_extract,
            count_if(content_state = 1)::BIGINT AS extracted FROM files WHERE starts_with(path, '{r}/')""" for r in _ROOTS),
    "texts_unpacked": "SELECT file_id, text FROM documents_text",
    "texts_packed": "SELECT file_id, true AS same_text FROM documents_text",
    "like_escaped_names": "SELECT id FROM files WHERE contains(name, '_')",
    "live_rows": f"""WITH {_NEWEST}, shown AS (SELECT id, path, mtime FROM files WHERE contains(translate(path, '{_UP}', '{_LOW}'), 'report')),
        now AS (SELECT f.id, CASE WHEN f.path >= '/mnt/archive/' AND f.path < '/mnt/archive0' THEN '/mnt/vault' || substr(f.path, 13) ELSE f.path END AS p,
                CASE WHEN n.path IS NULL THEN f.mtime ELSE n.mtime END AS m FROM files f LEFT JOIN newest n ON n.path = f.path WHERE NOT (f.path >= '/home/' AND f.path < '/home0'))
        SELECT s.id AS file_id, s.path, CASE WHEN p IS NULL THEN 'gone' WHEN p <> s.path THEN 'renamed' WHEN m IS DISTINCT FROM s.mtime THEN 'changed' ELSE 'same' END AS status,
            p AS now_path FROM shown s LEFT JOIN now ON now.id = s.id""",
    "scope_covers": f"SELECT id, path FROM files WHERE {_covered()}",
    "content_allowed": f"SELECT id, name FROM files WHERE {_EXT} IN ('txt', 'md') OR {_EXT} = ''",
    "reconcile_content": f"SELECT id, ({_STATE})::INT AS content_state FROM files WHERE {_covered()}",
    "reconcile_texts": f"""SELECT file_id FROM documents_text WHERE file_id IN (
        SELECT id FROM files WHERE {_covered()} AND ({_STATE}) <> 3)""",
    "head_hash": """SELECT file_id, sha256(unhex(array_to_string(list_transform(range(0, 8),
        lambda i: substr(printf('%016x', strlen(text)), 15 - 2 * i::INT, 2)), '')) || encode(text)) AS hash_hex FROM documents_text""",
    "prune_counts": f"""SELECT CASE WHEN {_IGNORED} THEN 'ignored' WHEN path >= '/srv/' AND path < '/srv0' THEN 'kept under /srv'
        ELSE 'kept' END AS reason, count(*) AS files FROM files GROUP BY 1""",
    "extensions": f"SELECT {_EXT} AS ext, count(*) AS files FROM files GROUP BY 1",
    "verify_duplicates": """WITH m AS (SELECT hash, path, id FROM files WHERE hash IS NOT NULL AND size > 0 AND hash IN (
            SELECT hash FROM files WHERE hash IS NOT NULL AND size > 0 GROUP BY hash HAVING count(*) > 1)),
        c AS (SELECT m.*, text FROM m LEFT JOIN documents_text d ON d.file_id = m.id),
        r AS (SELECT hash, arg_min(text, path) AS ref FROM c WHERE text IS NOT NULL GROUP BY hash)
        SELECT lower(hex(c.hash)) AS hash_hex, path, CASE WHEN text IS NULL THEN 'unreadable' WHEN text = ref THEN 'identical'
            WHEN strlen(text) <> strlen(ref) THEN 'length_differs' ELSE 'differs' END AS verdict,
            CASE WHEN text <> ref AND strlen(text) = strlen(ref) THEN
                list_min(list_filter(range(0, strlen(text)), lambda i: encode(text)[i + 1 : i + 1] <> encode(ref)[i + 1 : i + 1])) END AS "offset"
        FROM c LEFT JOIN r ON r.hash = c.hash""",
}
