"""Searches over files and documents_text, with the SQL that gives the same hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators import search
from trawl.runtime import table

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _run(text: str, limit: int | None = None, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = table(spark, sf_dir, "files")
        texts = table(spark, sf_dir, "documents_text").select("file_id", "text")
        if limit is None:
            return search.hits(files, texts, text, **options)
        return search.search(files, texts, text, limit, **options)

    return query


def _fold(col: str) -> str:
    return f"translate({col}, '{_UP}', '{_LOW}')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _literal_sql(term: str, where: str = "true", body: bool = True, path: bool = True, tail: str = "") -> str:
    """The tiers of a literal term."""
    t, low = _q(term), _q(term.lower())
    n = "(length({0}) - length(replace({0}, {1}, ''))) // length({1})"
    same, folded = n.format("text", t), n.format(_fold("text"), low)
    frac = "(1000 - least({}, 1000)) / 1000.0::DOUBLE"
    tiers = [
        (1, f"name = {t}", "1.0"), (2, f"{_fold('name')} = {low}", "2.0"),
        (3, f"contains(name, {t})", "3.0"), (4, f"contains({_fold('name')}, {low})", "4.0"),
    ]
    if body:
        tiers += [(5, f"contains(text, {t})", "5.0 + " + frac.format(same)), (6, f"contains({_fold('text')}, {low})", "6.0 + " + frac.format(folded))]
    if path:
        tiers += [(9, f"contains(path, {t})", "9.0"), (10, f"contains({_fold('path')}, {low})", "10.0")]
    return _tiers_sql(tiers, where, tail)


def _tiers_sql(tiers: list[tuple[int, str, str]], where: str = "true", tail: str = "") -> str:
    stage = " ".join(f"WHEN {c} THEN {s}" for s, c, _ in tiers)
    rank = " ".join(f"WHEN {c} THEN ({r})::DOUBLE" for _, c, r in tiers)
    return f"""
        WITH r AS (
            SELECT f.id AS file_id, name, path, size, mtime, CASE {rank} END AS rank, CASE {stage} END AS stage
            FROM files f LEFT JOIN documents_text d ON d.file_id = f.id WHERE {where})
        SELECT file_id, name, path, size, mtime, rank, stage,
               CASE WHEN stage IN (1, 2, 3, 4, 7) THEN 'name' WHEN stage IN (5, 6, 8) THEN 'contents' ELSE 'path' END AS match_field
        FROM r WHERE stage IS NOT NULL {tail}
    """


def _distance_sql(col: str, term: str = "budgte", most: int = 2) -> str:
    """The fewest edits from the term to any substring nearly as long, tried one by one."""
    m = len(term)
    return f"""list_min(flatten(list_transform(range(1, greatest(length({col}), 1) + 1), lambda i: list_transform(
        range({m - most}, {m + most + 1}), lambda n: levenshtein(substr({_fold(col)}, i, n), '{term}')))))"""


def _wild_sql(glob: list[str], where: str = "true") -> str:
    """The tiers of a wildcard of literal pieces, RE2 taking the stars; pieces hold no special signs."""
    inner, whole = "[^\\n]*?".join(glob), "[^\\n]*".join(glob)
    pieces = " AND ".join(f"contains({_fold('{0}')}, {_q(g.lower())})" for g in glob if g)
    hold = lambda c: "(" + pieces.replace("{0}", c) + ")"
    find = lambda c, f="": f"regexp_matches({c}, {_q(inner)}, '{f}')"
    n = lambda c, f: f"least(len(regexp_extract_all({c}, {_q(('(?i)' if f else '') + inner)})), 1000)"
    frac = "(1000 - {}) / 1000.0::DOUBLE"
    tiers = [
        (1, f"regexp_full_match(name, {_q(whole)})", "1.0"), (2, f"{hold('name')} AND regexp_full_match(name, {_q(whole)}, 'i')", "2.0"),
        (3, find("name"), "3.0"), (4, f"{hold('name')} AND {find('name', 'i')}", "4.0"),
        (5, find("text"), "5.0 + " + frac.format(n("text", ""))), (6, find("text", "i"), "6.0 + " + frac.format(n("text", "i"))),
        (9, find("path"), "9.0"), (10, f"{hold('path')} AND {find('path', 'i')}", "10.0"),
    ]
    return _tiers_sql(tiers, where)


def _regex_sql(pattern: str) -> str:
    p = _q(f"(?im){pattern}")
    count = f"least(len(regexp_extract_all(text, {p})), 1000)"
    return _tiers_sql(
        [
            (4, f"regexp_matches(name, {p})", "4.0"),
            (6, f"regexp_matches(text, {p})", f"6.0 + (1000 - {count}) / 1000.0::DOUBLE"),
            (10, f"regexp_matches(path, {p})", "10.0"),
        ]
    )


def search_resorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.resort(_run("index type:text")(spark, sf_dir), "size", True).limit(200)


def snippets_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents_text").select("file_id", "text")
    return search.with_snippets(_run("index", 100)(spark, sf_dir), texts, "index").select(
        "file_id", "rank", "stage", F.col("snippet.window").alias("win"), F.size("snippet.ranges").alias("ranges")
    )


def trigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.trigram_index(table(spark, sf_dir, "documents_text")).groupBy("gram").agg(F.count("*").alias("files"))


def search_without_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies indexed but not stored: every one with all trigrams of the term is a candidate."""
    texts = table(spark, sf_dir, "documents_text").select("file_id", "text")
    files = table(spark, sf_dir, "files")
    none = texts.filter("false")
    return search.hits(files, none, "restored", grams=search.trigram_index(texts))


def search_filters_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters by themselves find nothing; with a term they narrow it."""
    one = lambda q: _run(q)(spark, sf_dir).agg(F.count("*").alias("hits")).select(F.lit(q).alias("query"), "hits")
    return one("type:text path:/srv").unionByName(one("")).unionByName(one("txt type:text path:/srv"))


def search_fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(table(spark, sf_dir, "files"), None, "budgte", fuzzy=True)


def search_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored bodies, those without a trigram of the term spared."""
    texts = table(spark, sf_dir, "documents_text").select("file_id", "text")
    return search.hits(table(spark, sf_dir, "files"), texts, "restored", grams=search.trigram_index(texts))


_TYPE_TEXT = "(type & 16) <> 0"

QUERIES = {
    "search_phrase": _run("budget"),
    "search_phrase_case": _run("BUDGET"),
    "search_two_words": _run('"and nothing else"'),
    "search_short_term": _run("op"),
    "search_path_tier": _run("Documents"),
    "search_topk": _run("index", 1000),
    "search_filter_type": _run("index type:text"),
    "search_filter_modified": _run("index modified:>=2024-01-01 modified:<2025-01-01"),
    "search_filter_path": _run("report path:/srv/share"),
    "search_filter_name": _run("index name:b*t"),
    "search_filter_mime": _run("index mime:text/plain"),
    "search_session_ignore": _run("budget", ignore=["*.txt", "inbox"]),
    "search_wildcard_name": _run("budg*txt"),
    "search_wildcard_body": _run("wide*index"),
    "search_regex_only": _run("regex:[bB]udget.{0,20}0[1-4]"),
    "search_regex_accept": _run("budget regex:draft[s]?"),
    "search_fuzzy": _run("budgte", fuzzy=True),
    "search_filters_alone": search_filters_alone,
    "search_fuzzy_names": search_fuzzy_names,
    "search_pruned": search_pruned,
    "search_filter_day": _run("report modified:2024-05-17"),
    "search_filter_after": _run("report modified:>2024-05-17 mtime:<=2024-12-31"),
    "search_filter_folder": _run("report folder:/home filename:*txt"),
    "search_resorted": search_resorted,
    "search_without_texts": search_without_texts,
    "snippets_topk": snippets_topk,
    "trigram_postings": trigram_postings,
}

SQL = {
    "search_phrase": _literal_sql("budget"),
    "search_phrase_case": _literal_sql("BUDGET"),
    "search_two_words": _literal_sql("and nothing else"),
    "search_short_term": _literal_sql("op", body=False, path=False),
    "search_path_tier": _literal_sql("Documents"),
    "search_topk": _literal_sql("index", tail="ORDER BY rank, name, path LIMIT 1000"),
    "search_filter_type": _literal_sql("index", _TYPE_TEXT),
    "search_filter_modified": _literal_sql("index", "mtime >= 1704067200 AND mtime < 1735689600"),
    "search_filter_path": _literal_sql("report", f"(parent = '/srv/share' OR starts_with({_fold('parent')}, '/srv/share/'))"),
    "search_filter_name": _literal_sql("index", f"{_fold('name')} LIKE '%b%t%'"),
    "search_filter_mime": _literal_sql("index", "mime = 'text/plain'"),
    "search_session_ignore": _literal_sql("budget", "NOT (name LIKE '%.txt' OR list_contains(string_split(path, '/'), 'inbox') OR len(list_filter(string_split(path, '/'), lambda c: c LIKE '%.txt')) > 0)"),
    "search_wildcard_name": _wild_sql(["budg", "txt"]),
    "search_wildcard_body": _wild_sql(["wide", "index"]),
    "search_regex_only": _regex_sql("[bB]udget.{0,20}0[1-4]"),
    "search_regex_accept": _literal_sql(
        "budget", "(regexp_matches(path, '(?im)draft[s]?') OR coalesce(regexp_matches(text, '(?im)draft[s]?'), false))"
    ),
    "search_filters_alone": """SELECT 'type:text path:/srv' AS query, 0::BIGINT AS hits UNION ALL SELECT '', 0
        UNION ALL SELECT 'txt type:text path:/srv', count(*) FROM (""" + _literal_sql("txt", f"(type & 16) <> 0 AND (parent = '/srv' OR starts_with({_fold('parent')}, '/srv/'))") + ")",
    "search_fuzzy_names": f"""
        WITH d AS (SELECT *, {_distance_sql("name")} AS dn, {_distance_sql("path")} AS dp FROM files),
        t AS (SELECT *, CASE WHEN name = 'budgte' THEN 1 WHEN {_fold("name")} = 'budgte' THEN 2 WHEN contains(name, 'budgte') THEN 3
            WHEN contains({_fold("name")}, 'budgte') THEN 4 WHEN dn <= 2 THEN 7 WHEN contains(path, 'budgte') THEN 9
            WHEN contains({_fold("path")}, 'budgte') THEN 10 WHEN dp <= 2 THEN 11 END AS stage FROM d)
        SELECT id AS file_id, name, path, size, mtime, stage + CASE stage WHEN 7 THEN 0.1::DOUBLE * dn WHEN 11 THEN 0.1::DOUBLE * dp ELSE 0.0::DOUBLE END AS rank, stage,
            CASE WHEN stage IN (1, 2, 3, 4, 7) THEN 'name' ELSE 'path' END AS match_field FROM t WHERE stage IS NOT NULL""",
    "search_pruned": _literal_sql("restored"),
    "search_filter_day": _literal_sql("report", "mtime >= 1715904000 AND mtime < 1715990400"),
    "search_filter_after": _literal_sql("report", "mtime > 1715904000 AND mtime <= 1735603200"),
    "search_filter_folder": _literal_sql("report", f"(parent = '/home' OR starts_with({_fold('parent')}, '/home/')) AND {_fold('name')} LIKE '%txt'"),
    "search_without_texts": _tiers_sql(
        [
            (1, "name = 'restored'", "1.0"), (2, f"{_fold('name')} = 'restored'", "2.0"), (3, "contains(name, 'restored')", "3.0"),
            (4, f"contains({_fold('name')}, 'restored')", "4.0"), (6, " AND ".join(f"contains({_fold('text')}, '{g}')" for g in ("res", "est", "sto", "tor", "ore", "red")), "6.999"),
            (9, "contains(path, 'restored')", "9.0"), (10, f"contains({_fold('path')}, 'restored')", "10.0"),
        ]
    ),
    "search_resorted": _literal_sql("index", _TYPE_TEXT, tail="ORDER BY size DESC, path LIMIT 200"),
    "trigram_postings": f"""
        SELECT gram, count(*) AS files FROM (
            SELECT DISTINCT file_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr({_fold('text')}, i, 3))) AS gram
            FROM documents_text WHERE length(text) >= 3) GROUP BY gram
    """,
}
