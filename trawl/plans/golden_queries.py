"""Operators without a table of their own, on fixed cases; the SQL states the results expected, written out by hand."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import format as fmt
from trawl.functions import kernels
from trawl.model import FILES, Config, FileType, Outcome
from trawl.operators import reconcile, search
from trawl.query import LexError, Pattern, QueryError, parse, tokenize_spanned
from trawl.query.filters import day_start, is_filter_key
from trawl.query.highlight import classify
from trawl.sources import encoding, extract
from trawl.streaming import events as ev


def _values(columns: str, rows: list[tuple]) -> str:
    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x!r}::{'DOUBLE' if isinstance(x, float) else 'BIGINT'}"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({', '.join(f'"{c.strip()}"' for c in columns.split(','))})"


# What is expected: one row per case and result.
TOKENS = [
    ('a "b ""c""" (AND)', 0, "word", "a", 0, 1), ('a "b ""c""" (AND)', 1, "quoted", 'b "c"', 2, 11), ('a "b ""c""" (AND)', 2, "(", "(", 12, 13),
    ('a "b ""c""" (AND)', 3, "and", "AND", 13, 16), ('a "b ""c""" (AND)', 4, ")", ")", 16, 17), ("x<=1", 0, "word", "x", 0, 1),
    ("x<=1", 1, "op", "<=", 1, 3), ("x<=1", 2, "word", "1", 3, 4), ("path:C:\\x", 0, "word", "path", 0, 4), ("path:C:\\x", 1, "op", ":", 4, 5),
    ("path:C:\\x", 2, "word", "C:\\x", 5, 9), ("ab:/x", 0, "word", "ab", 0, 2), ("ab:/x", 1, "op", ":", 2, 3), ("ab:/x", 2, "word", "/x", 3, 5),
    ('é "x', 0, "word", "é", 0, 2), ('é "x', 1, "error", "", 3, 3), ("a OR b", 0, "word", "a", 0, 1), ("a OR b", 1, "or", "OR", 2, 4), ("a OR b", 2, "word", "b", 5, 6),
]
TERMS = [
    ("a AND b", "a AND b"), ("(a b)", "a b"), ("12:30", "12:30"), ("foo:bar:baz", "foo:bar:baz"), ("type:", "type:"), ("a > b", "a>b"),
    ("> b", "> b"), ('"a:b" c', "a:b c"), ('x "y', 'x "y'), ("", ""), ("type:text x", "x"), ("modified:>=2024-01-01 mime:text/plain", ""),
]
ERRORS = [
    ("type:nonsense", "UnknownProperty"), ("modified:2024-02-30", "BadDate"), ("modified:1969-12-31", "BadDate"), ("name=x", "UnsupportedOp"),
    ("regex:a regex:b", "BadRegex"), ('regex:"("', "BadRegex"), ("regex:a*", "BadRegex"), ("regex=a", "UnsupportedOp"), ("regex:\\b", "BadRegex"),
    ("fine name:x", ""),
]
DATES = [("1970-1-1", 0), ("2024-02-28", 1709078400), ("2024-03-01", 1709251200), ("2000-12-31", 978220800)]
KEYS = [
    ("type", True), ("modified", True), ("mtime", True), ("path", True), ("folder", True), ("includefolder", True), ("name", True), ("filename", True),
    ("mime", True), ("size", False), ("", False),
]
SEGMENTS = [
    ('é type:text x', "type|:|text", "keyword|operator|argument"), ("modified:>=nope", "modified|:>=|nope", "keyword|operator|invalid"), ('regex:"("', 'regex|:|"("', "keyword|operator|invalid"),
    ("12:30", "", ""),
]
PATTERNS = [
    ("a**b", "a|b", False, False), ("*x", "x", True, False), ("x*", "x", False, True), ("*", "", False, False), ("report", "report", False, False),
]
_NAMES = [
    (1, "Report", "/a"), (2, "report", "/b"), (3, "Quarterly_Report.txt", "/c"), (4, "quarterly_report.txt", "/d"), (5, "notes-cs.txt", "/e"),
    (6, "notes-ci.txt", "/f"), (7, "Reprot.txt", "/g"), (8, "body-fuzzy.txt", "/h"), (9, "alpha.bin", "/Report-archive"),
    (10, "beta.bin", "/report-archive"), (11, "gamma.bin", "/Reprot-archive"), (12, "unrelated.bin", "/z"),
]
_BODIES = [(5, "the Report was filed today"), (6, "the report was filed today"), (8, "the reoprt went missing"), (12, "nothing to see")]
RANKED = [
    *(("Report", True, i, i) for i in range(1, 12)),
    *(("report*", False, i, s) for i, s in ((2, 1), (1, 2), (4, 3), (3, 4), (6, 5), (5, 6), (10, 9), (9, 10))),
    *(("report*", True, i, s) for i, s in ((2, 1), (1, 2), (4, 3), (3, 4), (6, 5), (5, 6), (10, 9), (9, 10))),  # wildcards are never fuzzy
    *(("regex:rep.rt", False, i, s) for i, s in ((1, 4), (2, 4), (3, 4), (4, 4), (5, 6), (6, 6), (9, 10), (10, 10))),
    ("report regex:^/b", False, 2, 1),
]
BUDGETS = [(2, 2, None), (3, 2, 1), (5, 2, 1), (6, 2, 2), (64, 2, 2), (65, 2, None), (9, 3, 3), (5, 0, None)]
FUZZY_COUNTS = [("budget budgte bugdet", "budget", 2, 3), ("budge", "budget", 1, 1), ("none here", "budget", 1, 0), ("", "budget", 1, 0), ("bud get", "budget", 1, 1)]
# (text, needle, budget in bytes) to (window, first match's start, cut at the start, cut at the end)
WINDOWS = [
    ("the report was filed", "report", 600, "the report was filed", 4, False, False), ("nothing here", "report", 600, "nothing here", -1, False, False),
    ("report", "report", 600, "report", 0, False, False),
]
RANGES = [("0-2,2-3,5-6", "0-3,5-6"), ("0-4,1-2", "0-4"), ("", ""), ("3-5", "3-5")]
ENCODINGS = [
    ("68c3a9", "utf-8", "hé"), ("636166e9", "cp1252", "café"), ("fffe6800e900", "utf-16-le", "hé"), ("feff006800e9", "utf-16-be", "hé"),
    ("efbbbf68", "utf-8", "h"), ("610062", None, None), ("", "utf-8", ""),
]
EXTRACTED = [
    ("docx", 1, "a\tb\nc", None), ("xlsx", 1, "one 7 \ntwo", None), ("odt", 1, "xyz\nh", None), ("rtf", 1, "aé€\nb", None), ("id3", 1, "Song Band", None),
    ("text", 1, "ok", None), ("picture", 3, None, None), ("no type", 3, None, None), ("unreadable", 2, None, "unreadable"), ("cut", 1, "a", None),
]
WORK = [
    ("same", ""), ("order of lists", ""), ("root gone", "drop_roots"), ("root new", "reindex"), ("more ignored", "prune_scope"), ("less ignored", "reindex"),
    ("hash length", "rebuild"), ("extensions fewer", "reconcile_content"), ("extensions more", "reconcile_content,reindex"), ("no text stored", "drop_text"),
    ("text stored again", "reindex,restore_text"), ("hidden left out", "prune_scope"), ("hidden taken in", "reindex"),
]
MERGED = [("drop, then restore", "restore_text"), ("restore, then drop", "drop_text"), ("prune, then reindex", "prune_scope,reindex")]
NESTED = [("/a/b", "/a"), ("/a/b/c", "/a"), ("/a/b/c", "/a/b"), ("/x", "/x")]
DUE = [("never run", True), ("five minutes ago", False), ("an hour ago", True), ("clock went back", True), ("stopped", False)]
VERBS = [("there", "modify"), ("gone", "remove"), ("unknown", None)]
FAILURES = [("query", "query"), ("no catalog", "missing"), ("no table", "missing"), ("other version", "version"), ("other writer", "taken"), ("called off", "cancelled"), ("else", "other")]
LABELS = [("3 of 3", "3"), ("3 of more", "3+"), ("none", "0")]
FORMATS = [
    ("human_size 999", "999 B"), ("human_size 1500000", "1.5 MB"), ("clock 59", "0:59"), ("clock 3661", "1:01:01"), ("ago 7200", "2 hours ago"),
    ("shorten", "ab…gh"), ("ignore", "*.log a.log /x/*"), ("type TEXT", "16"), ("type Audio", "1"), ("type none", ""),
]


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _cases(rows: list[tuple]) -> list:
    return list(dict.fromkeys(r[0] for r in rows))


def lexer_tokens(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for text in _cases(TOKENS):
        tokens, error = tokenize_spanned(text)
        out += [(text, n, t.kind, t.text, a, b) for n, (t, a, b) in enumerate(tokens)]
        if isinstance(error, LexError):
            out.append((text, len(tokens), "error", "", error.offset, error.offset))
    return _frame(spark, out, "query string, n long, kind string, token string, from_byte long, to_byte long")


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, [(t, parse(t).term) for t in _cases(TERMS)], "query string, term string")


def query_errors(spark: SparkSession, d: str) -> DataFrame:
    def error(text: str) -> str:
        try:
            parse(text)
        except QueryError as e:
            return type(e).__name__
        return ""

    return _frame(spark, [(t, error(t)) for t in _cases(ERRORS)], "query string, error string")


def query_dates(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, [(t, day_start(t)) for t in _cases(DATES)], "day string, starts long")


def query_keys(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, [(k, is_filter_key(k)) for k in _cases(KEYS)], "word string, is_key boolean")


def query_highlight(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for text in _cases(SEGMENTS):
        data, marked = text.encode(), [s for s in classify(text) if s.kind != "plain"]
        out.append((text, "|".join(data[s.start : s.end].decode() for s in marked), "|".join(s.kind for s in marked)))
    return _frame(spark, out, "query string, parts string, kinds string")


def query_patterns(spark: SparkSession, d: str) -> DataFrame:
    made = [(t, Pattern.of([(t, True)])) for t in _cases(PATTERNS)]
    return _frame(spark, [(t, "|".join(p.segments), p.leading, p.trailing) for t, p in made], "pattern string, segments string, leading boolean, trailing boolean")


def rank_contract(spark: SparkSession, d: str) -> DataFrame:
    """A file per tier; exact, wildcard, regex and fuzzy queries over them."""
    files = _frame(spark, [(i, n, f"{p}/{n}", p, 42, 1, "text/plain", 16, 1, None) for i, n, p in _NAMES], FILES)
    texts = _frame(spark, _BODIES, "file_id long, text string")
    out = None
    for q, fuzzy in dict.fromkeys((r[0], r[1]) for r in RANKED):
        one = search.hits(files, texts, q, fuzzy=fuzzy).select(F.lit(q).alias("query"), F.lit(fuzzy).alias("fuzzy"), "file_id", F.col("stage").cast("long").alias("stage"))
        out = one if out is None else out.unionByName(one)
    return out


def fuzzy_budgets(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, [(n, cap, kernels.edit_budget(n, cap)) for n, cap, _ in BUDGETS], "size long, cap long, budget long")


def fuzzy_counts(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, [(t, p, k, kernels.Approximate(p.encode(), k).count(t.encode())) for t, p, k, _ in FUZZY_COUNTS], "text string, term string, edits long, n long")


def snippet_windows(spark: SparkSession, d: str) -> DataFrame:
    import re

    out = []
    for text, needle, budget, *_ in WINDOWS:
        w = kernels.cut_window(text, kernels.byte_ranges(text, re.compile(needle)), budget)
        out.append((text, needle, budget, w["window"], w["ranges"][0]["start"] if w["ranges"] else -1, w["truncated_start"], w["truncated_end"]))
    return _frame(spark, out, "text string, needle string, budget long, win string, at long, cut_start boolean, cut_end boolean")


def snippet_ranges(spark: SparkSession, d: str) -> DataFrame:
    def merged(text: str) -> str:
        ranges = [tuple(map(int, r.split("-"))) for r in text.split(",") if r]
        return ",".join(f"{a}-{b}" for a, b in kernels.merge_ranges(ranges))

    return _frame(spark, [(r, merged(r)) for r in _cases(RANGES)], "ranges string, merged string")


def text_encodings(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for h in _cases(ENCODINGS):
        data = bytes.fromhex(h)
        name = encoding.encoding_of(data)
        out.append((h, name, None if name is None else encoding.decode(data)))
    return _frame(spark, out, "bytes string, encoding string, text string")


def _container(members: dict[str, str]) -> bytes:
    import io
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return buf.getvalue()


def extracted_texts(spark: SparkSession, d: str) -> DataFrame:
    word = '<w:document xmlns:w="w"><w:p><w:t>a</w:t><w:tab/><w:t>b</w:t></w:p><w:p><w:t>c</w:t></w:p></w:document>'
    shared = '<sst xmlns="x"><si><t>one</t></si><si><r><t>tw</t></r><r><t>o</t></r></si></sst>'
    sheet = '<worksheet xmlns="x"><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row><row><c t="s"><v>1</v></c></row></sheetData></worksheet>'
    odt = '<o xmlns:t="t"><t:p>x<t:span>y</t:span>z</t:p><t:h>h</t:h></o>'
    tag = lambda k, v: k + (len(v) + 1).to_bytes(4, "big") + b"\0\0" + b"\3" + v
    tags = tag(b"TIT2", b"Song") + tag(b"TPE1", b"Band")
    office = "application/vnd.openxmlformats-officedocument."
    given = {
        "docx": (office + "wordprocessingml.document", _container({"word/document.xml": word}), 100),
        "xlsx": (office + "spreadsheetml.sheet", _container({"xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": sheet}), 100),
        "odt": ("application/vnd.oasis.opendocument.text", _container({"content.xml": odt}), 100),
        "rtf": ("application/rtf", rb"{\rtf1{\fonttbl x}a\'e9\u8364?\par b}", 100),
        "id3": ("audio/mpeg", b"ID3\3\0\0" + bytes([0, 0, 0, len(tags)]) + tags, 100),
        "text": ("text/plain", b"ok", 100), "picture": ("image/png", b"", 100), "no type": (None, b"x", 100), "unreadable": ("text/plain", None, 100),
        "cut": ("text/plain", "aéb".encode(), 2),
    }
    return _frame(spark, [(k, *extract.decide(*v)) for k, v in given.items()], "item string, content_state long, text string, reason string")


def _named(work: reconcile.IndexWork) -> str:
    return ",".join(sorted(f for f in work.__dataclass_fields__ if getattr(work, f)))


def settings_work(spark: SparkSession, d: str) -> DataFrame:
    a = Config(roots=("/a", "/b"), ignore=("x", "y"), content_extensions=("txt", "md"))
    change = {
        "same": {}, "order of lists": {"roots": ("/b/", "/a")}, "root gone": {"roots": ("/a",)}, "root new": {"roots": ("/a", "/b", "/c")},
        "more ignored": {"ignore": ("x", "y", "z")}, "less ignored": {"ignore": ("x",)}, "hash length": {"hash_length": 1},
        "extensions fewer": {"content_extensions": ("md",)}, "extensions more": {"content_extensions": ("txt", "md", "log")}, "no text stored": {"store_text": False},
        "hidden taken in": {"include_hidden": True},
    }
    out = [(k, _named(reconcile.diff_actions(a, Config(**{**a.__dict__, **v})))) for k, v in change.items()]
    back = {"text stored again": {"store_text": False}, "hidden left out": {"include_hidden": True}}
    out += [(k, _named(reconcile.diff_actions(Config(**{**a.__dict__, **v}), a))) for k, v in back.items()]
    return _frame(spark, out, "change string, work string")


def settings_merged(spark: SparkSession, d: str) -> DataFrame:
    w = reconcile.IndexWork
    out = [
        ("drop, then restore", w(drop_text=True).merge(w(restore_text=True))), ("restore, then drop", w(restore_text=True).merge(w(drop_text=True))),
        ("prune, then reindex", w(prune_scope=True).merge(w(reindex=True))),
    ]
    return _frame(spark, [(k, _named(x)) for k, x in out], "change string, work string")


def nested_roots(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, reconcile.nested_roots(["/a", "/a/b/", "/a/b/c", "/ab", "/x", "/x"]), "inner_root string, outer_root string")


def run_due(spark: SparkSession, d: str) -> DataFrame:
    s, now = ev.Schedule(), datetime(2026, 1, 1)
    last = {"never run": None, "five minutes ago": now - timedelta(minutes=5), "an hour ago": now - timedelta(hours=1), "clock went back": now + timedelta(minutes=5)}
    out = [(k, s.due(v, now)) for k, v in last.items()] + [("stopped", ev.Schedule(mode="stopped").due(None, now))]
    return _frame(spark, out, "last string, due boolean")


def path_verbs(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, [(k, ev.verb_for(x)) for k, x in (("there", True), ("gone", False), ("unknown", None))], "path string, verb string")


def result_labels(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, [("3 of 3", Outcome(3).label()), ("3 of more", Outcome(3, True).label()), ("none", Outcome().label())], "found string, label string")


def error_kinds(spark: SparkSession, d: str) -> DataFrame:
    from trawl.catalog import CatalogDrift
    from trawl.commits import Taken
    from trawl.query.errors import BadRegex, kind_of

    given = {
        "query": BadRegex("x"), "no catalog": FileNotFoundError("x"), "no table": RuntimeError("[PATH_NOT_FOUND] x"), "other version": CatalogDrift("x"),
        "other writer": Taken("x"), "called off": RuntimeError("Job 3 cancelled"), "else": ValueError("x"),
    }
    return _frame(spark, [(k, kind_of(e)) for k, e in given.items()], "error string, kind string")


def formats(spark: SparkSession, d: str) -> DataFrame:
    named = lambda n: "" if (t := FileType.named(n)) is None else str(int(t))
    out = [
        ("human_size 999", fmt.human_size(999)), ("human_size 1500000", fmt.human_size(1_500_000)), ("clock 59", fmt.clock(59)), ("clock 3661", fmt.clock(3661)),
        ("ago 7200", fmt.ago(0, 7200)), ("shorten", fmt.shorten_middle("abcdefgh", 5)), ("ignore", " ".join(fmt.ignore_patterns("/x/a.log"))),
        ("type TEXT", named("TEXT")), ("type Audio", named("Audio")), ("type none", named("none")),
    ]
    return _frame(spark, out, "what string, shown string")


QUERIES = {
    f.__name__: f
    for f in (
        lexer_tokens, query_terms, query_errors, query_dates, query_keys, query_highlight, query_patterns, rank_contract, fuzzy_budgets, fuzzy_counts,
        snippet_windows, snippet_ranges, text_encodings, extracted_texts, settings_work, settings_merged, nested_roots, run_due, path_verbs, result_labels, error_kinds, formats,
    )
}

SQL = {
    "lexer_tokens": _values("query, n, kind, token, from_byte, to_byte", TOKENS),
    "query_terms": _values("query, term", TERMS),
    "query_errors": _values("query, error", ERRORS),
    "query_dates": _values("day, starts", DATES),
    "query_keys": _values("word, is_key", KEYS),
    "query_highlight": _values("query, parts, kinds", SEGMENTS),
    "query_patterns": _values("pattern, segments, leading, trailing", PATTERNS),
    "rank_contract": _values("query, fuzzy, file_id, stage", RANKED),
    "fuzzy_budgets": _values("size, cap, budget", BUDGETS),
    "fuzzy_counts": _values("text, term, edits, n", FUZZY_COUNTS),
    "snippet_windows": _values("text, needle, budget, win, at, cut_start, cut_end", WINDOWS),
    "snippet_ranges": _values("ranges, merged", RANGES),
    "text_encodings": _values("bytes, encoding, text", ENCODINGS),
    "extracted_texts": _values("item, content_state, text, reason", EXTRACTED),
    "settings_work": _values("change, work", WORK),
    "settings_merged": _values("change, work", MERGED),
    "nested_roots": _values("inner_root, outer_root", NESTED),
    "run_due": _values("last, due", DUE),
    "path_verbs": _values("path, verb", VERBS),
    "error_kinds": _values("error, kind", FAILURES),
    "result_labels": _values("found, label", LABELS),
    "formats": _values("what, shown", FORMATS),
}
