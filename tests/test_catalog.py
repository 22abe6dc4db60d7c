import random
import os
import zipfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from trawl.catalog import Catalog
from trawl.functions.text import ancestors, extension_of, ignored, under
from trawl.model import EVENTS, FILES, Config
from trawl.operators import ingest, reconcile, reports, tables
from trawl.sources import extract, mime
from trawl.sources.encoding import decode, encoding_of
from trawl.sources.scan import binary_scan, head_hash
from trawl.streaming import events as ev

T = lambda s: datetime.fromtimestamp(s, timezone.utc)


def test_full_run_twice(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "a" / ".git").mkdir(parents=True)
    (tree / "b").mkdir()
    (tree / "a" / "x.txt").write_text("hello world")
    (tree / "a" / ".git" / "c").write_text("no")
    (tree / "a" / "y.bin").write_bytes(b"\0\1" * 40)
    (tree / "b" / "z.rtf").write_text(r"{\rtf1 hi \b there\par x}")
    (tree / "b" / "bad.docx").write_bytes(b"PKno")
    cat, config = Catalog(spark, str(tmp_path / "cat")), Config(roots=(str(tree),))
    assert ingest.full_run(spark, cat, config, now=7) == {"insert": 4, "removed": 0}
    states = {r.name: r.content_state for r in cat.table("files").collect()}
    assert states == {"x.txt": 1, "y.bin": 3, "z.rtf": 1, "bad.docx": 2}
    assert sorted(r.text for r in cat.table("documents_text").collect()) == ["hello world", "hi there\nx"]
    ids = {r.path: r.id for r in cat.table("files").collect()}
    os.utime(tree / "a" / "x.txt", (1, 1))
    os.remove(tree / "b" / "z.rtf")
    assert ingest.full_run(spark, cat, config, now=8) == {"skip": 2, "update": 1, "removed": 1}
    assert all(ids[r.path] == r.id for r in cat.table("files").collect()) and cat.meta()["last_full_index"] == "8"
    before = cat.epoch
    with pytest.raises(RuntimeError):
        cat.commit({}, before - 1)
    assert cat.compact(1) > 0 and cat.table("files").count() == 3
    assert reconcile.Fingerprint.read(cat.meta()).conflicts(Config(hash_length=1)) == [("hash_length", "8192", "1")]
    assert binary_scan(spark, [str(tree)], config).count() == 3


def test_settings_diff():
    base = Config(roots=("/a", "/b"))
    assert reconcile.diff_actions(base, Config(roots=("/b", "/a/"))).nothing
    assert reconcile.diff_actions(base, Config(roots=("/a",))).drop_roots == {"/b"}
    assert reconcile.diff_actions(base, Config(roots=("/a", "/b"), hash_length=1)).rebuild
    more = Config(roots=("/a", "/b"), ignore=(*base.ignore, "x"))
    assert reconcile.diff_actions(base, more).prune_scope and reconcile.diff_actions(more, base).reindex
    few = Config(roots=("/a", "/b"), content_extensions=("txt",))
    assert not reconcile.diff_actions(base, few).reindex and reconcile.diff_actions(few, base).reindex
    work = reconcile.IndexWork(drop_text=True).merge(reconcile.IndexWork(restore_text=True))
    assert work.restore_text and not work.drop_text
    with pytest.raises(ValueError):
        Config(tokenize="porter")


def test_scope(spark):
    c = Config(roots=("/r/.x", "/s"), ignore=("node_modules", "*.tmp", "/s/skip"))
    paths = ["/r/.x/a", "/r/.x/.h/a", "/s/a.tmp", "/s/node_modules/b", "/s/skip/c", "/s/skipper/c", "/t/a", "/s0/a", "/s/.b"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in df.filter(reconcile.covers(c, F.col("path"))).collect()] == ["/r/.x/a", "/s/skipper/c"]
    assert df.filter(ignored(F.col("path"), ["no*s"])).count() == 1 and df.filter(under(F.col("path"), "/s")).count() == 5


def test_text_columns(spark):
    df = spark.createDataFrame([("/a/b/c.TXT", "c.TXT"), ("/x", ".bashrc"), ("/a/n", "n")], "p string, n string")
    got = df.select(ancestors(F.col("p")).alias("a"), extension_of(F.col("n")).alias("e")).collect()
    assert [r.e for r in got] == ["txt", "", ""] and got[0].a == ["/a", "/a/b"]


def test_stale_shields_unreadable(spark):
    files = spark.createDataFrame([(1, "/a/x"), (2, "/b/y"), (3, "/b/deep/z"), (4, "/c/w")], "id long, path string")
    scan = spark.createDataFrame([("/c/w",)], "path string")
    bad = spark.createDataFrame([("/b",)], "path string")
    assert [r.path for r in reconcile.stale(files, scan, bad).collect()] == ["/a/x"]


def file_rows(spark, rows):
    return spark.createDataFrame([(i, p.rsplit("/", 1)[-1], p, p.rsplit("/", 1)[0], s, m, None, 0, st, h) for i, p, s, m, st, h in rows], FILES)


def test_tables(spark):
    files = file_rows(spark, [(1, "/a/x", 1, 1, 1, None), (7, "/a/y", 9, 1, 0, None)])
    new = spark.createDataFrame([("/b/2", 5, 5), ("/b/1", 5, 5), ("/b/1", 4, 4), ("/a/x", 0, 0)], "path string, mtime long, size long")
    got = {r.path: (r.id, r.mtime) for r in tables.insert_missing(files, new).collect()}
    assert got == {"/a/x": (1, 1), "/a/y": (7, 1), "/b/1": (8, 5), "/b/2": (9, 5)}
    assert tables.only_under(files, []).count() == 2 and tables.without_subtree(files, "/a").count() == 0
    assert {r.id: r.content_state for r in tables.oversize_not_applicable(files, 5).collect()} == {1: 1, 7: 3}
    texts, failed = spark.createDataFrame([(1, "old")], "file_id long, text string"), spark.createDataFrame([(7, "r", 1)], "file_id long, reason string, ts long")
    done = spark.createDataFrame([(1, "new"), (7, "")], "file_id long, text string")
    f, t, x = tables.content_done(files, texts, failed, done)
    assert {r.id: r.content_state for r in f.collect()} == {1: 1, 7: 1} and [r.text for r in t.collect()] == ["new"] and x.count() == 0


def test_duplicates_and_verification(spark):
    h = bytes(32)
    files = file_rows(spark, [(1, "/a", 3, 1, 1, h), (2, "/b", 3, 1, 1, h), (3, "/c", 3, 1, 1, h), (4, "/d", 3, 1, 1, h), (5, "/e", 0, 1, 1, h), (6, "/f", 3, 1, 1, None)])
    group = reports.duplicate_groups(files).head()
    assert (group.copies, group.total_size, group.redundant_size) == (4, 12, 9)
    contents = spark.createDataFrame([("/b", b"abc"), ("/c", b"abd"), ("/d", b"ab")], "path string, content binary")
    got = {r.path: (r.verdict, r.offset) for r in reports.verify_groups(reports.duplicate_members(files), contents).collect()}
    assert got == {"/a": ("unreadable", None), "/b": ("identical", None), "/c": ("differs", 2), "/d": ("length_differs", None)}


def test_events(spark):
    rows = [
        (1, T(1), "create", "/a", None), (2, T(2), "remove", "/a", None), (3, T(3), "modify", "/b", None), (3, T(3), "modify", "/b", None),
        (4, T(4), "rename", "/c", "/d"), (5, T(5), "rename", "/e", None), (6, T(6), "remove", "/f", None), (7, T(7), "remove", "/f/g", None),
        (8, T(8), "create", "/f/h", None), (None, T(9), "modify", "/n", None), (9, T(9), "modify", None, None),
    ]
    ops = ev.normalise(spark.createDataFrame(rows, EVENTS))
    assert sorted((r.path, r.op) for r in ops.collect()) == [
        ("/b", "modify"), ("/c", "remove"), ("/d", "create"), ("/e", "remove"), ("/f", "remove"), ("/f/h", "create"),
    ]
    files = file_rows(spark, [(1, "/f/old", 1, 1, 1, None), (2, "/b", 1, 1, 1, None), (3, "/keep", 1, 1, 1, None), (4, "/fx", 1, 1, 1, None)])
    found = spark.createDataFrame([("/b", 5, 1), ("/d", 5, 1), ("/f/h", 5, 1)], "path string, mtime long, size long")
    full = found.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("parent", "string"), ("mime", "string"), ("type", "int"), ("hash", "binary"))])
    got = {r.path: r.mtime for r in ev.apply_to(files, ops, full).collect()}
    assert got == {"/b": 5, "/d": 5, "/f/h": 5, "/keep": 1, "/fx": 1}
    assert ev.normalise(spark.createDataFrame([], EVENTS)).count() == 0


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"seq":1,"ts":"2026-01-01T00:00:00Z","op":"create","path":"/a"}\n{"seq":2,"ts":"2026-01-01T00:00:01Z","op":"modify","path":"/a"}\n')
    got, full = [], []
    stream = ev.read_events(spark, str(tmp_path / "in"))
    ev.watch(stream, lambda ops, n: got.extend((r.path, r.op, n) for r in ops.collect()), lambda: full.append(1), str(tmp_path / "s1"), once=True).awaitTermination()
    assert got == [("/a", "modify", 0)]
    ev.watch(stream, lambda ops, n: got.append(n), lambda: full.append(1), str(tmp_path / "s2"), once=True, overflow=0).awaitTermination()
    assert full == [1] and len(got) == 1


def test_streamed_sessions_are_whole(spark, tmp_path):
    from trawl.plans import event_queries

    day = 86400
    rows = [(1, T(0), "create", "/a/x", None), (2, T(60), "modify", "/a/x", None), (2, T(60), "modify", "/a/x", None)]
    rows += [(3, T(20 * day), "modify", "/a/x", None), (4, T(20 * day + 99), "remove", "/a/x", None), (5, T(20 * day), "create", "/b/x", None)]
    rows += [(6, T(5), "create", "/c/x", None), (6, T(2 * day), "create", "/c/x", None), (7, T(9), "create", "/c/y", None), (None, T(9), "create", "/c/z", None)]
    spark.createDataFrame(rows, EVENTS).repartition(3).write.parquet(str(tmp_path / "fs_events.parquet"))
    got = event_queries.sessions_streamed(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, event_queries.debounce_sessions(spark, str(tmp_path)).collect()))
    assert got.count() == 5


def test_schedule():
    s, now = ev.Schedule(), datetime(2026, 1, 1)
    assert s.due(None, now) and not s.due(now - timedelta(minutes=5), now) and s.due(now + timedelta(minutes=5), now)
    assert ev.verb_for(None) is None and ev.verb_for(True) == "modify" and ev.verb_for(False) == "remove"


def test_types_and_hash(spark):
    df = spark.createDataFrame([(m,) for m in ("image/svg+xml", "text/html", "application/zip", "audio/x", "noslash", None)], "m string")
    assert [r[0] for r in df.select(mime.type_bits(F.col("m"))).collect()] == [18, 24, 32, 1, 0, None]
    import hashlib

    one = spark.range(1).select(head_hash(F.lit(5).cast("long"), F.lit(b"hello"), 3).alias("h")).head().h
    assert bytes(one) == hashlib.sha256((5).to_bytes(8, "little") + b"hel").digest()
    heads = spark.createDataFrame([("a.ts", b"plain words"), ("a.ts", b"\0\1\2"), ("a.bat", b"\0"), ("q", b"%PDF-1"), ("q", b""), ("b.xls", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")], "n string, h binary")
    assert [r[0] for r in heads.select(mime.guess_mime(F.col("n"), F.col("h"))).collect()] == ["text/plain", "text/typescript", "text/plain", "application/pdf", None, "application/vnd.ms-excel"]


def test_encodings():
    assert encoding_of("aé".encode()[:-1], True) == "utf-8" and encoding_of("aé".encode()[:-1]) == "cp1252"
    assert encoding_of(b"a\0b") is None and decode("hé".encode("utf-16")) == "hé" and decode(b"caf\xe9") == "café"


@pytest.mark.parametrize(
    "name, text",
    [
        ("cp1251", "Привет, это обычный русский текст в старой кодировке."), ("koi8-r", "Привет, это обычный русский текст в старой кодировке."),
        ("cp866", "Привет, это обычный русский текст в старой кодировке."), ("cp1253", "Καλημέρα, αυτό είναι ένα ελληνικό κείμενο."),
        ("cp1252", "Déjà vu: le café était fermé, voilà une façon étrange."), ("cp1250", "Zażółć gęślą jaźń, dziś wieczór będzie źle."),
        ("cp932", "これは日本語の文章です。文字コードを調べます。"), ("euc_jp", "これは日本語の文章です。文字コードを調べます。"), ("gbk", "这是一个中文文件，我们要检查它的编码。"),
        ("euc_kr", "이것은 한국어 문장입니다. 인코딩을 확인합니다."), ("big5", "這是一個中文檔案，我們要檢查它的編碼。"),
    ],
)
def test_legacy_encodings(name, text):
    assert decode(text.encode(name)) == text


def test_rolling_rate_looks_back(spark):
    rng = random.Random(5)
    points = sorted({rng.randint(0, 200) for _ in range(60)})
    done = {t: i * rng.randint(1, 3) for i, t in enumerate(points)}
    df = spark.createDataFrame([(T(t), done[t]) for t in points] + [(None, 5)], "ts timestamp, done long")
    got = {r.at_us // 1_000_000: r.rate for r in reports.rolling_rate(df, 30).collect()}
    want = {}
    for t in points:
        a = min(p for p in points if t - 30 <= p)
        want[t] = None if a == t else (done[t] - done[a]) / (t - a)
    assert got.keys() == want.keys() and all(want[t] is None and got[t] is None or abs(got[t] - want[t]) < 1e-9 for t in points)


def container(members):
    import io

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return buf.getvalue()


def test_extractors(spark):
    w = '<w:document xmlns:w="w"><w:p><w:t>a</w:t><w:tab/><w:t>b</w:t></w:p><w:p><w:t>c</w:t></w:p></w:document>'
    assert extract.docx(container({"word/document.xml": w})) == "a\tb\nc"
    s = '<sst xmlns="x"><si><t>one</t></si><si><r><t>tw</t></r><r><t>o</t></r></si></sst>'
    sheet = '<worksheet xmlns="x"><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row><row><c t="s"><v>1</v></c></row></sheetData></worksheet>'
    assert extract.xlsx(container({"xl/sharedStrings.xml": s, "xl/worksheets/sheet1.xml": sheet})) == "one 7 \ntwo"
    o = '<o xmlns:t="t"><t:p>x<t:span>y</t:span>z</t:p><t:h>h</t:h></o>'
    assert extract.open_document(container({"content.xml": o})) == "xyz\nh"
    assert extract.rtf(rb"{\rtf1{\fonttbl x}a\'e9\u8364?\par b}") == "aé€\nb"
    tag = lambda k, v: k + (len(v) + 1).to_bytes(4, "big") + b"\0\0" + b"\3" + v
    body = tag(b"TIT2", b"Song") + tag(b"TPE1", b"Band")
    assert extract.audio(b"ID3\3\0\0" + bytes([0, 0, 0, len(body)]) + body) == "Song Band"
    rows = spark.createDataFrame([(1, "text/plain", b"ok"), (2, "application/pdf", b"%PDF"), (3, "image/png", b""), (4, "text/plain", None), (5, None, b"x"), (6, "application/msword", b"junk")], "id long, mime string, content binary")
    assert {r.id: r.content_state for r in extract.extract_texts(rows, 10).collect()} == {1: 1, 2: 2, 3: 3, 4: 2, 5: 3, 6: 2}
    assert extract.cut_bytes("aéb", 2) == "a"


def test_entry_lists_queries():
    import __spark_entry__

    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {"p2_found", "p5_found", "search_phrase"} <= set(names) and set(sql) <= set(names)
