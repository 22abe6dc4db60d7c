import re

import pytest

from trawl.functions.kernels import Approximate, byte_ranges, cut_window, edit_budget, merge_ranges
from trawl.model import FILES
from trawl.operators import search

NAMES = [
    (1, "Report", "/a"), (2, "report", "/b"), (3, "Quarterly_Report.txt", "/c"), (4, "quarterly_report.txt", "/d"),
    (5, "notes-cs.txt", "/e"), (6, "notes-ci.txt", "/f"), (7, "Reprot.txt", "/g"), (8, "body-fuzzy.txt", "/h"),
    (9, "alpha.bin", "/Report-archive"), (10, "beta.bin", "/report-archive"), (11, "gamma.bin", "/Reprot-archive"),
    (12, "unrelated.bin", "/z"),
]
TEXTS = [(5, "the Report was filed today"), (6, "the report was filed today"), (8, "the reoprt went missing"), (12, "nothing to see")]


def catalog(spark, names, texts):
    rows = [(i, n, f"{d}/{n}", d, 42, 1, "text/plain", 16, 1, None) for i, n, d in names]
    return spark.createDataFrame(rows, FILES), spark.createDataFrame(texts, "file_id long, text string")


def stages(files, texts, query, **options):
    return [(r.file_id, r.stage) for r in search.search(files, texts, query, **options).collect()]


def test_one_file_per_stage(spark):
    files, texts = catalog(spark, NAMES, TEXTS)
    assert stages(files, texts, "Report", fuzzy=True) == [(i, i) for i in range(1, 12)]


def test_wildcards_and_regex(spark):
    files, texts = catalog(spark, NAMES, TEXTS)
    assert stages(files, texts, "report*") == [(2, 1), (1, 2), (4, 3), (3, 4), (6, 5), (5, 6), (10, 9), (9, 10)]
    assert [s for _, s in stages(files, texts, "regex:rep.rt")] == [4, 4, 4, 4, 6, 6, 10, 10]
    assert stages(files, texts, "report regex:^/b") == [(2, 1)]
    assert stages(files, texts, "*") == [] and stages(files, texts, "type:text") == []


def test_occurrences_rank(spark):
    files, texts = catalog(spark, [(i, f"n{i}", "/d") for i in (1, 2, 3)], [(1, "zebra"), (2, "zebra " * 3), (3, "zebra " * 1500)])
    assert [(r.file_id, r.rank) for r in search.search(files, texts, "zebra").collect()] == [(3, 5.0), (2, 5.997), (1, 5.999)]


@pytest.mark.parametrize(
    "query, ids",
    [("100%", [1]), ("a_b", [3]), ("cafe", []), ("É", [5]), ("wond*world", [6]), ("C:", [])],
)
def test_literals(spark, query, ids):
    names = [(1, "100%.txt", "/x"), (2, "1000.txt", "/x"), (3, "a_b", "/x"), (4, "axb", "/x"), (5, "É", "/x"), (6, "w1", "/x"), (7, "w2", "/x"), (8, "é", "/x")]
    files, texts = catalog(spark, names, [(2, "a café here"), (6, "a wonderful world"), (7, "world of wonder"), (8, "wonder\nworld")])
    assert [i for i, _ in stages(files, texts, query)] == ids


def test_short_terms_look_at_names_only(spark):
    files, texts = catalog(spark, [(1, "ab", "/x"), (2, "q", "/ab"), (3, "r", "/x")], [(3, "ab")])
    assert stages(files, texts, "ab") == [(1, 1)]


def test_ignores_filters_limit(spark):
    files, texts = catalog(spark, [(i, f"alpha{i}.{'log' if i % 2 else 'txt'}", "/keep" if i < 5 else "/logs") for i in range(1, 9)], [])
    assert len(stages(files, texts, "alpha path:/keep")) == 4
    assert {i for i, _ in stages(files, texts, "alpha", ignore=["*.log", "logs"])} == {2, 4}
    rows, outcome = search.run(files, texts, "alpha", 3)
    assert len(rows) == 3 and outcome.limited and outcome.label() == "3+"
    rows, outcome = search.run(files, texts, "alpha", 8)
    assert len(rows) == 8 and not outcome.limited


def test_unstored_bodies(spark):
    files, texts = catalog(spark, [(1, "a", "/x"), (2, "b", "/x")], [(1, "some zebra"), (2, "horse")])
    grams = search.trigram_index(texts)
    hit = search.hits(files, None, "zebra", grams=grams).collect()
    assert [(h.file_id, h.rank, h.stage) for h in hit] == [(1, 6.999, 6)]


def test_nulls_and_empty_tables(spark):
    files, texts = catalog(spark, [], [])
    assert stages(files, texts, "x", fuzzy=True) == []
    odd = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, None), (2, "report", "/report", "", 0, 0, None, 0, 0, None)], FILES)
    assert stages(odd, spark.createDataFrame([(1, None), (2, "")], "file_id long, text string"), "report", fuzzy=True) == [(2, 1)]


def test_snippets(spark):
    files, texts = catalog(spark, NAMES, TEXTS)
    found = search.with_snippets(search.search(files, texts, "Report", fuzzy=True), texts, "Report")
    got = {r.file_id: r.snippet for r in found.collect()}
    assert got[5].window == TEXTS[0][1] and [(r.start, r.end) for r in got[5].ranges] == [(4, 10)]
    assert [(r.start, r.end) for r in got[8].ranges] == [(4, 10)]


def test_neither_catalog_nor_bodies_are_shuffled_or_sent(spark, tmp_path):
    files, texts = catalog(spark, NAMES, TEXTS)
    files.write.parquet(str(tmp_path / "f"))
    texts.write.parquet(str(tmp_path / "t"))
    files, texts = spark.read.parquet(str(tmp_path / "f")), spark.read.parquet(str(tmp_path / "t"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    names = plan(search.hits(files, None, "report"))
    assert "Exchange" not in names
    shown = search.with_snippets(search.search(files, texts, "report", 100), texts, "report")
    lines = plan(shown).split("\n")
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "text#" in x)
    above = [x for x in lines[:scan] if "Exchange" in x and len(x) - len(x.lstrip(" :+-")) < len(lines[scan]) - len(lines[scan].lstrip(" :+-"))]
    # The bodies picked are joined with the page; their scan is met by the page's ids, sent to it.
    assert any("BroadcastHashJoin" in x and "LeftSemi, BuildRight" in x for x in lines) and len(above) <= 1
    pruned = {r.file_id for r in search.hits(files, texts, "report", grams=search.trigram_index(texts)).collect()}
    assert pruned == {r.file_id for r in search.hits(files, texts, "report").collect()}


def test_windows():
    text = "é" * 400 + "needle" + "ü" * 400
    w = cut_window(text, byte_ranges(text, re.compile("needle")), 60)
    a, b = w["ranges"][0]["start"], w["ranges"][0]["end"]
    assert w["window"].encode()[a:b] == b"needle" and w["truncated_start"] and w["truncated_end"]
    assert cut_window("abc", [])["ranges"] == [] and merge_ranges([(0, 2), (2, 3), (5, 6)]) == [(0, 3), (5, 6)]


def test_budgets():
    assert [edit_budget(n, 2) for n in (2, 3, 5, 6, 64, 65)] == [None, 1, 1, 2, 2, None] and edit_budget(5, 0) is None


def brute(p, t):
    row, best = list(range(len(p) + 1)), len(p)
    for c in t:
        new = [0]
        for i, x in enumerate(p):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_approximate_matches_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(60):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randint(3, 9)))
        m = Approximate(p, rng.randint(0, len(p) // 3))
        texts = [bytes(rng.choice(b"abcd") for _ in range(rng.choice([0, 1, 3, 8, 30]))) for _ in range(rng.choice([2, 10, 30]))]
        texts += [b"".join(rng.choice([b"dddddddddddd", p, p[:-1] + b"d", b"a"]) for _ in range(40))]
        best, count = m.many(texts)
        for t, b, c in zip(texts, best.tolist(), count.tolist()):
            want = brute(p, t)
            assert b == (want if want <= m.k else -1) and c == m.count(t)


def test_results_in_parts(spark):
    from trawl.operators.live import Search, admit

    files, texts = catalog(spark, NAMES, TEXTS)
    parts = list(Search(files, texts, "Report", options={"fuzzy": True}).parts())
    assert [r.file_id for r in parts[-1]] == list(range(1, 12)) and {r.file_id for r in parts[0]} == {1, 2, 3, 4, 7, 9, 10, 11}
    called_off = Search(files, texts, "Report")
    got = []
    for part in called_off.parts():
        got.append(part)
        called_off.cancel()
    assert len(got) == 1
    a, b = parts[0][:2], parts[-1]
    assert [r.file_id for r in admit(a, b, 3)] == [1, 2, 3] and admit([], [], 5) == []


def test_packed_bodies(spark):
    from pyspark.sql import functions as F

    from trawl.functions.packed import packed, unpacked, with_texts

    df = spark.createDataFrame([(1, "é" * 9999), (2, ""), (3, None)], "file_id long, text string").withColumn("text_zstd", packed(F.col("text")))
    assert {r.file_id: r.text for r in with_texts(df.drop("text")).collect()} == {1: "é" * 9999, 2: "", 3: None}
    broken = spark.createDataFrame([(b"no frame",), (None,)], "z binary").select(unpacked(F.col("z")))
    assert [r[0] for r in broken.collect()] == [None, None]


def test_clamped_ranges():
    from trawl.functions.kernels import clamp_range

    data = "aéé".encode()
    assert [clamp_range(data, 0, 5, n) for n in (9, 5, 4, 3, 2)] == [(0, 5), (0, 5), (0, 3), (0, 3), (0, 1)]
    assert len(cut_window("x" * 5000, [(0, 5000)], 100)["window"]) == 200
