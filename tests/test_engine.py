import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from trawl.catalog import Catalog, CatalogDrift, Change
from trawl.commits import Folder, Taken
from trawl.engine import Engine
from trawl.functions import format as fmt
from trawl.model import Config
from trawl.query.highlight import classify


def test_engine(spark, tmp_path):
    tree = tmp_path / "t"
    tree.mkdir()
    for n in ("a.txt", "b.md", "c.log"):
        (tree / n).write_text(f"body of {n}")
    config = Config(roots=(str(tree),))
    e = Engine(spark, str(tmp_path / "cat"), config)
    assert e.due() and e.reindex(now=5)["insert"] == 3
    rows, outcome = e.search("body")
    assert len(rows) == 3 and not outcome.limited
    os.remove(tree / "a.txt")
    (tree / "d.txt").write_text("new one")
    os.utime(tree / "b.md", (9, 9))
    assert e.refresh([str(tree / n) for n in ("a.txt", "b.md", "d.txt")] + ["/elsewhere"]) == 3
    got = {r.name: (r.mtime if r.name == "b.md" else 0, r.content_state) for r in e.catalog.table("files").collect()}
    assert got == {"b.md": (9, 1), "c.log": (0, 1), "d.txt": (0, 1)}
    assert sorted(r.text for r in e.catalog.table("documents_text").collect()) == ["body of b.md", "body of c.log", "new one"]
    assert len(e.catalog._read()["tables"]["files"]) == 2  # a change beside the whole
    assert e.apply_config(Config(roots=(str(tree),), ignore=(*config.ignore, "*.log"))).prune_scope
    s = e.state()
    assert s.files == 2 and s.pending == 0 and s.roots == {str(tree): (2, 2)} and s.last_run == 5
    assert Engine(spark, str(tmp_path / "cat")).config.ignore == e.config.ignore
    assert e.apply_config(Config(hash_length=1)).rebuild and e.config.hash_length != 1
    e.forget(str(tree / "d.txt"))
    assert e.state().files == 1
    assert e.rebuild(now=6)["insert"] == 2
    e.clear()
    assert e.state().files == 0 and not e.due()


def test_events_reach_the_catalog(spark, tmp_path):
    tree, box = tmp_path / "t", tmp_path / "in"
    (tree / "old").mkdir(parents=True)
    box.mkdir()
    for n in ("a.txt", "old/b.txt", "old/c.txt"):
        (tree / n).write_text(f"body of {n}")
    e = Engine(spark, str(tmp_path / "cat"), Config(roots=(str(tree),)))
    e.reindex(now=5)
    (tree / "new" / "deep").mkdir(parents=True)
    (tree / "new" / "deep" / "n.txt").write_text("fresh words")
    (tree / "new" / ".hidden.txt").write_text("not seen")
    for n in ("old/b.txt", "old/c.txt"):
        os.remove(tree / n)
    os.rmdir(tree / "old")
    (tree / "a.txt").write_text("other words")
    os.utime(tree / "a.txt", (77, 77))
    line = '{"seq":%d,"ts":"2026-01-01T00:00:0%dZ","op":"%s","path":"%s"}\n'
    events = [("create", tree / "new"), ("remove", tree / "old"), ("modify", tree / "a.txt"), ("modify", tree / "gone.txt"), ("create", "/elsewhere/x")]
    (box / "1.json").write_text("".join(line % (i, i, op, p) for i, (op, p) in enumerate(events)))
    from trawl.streaming.events import read_events

    stream = read_events(spark, str(box))
    e.watch(stream, str(tmp_path / "state"), once=True).awaitTermination()
    have = lambda: {r.path[len(str(tree)) + 1 :]: r.text for r in e.catalog.table("files").join(e.catalog.table("documents_text").withColumnRenamed("file_id", "id"), "id").collect()}
    assert have() == {"a.txt": "other words", "new/deep/n.txt": "fresh words"} and e.state().files == 2
    epoch = e.catalog.epoch
    e.watch(stream, str(tmp_path / "again"), once=True).awaitTermination()  # batch 0 once more
    assert e.catalog.epoch == epoch and have() == {"a.txt": "other words", "new/deep/n.txt": "fresh words"}
    assert e.search("fresh")[0][0].name == "n.txt"


def test_settings_leave_what_is_due(spark, tmp_path):
    tree = tmp_path / "t"
    tree.mkdir()
    (tree / "a.txt").write_text("x")
    (tree / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    e = Engine(spark, str(tmp_path / "cat"), Config(roots=(str(tree),), content_extensions=("md",)))
    e.reindex(now=5)
    assert not e.outstanding() and e.catalog.meta()["root." + str(tree)] == "2 0"
    assert e.apply_config(Config(roots=(str(tree),))).reindex
    states = {r.name: r.content_state for r in e.catalog.table("files").collect()}
    assert states == {"a.txt": 0, "p.png": 3} and e.outstanding() and Engine(spark, str(tmp_path / "cat")).due(6)
    e.reindex(now=6)
    assert not e.outstanding() and e.state().pending == 0
    with pytest.raises(ValueError):
        e.set_mode("often")


def test_another_version_is_not_emptied_unasked(spark, tmp_path):
    base = tmp_path / "cat"
    base.mkdir()
    (base / "commit-1.json").write_text('{"version": "0", "tables": {}}')
    with pytest.raises(CatalogDrift):
        Engine(spark, str(base))
    assert Engine(spark, str(base), renew=True).state().files == 0


def test_one_of_many_writers_succeeds(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "c"))
    folder.make()

    def write(i: int) -> str:
        try:
            folder.publish(1, str(i))
            return str(i)
        except Taken:
            return ""

    with ThreadPoolExecutor(16) as pool:
        won = [x for x in pool.map(write, range(64)) if x]
    assert len(won) == 1 and folder.read(1) == won[0] and folder.numbers() == [1]
    assert not [n for n in folder.names() if n.startswith(".draft")]


def test_changes_over_a_table(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    rows = lambda xs: spark.createDataFrame(xs, "file_id long, text string")
    keys = lambda xs: spark.createDataFrame([(x,) for x in xs], "file_id long")
    c.commit({"documents_text": rows([(1, "a"), (2, "b"), (3, "c")])}, c.epoch)
    c.commit({"documents_text": Change(rows([(2, "B"), (9, "z")]), keys([2, 3]))}, c.epoch)
    c.commit({"documents_text": Change(rows([]), keys([9]))}, c.epoch)
    want = {1: "a", 2: "B"}
    assert {r.file_id: r.text for r in c.table("documents_text").collect()} == want
    assert c.merge(slack=5) is None and c.merge(slack=1) == c.epoch
    c.compact(1)
    assert {r.file_id: r.text for r in c.table("documents_text").collect()} == want


def test_walk_is_many_tasks_below_one_folder(spark, tmp_path):
    from trawl.sources.scan import _TreeReader, tree_scan

    for i in range(20):
        (tmp_path / "r" / "only" / f"d{i}").mkdir(parents=True)
        (tmp_path / "r" / "only" / f"d{i}" / "f.txt").write_text("x")
    (tmp_path / "r" / "only" / "d0" / "up").symlink_to(tmp_path / "r")
    for follow in (False, True):
        found, _ = tree_scan(spark, Config(roots=(str(tmp_path / "r"),), follow_symlinks=follow))
        assert found.count() == 20
    import json

    parts = _TreeReader({"roots": json.dumps([str(tmp_path / "r")]), "tasks": "16"}).partitions()
    assert len(parts) >= 16 and max(len(p.paths) for p in parts) <= 2


def test_highlight(spark):
    text = 'é type:text x modified:>=nope regex:"(" 12:30'
    got = classify(text)
    assert [s.start for s in got[1:]] == [s.end for s in got[:-1]] and got[-1].end == len(text.encode())
    data = text.encode()
    assert [(data[s.start : s.end].decode(), s.kind) for s in got if s.kind != "plain"] == [
        ("type", "keyword"), (":", "operator"), ("text", "argument"), ("modified", "keyword"), (":>=", "operator"),
        ("nope", "invalid"), ("regex", "keyword"), (":", "operator"), ('"("', "invalid"),
    ]


def test_formats():
    assert [fmt.human_size(n) for n in (-1, 999, 1000, 1_500_000)] == ["0 B", "999 B", "1.0 KB", "1.5 MB"]
    assert fmt.group_thousands(1234567) == "1 234 567" and fmt.clock(59) == "0:59" and fmt.clock(3661) == "1:01:01"
    assert fmt.ago(0, 7200) == "2 hours ago" and fmt.ago(5, 0) == "just now" and fmt.rate(3, 0) == "-" and fmt.rate(3, 2) == "1.5/s"
    assert fmt.shorten_middle("abcdefgh", 5) == "ab…gh" and fmt.shorten_middle("abc", 5) == "abc" and fmt.shorten_middle("abc", 1) == "…"
    assert fmt.ignore_patterns("/x/a.log") == ["*.log", "a.log", "/x/*"] and fmt.when(0) == "1970-01-01 00:00"
