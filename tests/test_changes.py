import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from trawl.operators.incremental import Ledger, available_intervals, changed_paths, merge, run_incremental, subtract, within
from trawl.operators.snapshots import snapshot_changes

T = lambda s: datetime.fromtimestamp(s, timezone.utc)
SNAPS = "snap_no int, path string, size long, mtime long, loaded_at timestamp, change_kind string"


def changes(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SNAPS)
    return sorted((r.snap_no, r.path, r.change_kind) for r in snapshot_changes(df).collect())


def test_snapshot_changes(spark):
    rows = [
        (1, "a", 1, 1, T(1)), (1, "b", 1, None, T(1)), (1, "c", 5, 5, T(1)), (1, "d", None, None, T(1)),
        (3, "a", 1, 1, T(2)), (3, "a", 1, 1, T(2)), (3, "b", None, 1, T(2)), (3, "e", 1, 1, T(2)), (3, "d", None, None, T(2)),
        (4, "a", 9, 9, T(3)), (4, "a", 1, 1, T(9)), (4, "b", None, 1, None), (4, "e", 2, 1, T(3)), (4, None, 1, 1, T(3)),
        (None, "z", 1, 1, T(3)),
    ]
    assert changes(spark, rows) == [
        (3, "b", "changed"), (3, "c", "removed"), (3, "e", "added"), (4, "d", "removed"), (4, "e", "changed"),
    ]


def test_snapshots_empty_and_single(spark):
    assert changes(spark, []) == [] and changes(spark, [(1, "a", 1, 1, T(1))]) == []


def test_hot_key(spark):
    rows = [(1, "a", i, i, T(i)) for i in range(300)] + [(2, "a", 299, 299, T(1))] + [(2, "b", 1, 1, T(1))]
    assert changes(spark, rows) == [(2, "b", "added")]


def test_intervals():
    assert merge([(5, 6), (1, 2), (3, 4), (9, 8)]) == [(1, 6)]
    assert subtract([(1, 10)], [(2, 3), (5, 5), (9, 20)]) == [(1, 1), (4, 4), (6, 8)]
    assert subtract([(1, 3)], []) == [(1, 3)] and subtract([], [(1, 2)]) == []


def test_intervals_against_sets():
    import random

    rng = random.Random(1)
    pick = lambda: [(a, a + rng.randint(0, 5)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 6)))]
    full = lambda xs: {n for a, b in xs for n in range(a, b + 1)}
    for _ in range(200):
        x, y = pick(), pick()
        assert full(subtract(x, y)) == full(x) - full(y) and full(merge(x)) == full(x)


def test_runs_survive_failure_and_take_in_late_numbers(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    batch = lambda nums: spark.createDataFrame([(n, n * 10) for n in nums], "seq int, v int")
    run_incremental(batch([1, 2, 5]), "seq", ledger, lambda d, gaps: d)
    assert ledger.read().intervals == [(1, 2), (5, 5)]

    def dies(d, gaps):
        d.write.parquet(str(tmp_path / "half"))
        raise OSError("executor lost")

    with pytest.raises(OSError):
        run_incremental(batch([1, 2, 3, 5, 6]), "seq", ledger, dies)
    assert ledger.read().intervals == [(1, 2), (5, 5)]
    run_incremental(batch([1, 2, 3, 5, 6]), "seq", ledger, lambda d, gaps: d)
    state = run_incremental(batch([1, 2, 3, 5, 6]), "seq", ledger, lambda d, gaps: d)
    assert state.version == 2 and sorted(r.seq for r in ledger.output().collect()) == [1, 2, 3, 5, 6]
    stale = ledger.read()
    ledger.commit(stale, [(9, 9)], state.outputs[0])
    with pytest.raises(RuntimeError):
        ledger.commit(stale, [(9, 9)], state.outputs[0])


def test_many_gaps(spark):
    rng = random.Random(12)
    have = sorted(rng.sample(range(5000), 3000))
    df = spark.createDataFrame([(n,) for n in [*have, None]], "n long")
    gaps = merge((n, n) for n in rng.sample(range(-5, 5005), 180))
    want = sorted(n for n in have if any(a <= n <= b for a, b in gaps))
    for inline in (10, 200):
        assert sorted(r.n for r in df.filter(within(F.col("n"), gaps, inline)).collect()) == want
    assert df.filter(within(F.col("n"), [])).count() == 0


def test_changed_paths_of_one_ledger(spark, tmp_path):
    d, base = spark.createDataFrame, str(tmp_path / "ledger")
    files, runs = d([("a", 1, 1, 1, "x"), ("b", 1, 1, 1, "x")], FILES), d([(1, "ok", 2)], RUNS)
    first = [(1, 2, "a", 9, 9, T(1)), (2, 3, "a", 2, 1, T(2)), (3, 5, "b", 2, 1, T(2))]
    run = lambda reads: sorted(r.path for r in changed_paths(files, d(reads, READS), runs, base).collect())
    assert run(first) == ["a", "b"] and run(first) == []
    assert Ledger(spark, base).read().intervals == [(-(2**62), 3), (5, 5)]
    # Batch 4 comes late, and lies in a gap.
    assert run([*first, (4, 4, "b", 3, 1, T(3)), (5, 4, "c", 3, 1, T(3)), (6, 4, "a", 3, 1, T(1))]) == ["b", "c"]
    assert Ledger(spark, base).read().intervals == [(-(2**62), 5)]


def test_available(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 2, 4, None, (1 << 20) - 1, 1 << 20)], "n long")
    assert available_intervals(df, "n") == [(1, 2), (4, 4), ((1 << 20) - 1, 1 << 20)]


FILES = "path string, mtime long, size long, content_state int, seen_at string"
READS = "rec_id long, batch_no int, path string, mtime long, size long, seen_at timestamp"
RUNS = "run_no int, status string, last_batch int"


def found(spark, files, reads, runs):
    d = spark.createDataFrame
    return sorted(r.path for r in changed_paths(d([(*f, "x") for f in files], FILES), d(reads, READS), d(runs, RUNS)).collect())


def test_changed_paths(spark):
    files = [("same", 1, 1, 1), ("pending", 1, 1, 0), ("moved", 1, 1, 1), ("size", 1, 1, 1), ("back", 1, 1, 1), (None, 1, 1, 0), ("nul", None, 1, 1)]
    reads = [
        (1, 5, "same", 1, 1, T(9)), (2, 5, "moved", 2, 1, T(9)), (3, 5, "size", 1, None, T(9)), (4, 5, "new", 1, 1, T(9)),
        (5, 5, "back", 2, 1, T(5)), (6, 2, "back", 1, 1, T(8)), (7, 5, "gone", None, None, T(9)), (8, 2, "old", 1, 1, T(9)),
        (9, 5, None, 1, 1, T(9)), (10, 5, "nul", 1, 1, T(1)), (11, 5, "pending", 7, 7, T(1)), (4, 5, "new", 1, 1, T(9)),
    ]
    runs = [(1, "ok", 2), (2, "ok", 3), (3, "failed", 5), (4, None, 5)]
    assert found(spark, files, reads, runs) == ["moved", "new", "nul", "pending", "size"]
    assert "old" in found(spark, files, reads, [(1, "failed", 9)])
    assert found(spark, files, [], runs) == ["pending"] and found(spark, [], [], []) == []
