import math
import random
import unicodedata

import numpy as np
import pandas as pd
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trawl.llm import leaks, lookalikes, mixing, mojibake, residue, survivors

FILES = "id long, name string, path string, size long, mtime long, mime string, content_state int, hash binary, root string, trust string"


# 1 --------------------------------------------------------------------------------


def keep(spark, files, roots, last="100"):
    f = spark.createDataFrame([(i, p.rsplit("/", 1)[-1], p, s, m, mi, st, h, "clash", "clash") for i, p, s, m, mi, st, h in files], FILES)
    r = spark.createDataFrame(roots, "root string, trust int")
    meta = spark.createDataFrame([("last_full_index", last)], "key string, value string")
    return {x.hash_hex: x for x in survivors.surviving_files(f, r, meta).collect()}


def test_survivor_order(spark):
    h, g, k = b"\1" * 4, b"\2" * 4, b"\3" * 4
    roots = [("/a", 5), ("/a/b", 0), ("/c", None)]
    rows = [
        (1, "/c/x", 1, 50, "t", 1, h), (2, "/ab/x", 1, 90, "t", 1, h), (3, "/c/y", 1, 50, "t", 1, h), (4, "/a/z", 1, 99, None, 1, h),
        (5, "/a/b/q", 1, 10, "t", 0, g), (6, "/a/q", 1, 101, None, 1, g), (7, "/a/r", 1, 9, None, 1, g), (8, "/a/s", 1, -1, "t", 9, g),
        (9, "/a/x", 1, 5, "t", 1, k), (10, "/a/x2", 0, 5, "t", 1, b"\4"), (11, "/a/x3", 0, 5, "t", 1, b"\4"), (12, "/n", 1, 1, None, None, None),
        (13, "/n2", 1, 1, None, None, None), (None, "/n3", 1, 1, "t", 1, k),
    ]
    got = keep(spark, rows, roots)
    assert {x: r.keep_id for x, r in got.items()} == {"01010101": 1, "02020202": 7}
    assert got["02020202"].newest_mtime == 10


def test_survivors_of_nothing(spark):
    assert keep(spark, [], []) == {}


def test_quality_tells_good_sources_from_bad(spark):
    rng = random.Random(2)
    rows = []
    for e in range(300):
        for s, right in (("good", 0.95), ("also", 0.9), ("fair", 0.75), ("bad", 0.3)):
            rows.append((f"e{e}", s, "true" if rng.random() < right else f"wrong{rng.randint(0, 2)}"))
    df = spark.createDataFrame(rows, "e string, s string, v string")
    claims = survivors.claims_of(df, "e", "s", "v")
    q = survivors.fit_quality(claims)
    sens, spec = ({s: x for (_, s), x in of.items()} for of in (q.sensitivity, q.specificity))
    assert min(sens[s] for s in ("good", "also")) > sens["fair"] > sens["bad"]
    assert spec["good"] > spec["fair"] > spec["bad"]
    best = [r for r in survivors.true_values(claims, q).collect() if r.best]
    assert len(best) == 300 and sum(r.v == "true" for r in best) > 285


def em_by_hand(claims, rounds=12):
    """The same model, claim by claim."""
    sources = sorted({s for _, _, pattern in claims for s, _ in pattern})
    sens, spec, prior = dict.fromkeys(sources, 0.7), dict.fromkeys(sources, 0.9), 0.5
    judge = lambda pattern: 1 / (1 + (1 - prior) / prior * math.prod((1 - spec[s]) / sens[s] if said else spec[s] / (1 - sens[s]) for s, said in pattern))
    for _ in range(rounds):
        t = [judge(p) for _, _, p in claims]
        at = {s: [(x, said) for x, (_, _, p) in zip(t, claims) for z, said in p if z == s] for s in sources}
        new = {s: (sum(x for x, said in at[s] if said) + 10) / (sum(x for x, _ in at[s]) + 20) for s in sources}
        spec2 = {s: (sum(1 - x for x, said in at[s] if not said) + 90) / (sum(1 - x for x, _ in at[s]) + 100) for s in sources}
        moved = max(max(abs(new[s] - sens[s]), abs(spec2[s] - spec[s])) for s in sources)
        sens, spec, prior = new, spec2, (sum(t) + 10) / (len(t) + 20)
        if moved < 1e-3:
            break
    return sens, spec, {(e, v) for e, v, p in claims if judge(p) >= 0.5}


def planted(rng, n):
    """Contents with two true names and one true type each, in four roots of different quality."""
    quality = {"/a": (0.95, 0.02), "/b": (0.9, 0.05), "/c": (0.8, 0.1), "/d": (0.5, 0.6)}
    rows, truth = [], {}
    for e in range(n):
        h = e.to_bytes(4, "big")
        truth[h.hex()] = {f"n{e}", f"alias{e}"}
        for root, (says, wrong) in quality.items():
            told = [v for v in (f"n{e}", f"alias{e}") if rng.random() < says] + ([f"bad{rng.random()}"] if rng.random() < wrong else [])
            for name in told or [f"bad{rng.random()}"]:
                kind = "text/x" if rng.random() < says else f"odd/{rng.randint(0, 3)}"
                rows.append((len(rows), f"{root}/{name}", 1, 50, kind, 1, h))
    return rows, truth


def test_fused_values_on_planted_truth(spark):
    rows, truth = planted(random.Random(11), 250)
    f = spark.createDataFrame([(i, p.rsplit("/", 1)[-1], p, s, m, mi, st, h, "clash", "clash") for i, p, s, m, mi, st, h in rows], FILES)
    roots = spark.createDataFrame([(r, 1) for r in ("/a", "/b", "/c", "/d")], "root string, trust int")
    meta = spark.createDataFrame([("last_full_index", "100")], "key string, value string")
    got = survivors.fused_values(f, roots, meta).collect()
    names = {}
    for r in got:
        if r.field == "name":
            names.setdefault(r.hash_hex, set()).add(r.value)
    said = {(r.hash_hex, v) for r in got for v in ()} | {(h, v) for h, vs in names.items() for v in vs}
    want = {(h, v) for h, vs in truth.items() for v in vs if any(x[6].hex() == h and x[1].endswith("/" + v) for x in rows)}
    assert len(said & want) / len(want) > 0.9 and len(said & want) / len(said) > 0.9
    assert sum(len(v) > 1 for v in names.values()) > 180  # several true values are kept
    kinds = [r.value for r in got if r.field == "mime" and r.best]
    assert kinds.count("text/x") / len(kinds) > 0.97
    built = {r.hash_hex: r for r in survivors.fused_files(f, roots, meta).collect()}
    assert len(built) == len(truth) and sum(r.name in truth[h] for h, r in built.items()) / len(built) > 0.97
    # The same as by hand, claim by claim.
    covered, told = {}, {}
    for _, p, _, _, _, _, h in rows:
        covered.setdefault(h.hex(), set()).add(p[:2])
        told.setdefault((h.hex(), p[3:]), set()).add(p[:2])
    claims = [(e, v, [(s, s in said_) for s in sorted(covered[e])]) for (e, v), said_ in sorted(told.items())]
    _, _, true = em_by_hand(claims)
    best = {h for h in names if not any(e == h for e, _ in true)}
    assert {x for x in said if x[0] not in best} == true


def test_roots_of_paths(spark):
    paths = ["x", "x/y", "/a", "/a/b", "/a//b", "", "/ab/c", "/a/b/c", None, "a/b/"]
    listed = ["x", "/a", "/a/", "", "/a/b", "a", "a/b", None]
    f = spark.createDataFrame([(p,) for p in paths], "path string")
    for n in (len(listed), 400):  # however many there are
        roots = spark.createDataFrame([(r, i) for i, r in enumerate(listed)] + [(f"/none{i}", i) for i in range(n)], "root string, trust int")
        got = {r.path: r.root for r in survivors.with_root(f, roots).collect()}
        fits = lambda p: max((r for r in listed if r is not None and p.startswith(r + "/")), key=len, default=None)
        assert got == {p: None if p is None else fits(p) for p in paths}


# 3 --------------------------------------------------------------------------------


def test_one_form():
    t = lookalikes.transducer()
    for a, b in (
        ("résumé", "résumé"), ("ﾀﾞ", "ダ"), ("Ｃａｆé", "Café"), ("асе", "ace"), ("buﬀer", "buffer"), ("a​b﻿", "ab"),
        ("x y　z", "x y z"), ("a‑b", "a-b"), ("ё", "ë"), ("e͏́", "é"),
    ):
        assert t(a) == t(b) == unicodedata.normalize("NFC", b), (a, b)
    for a, b in (("l", "1"), ("O", "0"), ("rn", "m"), ("A", "a"), ("e", "é"), ("²", "2"), ("к", "k"), ("ł", "l")):
        assert t(a) != t(b)
    for s in ("", "plain", "a\ń", "́a", "\U0001f600"):
        assert t(t(s)) == t(s)


def test_conflicts_are_found():
    for rules in ([("é", "e"), ("é", "a")], [("é", "è"), ("è", "e")], [("l", "1")], [("", "e")], [("ab\u0307", "c\u0307"), ("c\u0307", "d")]):
        with pytest.raises(lookalikes.MappingConflict):
            lookalikes.Trie(rules)


def test_the_longest_rule_is_applied():
    rules = [("é", "e"), ("éè", "x"), ("éèü", "yz"), ("aü", "ä")]
    t = lookalikes.Trie(rules)
    brute = lambda s: s if not s else next((v + brute(s[len(k):]) for k, v in sorted(rules, key=lambda r: -len(r[0])) if s.startswith(k)), s[0] + brute(s[1:]))
    rng = random.Random(3)
    for _ in range(500):
        s = "".join(rng.choice("éèüab") for _ in range(rng.randint(0, 9)))
        assert t.rewrite(s) == brute(s)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeiсоِ́̈각각ｶﾞ​\u200d")), max_size=12))
def test_one_form_is_idempotent(s):
    t = lookalikes.transducer()
    assert t(t(s)) == t(s) == t(unicodedata.normalize("NFC", s))


def test_same_looking(spark):
    rows = [(1, "a/é", 0), (2, "a/é", 0), (3, "a/ｅ́", 0), (4, "a/e", 0), (5, None, 0), (None, "a/é", 0), (6, "a/é", 0), (7, "x" * 20000 + "​", 0), (8, "x" * 20000, 0), (9, "", 0)]
    got = lookalikes.same_looking(spark.createDataFrame(rows, "id long, path string, form int"))
    assert sorted(map(tuple, got.collect())) == [(1, 2), (1, 3), (2, 3), (2, 6), (3, 6), (7, 8)]
    assert lookalikes.same_looking(spark.createDataFrame([], "id long, path string")).count() == 0
    classes = lookalikes.look_classes(spark.createDataFrame(rows, "id long, path string, form int"))
    links = {i: sum(i in p for p in [(1, 2), (1, 3), (2, 3), (2, 6), (3, 6), (7, 8)]) for i in (1, 2, 3, 6, 7, 8)}
    assert {r.id: (r.class_id, r.links) for r in classes.collect()} == {i: (7 if i > 6 else 1, n) for i, n in links.items()}


# 4 --------------------------------------------------------------------------------

WORDS = "La búsqueda rápida contó los años perdidos según el informe; der Zähler für Lücken prüft die Größe; Каждая папка хранит три версии; le répertoire partagé relève l'écart".split()


def corpus(rng, n):
    return [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(n)]


@pytest.mark.parametrize("read_as, was", [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1251", "utf-8"), ("cp437", "utf-8"), ("mac-roman", "utf-8")])
def test_damage_is_undone(read_as, was):
    for text in ("Größe für años", "Каждая папка"):
        hurt = mojibake.damage(text, read_as, was)
        assert hurt != text and mojibake.undo(hurt, read_as, was) == text


def test_repair(spark):
    rng = random.Random(4)
    clean = corpus(rng, 800)
    rows = [(i, t) for i, t in enumerate(clean)]
    bad = {
        2000: mojibake.damage("la búsqueda rápida", "cp1252", "utf-8"),
        2001: mojibake.damage(mojibake.damage("los años perdidos", "cp1252", "utf-8"), "cp1252", "utf-8"),
        2002: mojibake.damage("Каждая папка хранит три версии", "latin-1", "cp1251"),
        2003: "le r�pertoire",
        2004: "plain words and one rÃ©pertoire only",
    }
    fine = {3000: "┌───┐ │ a │ └───┘", 3001: "12 € ± ½ ©", 3002: "Ångström Þorn", 3003: "", 3004: None, 3005: "ascii only"}
    df = spark.createDataFrame([(i, t, 1) for i, t in [*rows, *bad.items(), *fine.items(), (None, "é")]], "file_id long, text string, damaged int")
    got = {r.file_id: r.restored for r in mojibake.repaired(df).collect()}
    assert set(got) == set(bad)
    assert got[2000] == "la búsqueda rápida" and got[2001] == "los años perdidos" and got[2002] == "Каждая папка хранит три версии"
    assert got[2004] == "plain words and one répertoire only"
    assert mojibake.damaged_files(spark.createDataFrame([], "file_id long, text string")).count() == 0
    # The same from packed bodies; a body without a frame is read from its text, a broken frame is none.
    pack = zstandard.ZstdCompressor().compress
    rows = [(r.file_id, None if r.text and r.file_id not in (2001, 2003) else r.text, pack(r.text.encode()) if r.text and r.file_id not in (2001, 2003) else None) for r in df.collect()]
    rows += [(4000, bad[2000], b"no frame"), (4001, None, None), (4002, None, pack(b"\xff\xfe")), (4003, "ignored Ã©", pack("fine é".encode()))]
    packed = spark.createDataFrame(rows, "file_id long, text string, text_zstd binary")
    assert {r.file_id: r.restored for r in mojibake.repaired(packed).collect()} == got


def test_every_chain_has_a_way_back():
    """Whatever was read as whatever is undone, if the reading lost nothing."""
    texts = {"cp1251": "Каждая папка", "cp866": "Каждая папка", "koi8-r": "Каждая папка", "iso8859-7": "αρχείο και", "cp1253": "αρχείο και", "euc-jp": "索引の文書", "cp932": "索引の文書", "gbk": "检查索引"}
    tried = 0
    for read_as, was in mojibake._PRICES:
        text = texts.get(was, "déjà müde ñ" if was in ("utf-8", "cp1252", "cp437", "cp850", "mac-roman") else "łódź żółw")
        raw = text.encode(was, "ignore")
        try:
            hurt = raw.decode(read_as) if read_as in mojibake._WIDE else mojibake.damage(raw.decode(was), read_as, was)
        except UnicodeDecodeError:
            continue
        if hurt is None or hurt == raw.decode(was) or (read_as in mojibake._WIDE and hurt.encode(read_as) != raw):
            continue
        tried += 1
        assert mojibake.undo(hurt, read_as, was) == raw.decode(was), (read_as, was)
    assert tried > 200 and set(mojibake._PRICES) == {(r, w) for r in mojibake.READ_AS for w in mojibake.WERE if r != w}


def test_slots_of_one_and_many_pairs():
    rng = random.Random(7)
    a, b = ([rng.randint(0, 0x10FFFF) for _ in range(200)] for _ in range(2))
    many = mojibake.pair_slots(np.array(a, np.uint32), np.array(b, np.uint32)).tolist()
    assert many == [mojibake.pair_slot(x, y) for x, y in zip(a, b)] and max(many) < 1 << mojibake.BITS


def test_margins_come_from_bodies_left_out(spark):
    rows = mojibake.bodies(spark.createDataFrame(list(enumerate(corpus(random.Random(41), 500))), "file_id long, text string"), "file_id", "text", "text_zstd")
    every = mojibake.count_pairs(rows)[2]
    _, _, records, margin, utf8 = mojibake.train(rows)
    assert 0.8 * every < records < every and 7 <= margin <= 16 and 3 <= utf8 <= 12
    assert mojibake.train(rows, held_out=5)[2] == every - 5


def test_every_body_counts_and_sets_the_margins(spark, monkeypatch):
    rng = random.Random(43)
    # More words of one script than any share of them would hold, each in one body.
    texts = [f"{t} {''.join(rng.choice('aeiouñé') for _ in range(6))}ñ{i}" for i, t in enumerate(corpus(rng, 400))]
    df = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    rows = mojibake.bodies(df, "file_id", "text", "text_zstd")
    every = mojibake.count_pairs(rows)
    counted, tallies, count, choose = [], [], mojibake.count_pairs, mojibake.chosen_margins
    monkeypatch.setattr(mojibake, "count_pairs", lambda rows: counted.append(count(rows)) or counted[-1])
    monkeypatch.setattr(mojibake, "chosen_margins", lambda tally: tallies.append(tally) or choose(tally))
    mojibake.repaired(df).collect()
    assert sum(c[2] for c in counted) == every[2] == 400
    pairs, singles = (sum(c[k] for c in counted) for k in (0, 1))
    singles[32] = every[1][32]  # spaces between batches
    assert (pairs == every[0]).all() and (singles == every[1]).all()
    # Every different token of either half is judged once a margin, whatever it is.
    halves = [{w for r in rows.filter(F.pmod("h", F.lit(2)) == k).collect() for w in r.t.split() if not w.isascii()} for k in (0, 1)]
    assert len(halves[0] | halves[1]) > 400
    n = tallies[0].groupby(["utf8", "at"])["n"].sum()
    assert set(n) == {sum(map(len, halves))} and len(n) == sum(map(len, mojibake.GRIDS.values()))


def test_margins_are_the_first_of_the_fewest_wrong():
    def tally(script, utf8, n, changed_below, missed_from, missed):
        at = range(len(mojibake.GRIDS[utf8]))
        return pd.DataFrame({"script": script, "utf8": utf8, "at": at, "n": n, "changed": [int(k < changed_below) for k in at], "missed": [missed * (k >= missed_from) for k in at]})

    # 20 misses weigh as a changed token; a script of 1000 tokens weighs as one of 100.
    both = [tally(0, False, 50, 6, 3, 10_000_000), tally(0, True, 50, 6, 3, 30_000_000)]
    assert mojibake.chosen_margins(pd.concat(both)) == (10.0, 3.0)
    assert mojibake.chosen_margins(pd.concat([*both, tally(2, False, 1000, 0, 4, 90_000_000), tally(2, True, 1000, 0, 0, 1)])) == (10.0, 3.0)
    assert mojibake.chosen_margins(pd.concat([*both, tally(2, False, 100, 0, 4, 90_000_000), tally(2, True, 1000, 8, 0, 0)])) == (7.0, 3.0)


def test_the_shortcut_over_the_way_back_changes_no_judgement():
    texts = corpus(random.Random(47), 300)
    c = mojibake.codes(" " + " ".join(texts) + " ")
    pairs, singles = np.bincount(mojibake.pair_slots(c[:-1], c[1:]), minlength=1 << mojibake.BITS), np.bincount(c, minlength=0x110000)
    probe = mojibake.Fixer(pairs, singles, 300, float("inf"), float("inf"))
    for utf8, grid in mojibake.GRIDS.items():
        for chain in mojibake._DAMAGES[utf8]:
            for t in ("años", "Größe", "папка", "é—", "prüft"):
                d = mojibake.damage(t, *chain)
                if d not in (None, t):
                    assert ((probe.found(d, t, chain, grid[-1]) >= grid) == (probe.best(d, utf8) >= grid)).all(), (t, chain)


# 6 --------------------------------------------------------------------------------


def sentence(rng, n):
    return [f"{rng.choice('bcdfgkl')}{rng.choice('aeiou')}{rng.choice('mnprst')}{rng.randint(0, 60)}" for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(6)
    line = "Answer with the letter of the best option."
    items = [(i, sentence(rng, 60)) for i in range(30)]
    table = spark.createDataFrame([(i, " ".join(w).capitalize() + ". " + line) for i, w in items], "item_id long, text string")
    pad = lambda: " ".join(sentence(rng, 40))
    w = items[0][1]
    part = w[10:40]
    swapped = [x if k % 9 != 4 else "other" for k, x in enumerate(part)]
    noted = [x + ("[3]" if k % 11 == 5 else "") for k, x in enumerate(part)]
    docs = {
        1: pad() + " " + " ".join(part) + " " + pad(), 2: " ".join(swapped).upper(), 3: pad() + "\n> " + "\n> ".join(part),
        4: "<p>" + " <b>".join(part) + "</b></p>", 5: " ".join(x[:2] + "​" + x[2:] for x in part), 6: " ".join(noted),
        7: " ".join(f"{x[:2]}-\n{x[2:]}" if k % 6 == 0 else x for k, x in enumerate(part)), 8: " ".join(w[:12]), 9: " ".join(sorted(part)),
        10: line + " " + pad(), 11: "", 12: None, 13: " ".join(part) + " " + pad() + " " + " ".join(items[1][1][:20]), 14: pad() * 200 + " " + " ".join(part),
    }
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs.items()], "doc_id long, text string, item_id string")
    got = sorted(map(tuple, leaks.leaked_items(df, table).collect()))
    assert got == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0), (13, 0), (13, 1), (14, 0)]
    small = sorted(map(tuple, leaks.leaked_items(df, table, block_chars=900).collect()))
    assert small == got
    clean = {r.doc_id: r.text for r in leaks.without_leaks(df, table).collect()}
    assert len(clean) == len(docs) and part[3] not in clean[1] and clean[8] == docs[8] and clean[12] is None
    assert leaks.without_leaks(df, table, whole=True).count() == 5
    assert leaks.leaked_items(df, table.limit(0)).count() == 0 and leaks.leaked_items(df.limit(0), table).count() == 0


def test_shared_passages_are_not_instructions(spark):
    rng = random.Random(66)
    copy, reading = " ".join(sentence(rng, 10)) + ". " + " ".join(sentence(rng, 12)) + ".", " ".join(sentence(rng, 40)) + "."
    asked = [" ".join(sentence(rng, 20)) for _ in range(9)]
    items = [(i, copy) for i in range(9)] + [(10 + i, f"{reading} {q}. Pick one.") for i, q in enumerate(asked)]
    items += [(20 + i, f"{' '.join(sentence(rng, 20))}.\nNo") for i in range(9)]
    items.append((30, " ".join(f"No{w}" for w in sentence(rng, 20)) + "."))
    docs = spark.createDataFrame([(1, copy), (2, reading), (3, asked[0] + ". Pick one."), (4, items[-1][1])], "doc_id long, text string")
    got = leaks.leaked_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [*((1, i) for i in range(9)), *((2, 10 + i) for i in range(9)), (3, 10), (4, 30)]


BITS = ["exam", "ple", "-", "‐", "\xad", "\r\n", "\n", "  ", "\r", "> ", "<b>", "</b>", "<br/>", "<p class=x>", "é", "e\u0301", "Σ", "ς", "İ", "ﬁ", "한", "\u200b", "_", "7", "<", "."]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(BITS), st.text(max_size=3)), max_size=14).map("".join))
def test_words_and_their_places_agree(text):
    found, start, end = leaks.words_at(text)
    assert found == leaks.words(text)
    assert all(0 <= a < b <= len(text) for a, b in zip(start, end)) and start == sorted(start)


@pytest.mark.parametrize("brk", ["-\r\n", "-  \n", "- \r\n> ", "\xad\n", "‑\n"])
def test_cuts_hit_the_right_words(spark, brk):
    rng = random.Random(61)
    w = sentence(rng, 30)
    text = f"exam{brk}ple first words head one {' '.join(w[:14])} {w[14][:2]}{brk}{w[14][2:]} {' '.join(w[15:])} tail of it exam{brk}ple"
    docs = spark.createDataFrame([(1, text, None), (2**60 + 1, "clean", 5), (None, text, 6)], "doc_id long, text string, __runs long")
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    got = {r.doc_id: (r.text, r["__runs"]) for r in leaks.without_leaks(docs, items).collect()}
    kept = leaks.words(got[1][0])
    assert kept == "example first words head one tail of it example".split() and got[None][0] == got[1][0]
    assert got[2**60 + 1] == ("clean", 5) and got[1][1] is None and got[None][1] == 6
    assert "shuffle" not in leaks.without_leaks(docs, items)._jdf.queryExecution().executedPlan().toString().lower()


# 7 --------------------------------------------------------------------------------


def one_by_one(w, n, c):
    got = dict.fromkeys(w, 0)
    for _ in range(n):
        open_ = [(-w[k] / (2 * got[k] + 1), k) for k in w if w[k] > 0 and got[k] < c[k]]
        if open_:
            got[min(open_)[1]] += 1
    return got


def test_apportionment():
    rng = random.Random(5)
    for _ in range(300):
        w = {i: rng.choice([rng.random(), rng.randint(0, 4)]) for i in range(rng.randint(1, 7))}
        c, n = {i: rng.randint(0, 40) for i in w}, rng.randint(0, 120)
        assert mixing.sainte_lague(w, n, c) == one_by_one(w, n, c)


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["word"] * rng.randint(50, 150)), s) for i, s in enumerate(["hot"] * 400 + ["mid"] * 150 + ["small"] * 20 + [None] * 5)]
    rows += [(1000, "", "hot"), (1001, None, "hot"), (None, "x", "hot")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, weight int")
    targets = spark.createDataFrame([("m", "hot", 5.0, 1), ("m", "mid", 3.0, 2), ("m", "small", 2.0, 4), ("m", "none", 1.0, 2), ("m", None, 1.0, 1), ("m", "mid", None, 1)], "mix_name string, source string, weight double, max_repeats int")
    mix = mixing.mix_sources(docs, targets, shard_tokens=5000, block_tokens=256).persist()
    shares = {r.source: r for r in mixing.mix_shares(mix, targets).collect()}
    for s, want in (("hot", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(shares[s].share - want) < 0.03
    assert shares["small"].max_used <= 4 and shares["hot"].max_used == 1 and shares["none"].tokens == 0
    assert mix.groupBy("doc_id").count().filter("count > 1").count() == 0
    again = mixing.mix_sources(docs, targets, shard_tokens=5000, block_tokens=256)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mix.collect()))
    assert mixing.mix_sources(docs.limit(0), targets).count() == 0
    count = docs.filter("doc_id < 3").select(mixing.n_tokens("text").alias("n"), F.size(F.split("text", " ")).alias("w")).collect()
    assert all(r.n == r.w for r in count)


def test_shards_are_apportioned_like_one_by_one(spark):
    rng = random.Random(71)
    shards = {s: {i: rng.randint(1, 4000) for i in range(n)} for s, n in (("a", 40), ("b", 7), ("c", 1))}
    rows = spark.createDataFrame([(s, i, t) for s, of in shards.items() for i, t in of.items()], "source string, shard long, tokens long")
    given_ = [(m, s, q, r) for m, s, q, r in (("x", "a", 90, 1), ("x", "b", 13, 5), ("x", "c", 2, 3), ("y", "a", 400, 4), ("y", "b", 10**6, 2), ("y", "c", 0, 1))]
    quotas = spark.createDataFrame(given_, "mix_name string, source string, quota long, max_repeats int")
    for left_over in (0, 10_000):
        got = {}
        for r in mixing.shard_quotas(rows, quotas, 100, left_over=left_over).collect():
            got.setdefault((r.mix_name, r.source), {})[r.shard] = r.blocks
        for m, s, q, r in given_:
            caps = {i: -(-t * r // 100) for i, t in shards[s].items()}
            assert got[m, s] == mixing.sainte_lague(shards[s], q, caps)


def test_many_shards(spark):
    """A hundred thousand shards: the driver still sees a row per source only."""
    rows = spark.range(100_000).select(F.lit("a").alias("source"), F.col("id").alias("shard"), (F.lit(900_000) + F.pmod(F.hash("id"), 200_000)).cast("long").alias("tokens"))
    quotas = spark.createDataFrame([("x", "a", 150_000_000, 2)], "mix_name string, source string, quota long, max_repeats int")
    got = mixing.shard_quotas(rows, quotas, 512).agg(F.sum("blocks"), F.max(F.abs(F.col("blocks") / F.col("tokens") - F.lit(150_000_000) / F.lit(100_000 * 1_000_000)) * F.col("tokens"))).head()
    assert got[0] == 150_000_000 and got[1] < 2


def test_a_source_smaller_than_a_block(spark):
    docs = spark.createDataFrame([(i, "word " * 200, "big") for i in range(40)] + [(99, "word " * 90, "tiny")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "big", 9.0, 1), ("m", "tiny", 1.0, 3)], "mix_name string, source string, weight double, max_repeats int")
    used = {r.source: r.max_used for r in mixing.mix_shares(mixing.mix_sources(docs, targets), targets).collect()}
    assert used["tiny"] >= 1 and used["big"] == 1


# 8 --------------------------------------------------------------------------------


def brute_hash(f):
    b, n = b"  " + f.encode() + b"  ", [0] * 64
    for i in range(len(b) - 3):
        w = (int.from_bytes(b[i : i + 4], "little") + 1) * 0x9E3779B97F4A7C15 % 2**64
        w ^= w >> 29
        w = w * 0xBF58476D1CE4E5B9 % 2**64
        w ^= w >> 32
        n = [x + (w >> k & 1) for k, x in enumerate(n)]
    return sum(1 << k for k in range(64) if 2 * n[k] > len(b) - 3)


def test_simhashes_match_brute_force():
    rng = random.Random(8)
    forms = ["", "a", "é" * 30, "x" * 700] + [" ".join(sentence(rng, rng.randint(1, 12))) for _ in range(60)]
    assert [int(h) for h in residue.simhashes(forms)] == [brute_hash(f) for f in forms]


def as_nodes(spark, forms, space=0):
    hashes = residue.simhashes(forms).view("int64").tolist()
    return spark.createDataFrame([(space, residue._key(f), f, h) for f, h in zip(forms, hashes)], "space int, key long, form string, hash long")


def variants(rng, forms, n):
    some = sorted({w for t in forms for w in t.split()})
    out = set(forms)
    for _ in range(n):
        t = rng.choice(sorted(out)).split()
        k = rng.randrange(len(t))
        t[k] = rng.choice(some) if rng.random() < 0.3 else t[k] + rng.choice("aeinst")
        out.add(" ".join(t))
    return sorted(out)


def test_components_match_brute_force(spark):
    rng = random.Random(88)
    trusted = sorted({residue.normal_form(t)[0] for t in residue.TRUSTED_LINES})[-40:]
    long = "your session has expired sign in again to continue "
    forms = [*variants(rng, trusted, 220), "", "a", "é" * 30, "x" * 700, "\U0001f600 page not found", "the page the page not the page", (long * 3 + "now").strip()]
    labelled, front = set(trusted), trusted
    while front:
        front = [f for f in forms if f not in labelled and any(residue.similarity(f, t) >= 0.8 for t in front)]
        labelled |= set(front)
    got = residue.spread(as_nodes(spark, forms), as_nodes(spark, trusted))
    assert {r.form for r in got.collect()} == labelled and len(labelled) > 45 and (long * 3 + "now").strip() in labelled
    # Another graph's lines are no neighbours.
    assert residue.spread(as_nodes(spark, forms, 1), as_nodes(spark, trusted)).count() == len(trusted)


def test_tables_and_shingles(spark):
    rng = random.Random(89)
    trusted = sorted({residue.normal_form(t)[0] for t in residue.TRUSTED_LINES})
    forms = [f for f in variants(rng, trusted, 300) if f not in trusted]
    near = {f for f in forms if any(residue.similarity(f, t) >= 0.8 for t in trusted)}
    close = {f for f in near if any(residue.similarity(f, t) >= 0.8 and bin(brute_hash(f) ^ brute_hash(t)).count("1") <= 11 for t in trusted)}
    a, b = (residue.with_sets(as_nodes(spark, x)).persist() for x in (forms, trusted))
    keys = {residue._key(f): f for f in forms}
    assert {r.form: len(r.set) for r in a.collect()} == {f: len(residue.shingles(f)) for f in forms}
    tables = {keys[r.key] for r in residue.by_tables(a, b, 11, 0.8).collect()}
    assert tables <= close and len(tables) > 0.9 * len(close)  # six differing bits at most are always found
    assert {f for f in close if any(bin(brute_hash(f) ^ brute_hash(t)).count("1") <= 6 and residue.similarity(f, t) >= 0.8 for t in trusted)} <= tables
    assert {keys[r.key] for r in residue.by_shingles(a, b, 0.8).collect()} == near


def test_horizon_is_of_shingles():
    rng = random.Random(90)
    forms = [" ".join(sentence(rng, rng.randint(1, 4)) * rng.randint(1, 40) + sentence(rng, rng.randint(0, 30))) for _ in range(1500)]
    for most in (5, 60, 120):
        assert residue.few_shingles(forms, most).tolist() == [len(residue.shingles(f)) <= most for f in forms]


def test_lines_that_say_a_seed_several_times(spark):
    t = "Your session has expired. Sign in again to continue. Your session has expired. Sign in again to continue. Your session has expired. Sign in again now."
    assert residue.similarity(residue.normal_form(t)[0], residue.normal_form(t[:52])[0]) >= 0.8
    assert residue.residue_documents(spark.createDataFrame([(1, t)], "doc_id long, text string")).count() == 1


def test_forms():
    form = lambda s: residue.normal_form(s)[0]
    assert form("Your text here. Your text here.  YOUR TEXT HERE.") == "your text here" and form("1. 404 Not Found!") == "0 0 not found"
    assert form("xxxx XX xxx") == residue.CROSS and form("asdf jkl qwer") == residue.MASH and form("........ ....") == residue.DOTS
    assert form("Dolor sit amet consectetur elit sed tempor") == residue.DUMMY and form("  ") == ""
    assert residue.normal_form("Hi {{ name }}!")[1] and residue.normal_form("Hi <title> [DATE]")[2] == ["title", "date"]


def test_residue(spark):
    rng = random.Random(9)
    text = lambda: " ".join(sentence(rng, 12)) + "."
    bad = {
        1: "404 NOT FOUND", 2: text() + "\n\nPlease enable JavaScript to view this page.\n" + text(), 3: f"Dear {{{{ name }}}}, hello.\n{text()}",
        4: "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", 5: "Total: ${sum}", 6: "Owner: [NAME]", 7: "Your text here. " * 40,
        8: "An unexpected error occurred (code 0xBEEF).", 9: "Value: %s", 10: "for {{ name }} and ${sum}",
    }
    good = {
        20: text(), 21: 'The message "Access denied" comes from the server, and the fix is to change its owner.', 22: f"{text()}\n```\nDear {{{{ name }}}}\n404 Not Found\n```\n{text()}",
        23: "Write `${sum}` to insert the sum.", 24: "", 25: None, 26: "TODO comments were closed.", 27: "He said [sic] and <b>left</b>. In JSON: {\"a\": [0]}", 28: text() * 300,
    }
    df = spark.createDataFrame([(i, t, "clash") for i, t in [*bad.items(), *good.items(), (None, "404 Not Found"), (1, "404 NOT FOUND")]], "doc_id long, text string, form string")
    assert sorted(r.doc_id for r in residue.residue_documents(df).collect()) == sorted(bad)
    assert sorted(r.doc_id for r in residue.without_residue(df.filter("doc_id is not null")).collect()) == sorted(good)
    assert residue.residue_documents(df.limit(0)).count() == 0


def test_components_grow(spark):
    chain = ["the page you asked for could not be shown to you at this time", "the page you asked for could not be shown to you at this hour", "the page you asked for could not be shown to us at this hour", "the page we asked for could not be shown to us at this hour"]
    df = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    assert residue.similarity(chain[0], chain[3]) < 0.8
    assert residue.residue_documents(df, trusted=(chain[0],)).count() == 4


def test_unsure_placeholders_by_likeness(spark):
    sure = [f"Please send the {w} back to {{{{ person }}}} before the end of the week" for w in ("report", "folder")]
    like = ["[WHOEVER]", "%WHOEVER%", "«whoever»", "<whoever>", "{whoever}", "TODO: whoever", "$WHOEVER$"]
    rows = [*sure, *(f"Please send the report back to {x} before the end of the week" for x in like)]
    rows += ["He said [SIC] and <b>left</b>", "[WHOEVER]", "Please send the report back to whoever before the end of the week", "{{ person }}"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(r.doc_id for r in residue.residue_documents(df).collect()) == [*range(9), 12]


def test_registry():
    from trawl.llm import registry

    assert {f"p{n}_found" for n in (1, 3, 4, 6, 8)} | {"p7_mix"} <= set(registry.queries())
