"""Evaluation passages inside a corpus: broadcast n-gram set, window scan, verified alignment."""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

_DROP = dict.fromkeys(
    cp for cp in range(sys.maxunicode + 1) if unicodedata.category(chr(cp)) in ("Mn", "Cf", "Me")
)
_SOFT = re.compile("\xad(?=\\s*[\n\r])")  # a soft hyphen shows at the end of a line only
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)

# What is cut out of a text, in this order: the pattern, and characters one of which it can't do without.
_CUTS = (
    (re.compile(r"</?(?:[pP]|[bB][rR]|[hH][rR]|[hH][1-6]|[dD][iI][vV]|[lL][iI]|[uUoO][lL]|[tT][dDrRhH]|[dD][tTdD])\b[^<>\n]{0,200}>"), " ", "<"),
    (re.compile(r"</?[A-Za-z][^<>\n]{0,200}>"), "", "<"),
    (re.compile(r"[-‐‑]\s*[\n\r][>\s*]*(?=[^\W\d_])"), "", "-‐‑"),
)


def plain(text: str, at: list[int] | None = None) -> str:
    """Without accents, invisible characters, markup tags and word breaks at line ends; lower case.

    `at`, if given, receives of each character left the place it had in `text`; what is
    left is the same with and without it.
    """
    places: list[int] | range = range(len(text))
    if not text.isascii():
        text = _SOFT.sub("-", text)
        if at is None:
            text = unicodedata.normalize("NFKD", text).translate(_DROP)
        else:
            spelt = [(x, i) for i, ch in enumerate(text) for x in unicodedata.normalize("NFKD", ch) if ord(x) not in _DROP]
            text, places = "".join(x for x, _ in spelt), [i for _, i in spelt]
    for pattern, to, needs in _CUTS:
        if not any(c in text for c in needs):
            continue
        if at is None:
            text = pattern.sub(to, text)
            continue
        out, left, end = [], [], 0
        for m in pattern.finditer(text):
            out += (text[end : m.start()], to)
            left += [*places[end : m.start()], *[places[m.start()]] * len(to)]
            end = m.end()
        text, places = "".join([*out, text[end:]]), [*left, *places[end:]]
    if at is not None:
        at += places
    # After NFKD no letter changes its length, and sigma has one form.
    return text.lower().replace("ς", "σ")


def words(text: str) -> list[str]:
    return _WORD.findall(plain(text))


def words_at(text: str) -> tuple[list[str], list[int], list[int]]:
    """The words of `text`, and where each begins and ends in the text as it is."""
    at: list[int] = []
    found = list(_WORD.finditer(plain(text, at)))
    return [m[0] for m in found], [at[m.start()] for m in found], [at[m.end() - 1] + 1 for m in found]


_BORDER = re.compile(r"((?<=[.!?:])[ \t\n\x0b\f\r]+|\n)")


def shared_lines(items: DataFrame, text: str, share: float, below: int) -> list[str]:
    """Sentences of fewer than `below` words in `share` of the different item texts (three at least): instructions.

    A sentence as long as a run is a passage, however many items share it. There can be no
    more of them than the items have sentences on average, over `share`.
    """
    texts = items.select(text).filter(F.col(text).isNotNull()).distinct()
    least = max(3, math.ceil(share * texts.count()))
    sentence = F.explode(F.array_distinct(F.transform(F.split(F.col(text), _BORDER.pattern), lambda s: F.trim(s)))).alias("s")
    found = texts.select(sentence).groupBy("s").count().filter(f"s != '' and count >= {least}")
    return sorted(r.s for r in found.select("s").toLocalIterator() if len(words(r.s)) < below)


def without_shared(text: str, shared: set[str]) -> str:
    """The text without the shared sentences, where they stand as sentences."""
    return "".join(" \n " if part.strip(" ") in shared else part for part in _BORDER.split(text)) if shared else text


@dataclass
class Index:
    """n-grams of a block of items: sorted codes, and the (item, position) of each."""

    n: int
    vocab: dict[str, int]
    codes: np.ndarray
    item: np.ndarray  # number of the item in the block
    pos: np.ndarray
    ids: list  # item ids by number
    words: list[list[str]]
    flat: np.ndarray  # word numbers of all items, one after another
    start: np.ndarray  # where those of an item begin


def codes_of(ids: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit code per window of n word numbers; it mixes, so hits are verified."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        out = (out ^ ids[k : k + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def build_index(items: list[tuple[int, str]], n: int, shared: list[str]) -> Index:
    instructions = set(shared)
    vocab: dict[str, int] = {}
    kept = [words(without_shared(text, instructions)) for _, text in items]
    numbers = [np.array([vocab.setdefault(x, len(vocab) + 1) for x in w], np.uint64) for w in kept]
    windows = [codes_of(x, n) for x in numbers]
    none = np.zeros(0, np.uint64)
    codes = np.concatenate([none, *windows])
    order = np.argsort(codes, kind="stable")
    lens = np.array([len(w) for w in windows], np.int64)
    sizes = np.array([len(x) for x in numbers], np.int64)
    return Index(
        n,
        vocab,
        codes[order],
        np.repeat(np.arange(len(items), dtype=np.int64), lens)[order],
        (np.arange(len(codes), dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens))[order],
        [i for i, _ in items],
        kept,
        np.concatenate([none, *numbers]),
        np.cumsum(sizes) - sizes,
    )


def _extend(doc: list[str], item: list[str], d: int, p: int, step: int, slack: int) -> tuple[int, int, int]:
    """Follow the diagonal outwards; the last place where both agree, and how often they did."""
    last, agreed, missed = (d, p), 0, 0
    d, p = d + step, p + step
    while 0 <= d < len(doc) and 0 <= p < len(item) and missed <= slack:
        if doc[d] == item[p]:
            last, agreed, missed = (d, p), agreed + 1, 0
        else:
            missed += 1
        d, p = d + step, p + step
    return last[0], last[1], agreed


def runs(
    doc: list[str], item: list[str], hits: list[tuple[int, int]], n: int, gap: int = 14, drift: int = 3
) -> list[tuple[int, int, int, int, int]]:
    """Aligned runs (doc from, doc to, item from, item to, agreeing words), ends included.

    Window hits are chained in document order while the alignment drifts by no more than
    `drift` words (inserted marks) and leaves gaps of at most `gap` words.
    """
    open_: list[list] = []  # [first hit, last hit, item words covered]
    done: list[list] = []
    for d, p in sorted(hits):
        placed = False
        for c in open_:
            ld, lp = c[1]
            if 0 < d - ld <= gap and 0 < p - lp <= gap and abs((d - ld) - (p - lp)) <= drift:
                fresh = min(n, p - lp)
                if p - lp > n:  # words between two windows that agree all the same
                    fresh += sum(1 for k in range(lp + n, p) if item[k] in doc[ld + n : d])
                c[1] = (d, p)
                c[2] += fresh
                placed = True
                break
        if not placed:
            open_.append([(d, p), (d, p), n])
        if len(open_) > 64:
            old = [c for c in open_ if d - c[1][0] > gap]
            done += old
            open_ = [c for c in open_ if d - c[1][0] <= gap]
    out = []
    for (d0, p0), (d1, p1), same in done + open_:
        a, b, left = _extend(doc, item, d0, p0, -1, 2)
        e, f, right = _extend(doc, item, d1 + n - 1, p1 + n - 1, 1, 2)
        out.append((a, e, b, f, same + left + right))
    return out


def windows_hit(ids: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the document, item number, place in the item) of every window the two share, by item."""
    n, none = index.n, np.zeros(0, np.int64)
    full = ids[: max(0, len(ids) - n + 1)] > 0
    for k in range(1, n):
        full &= ids[k : k + len(full)] > 0
    where = np.flatnonzero(full)
    if not len(where) or not len(index.codes):
        return none, none, none
    codes = codes_of(ids, n)[where]
    lo = np.searchsorted(index.codes, codes)
    hit = index.codes[np.minimum(lo, len(index.codes) - 1)] == codes
    where, lo = where[hit], lo[hit]
    many = np.searchsorted(index.codes, codes[hit], side="right") - lo
    d = np.repeat(where, many)
    at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
    item, p = index.item[at], index.pos[at]
    same = np.ones(len(d), bool)
    for k in range(n):  # codes may fall together
        same &= index.flat[index.start[item] + p + k] == ids[d + k]
    d, item, p = d[same], item[same], p[same]
    order = np.lexsort((p, d, item))
    return d[order], item[order], p[order]


def scan(texts: list[str | None], index: Index, min_words: int, min_share: float) -> list[tuple[int, int, int, int]]:
    """(row, item, first and last word of the run in the document), verified."""
    get = index.vocab.get
    found: list[tuple[int, int, int, int]] = []
    for row, text in enumerate(texts):
        doc = words(text) if text else []
        if len(doc) < min_words:
            continue
        d, item, p = windows_hit(np.fromiter((get(w, 0) for w in doc), np.uint64, len(doc)), index)
        cuts = [0, *(np.flatnonzero(np.diff(item)) + 1).tolist(), len(d)] if len(d) else []
        for x, y in zip(cuts, cuts[1:]):
            i = int(item[x])
            for a, e, b, f, same in runs(doc, index.words[i], list(zip(d[x:y].tolist(), p[x:y].tolist())), index.n):
                if f - b + 1 >= min_words and same >= min_share * (f - b + 1):
                    found.append((row, index.ids[i], a, e))
    return found


def item_blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of at most `block_chars` characters of text."""
    block, size = [], 0
    rows = items.filter(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(item_id, text)
    for i, t in rows.orderBy(item_id).toLocalIterator():
        if block and size + len(t) > block_chars:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t)
    if block:
        yield block


def _indexes(items: DataFrame, item_id: str, text: str, n: int, min_words: int, shared_share: float, block_chars: int) -> Iterator:
    """The indexes of the blocks of items, broadcast one by one."""
    shared = shared_lines(items, text, shared_share, min_words)
    for block in item_blocks(items, item_id, text, block_chars):
        yield items.sparkSession.sparkContext.broadcast(build_index(block, n, shared))


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 4,
    min_words: int = 15,
    min_share: float = 0.72,
    shared_share: float = 0.03,
    block_chars: int = 32_000_000,
) -> DataFrame:
    """(doc_id, item_id, first_word, last_word) for every run of item words in a document.

    The held-out items are normalised, cut into word n-grams and broadcast, in blocks of
    `block_chars` characters, so what is sent out is bounded whatever their number; the
    corpus is scanned once per block and never shuffled. A window that hits is verified
    by aligning document and item from there: the run must span `min_words` item words,
    of which `min_share` agree in order (about one word in nine may be replaced; marks
    may be inserted). Sentences shorter than a run that stand in `shared_share` of the
    different item texts, three at least, are instructions and don't count.

    NULL or empty texts and texts shorter than a run yield nothing; a document listed
    under two ids, or twice, comes out for each row; NULL ids pass through. Items with
    the same text each come out. Other columns are not read, so their names can't clash.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, first_word int, last_word int"
    rows = docs.filter(F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    out: DataFrame | None = None
    for sent in _indexes(items, item_id, item_text, n, min_words, shared_share, block_chars):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = scan(batch.column(1).to_pylist(), sent.value, min_words, min_share)
                row, item, first, last = zip(*hits) if hits else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array(item, pa.int64()),
                        pa.array(first, pa.int32()),
                        pa.array(last, pa.int32()),
                    ],
                    ["doc_id", "item_id", "first_word", "last_word"],
                )

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def leaked_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id), once each."""
    return find_leaks(docs, items, **options).select("doc_id", "item_id").distinct()


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the runs of words (first, last)."""
    _, start, end = words_at(text)
    out, at = [], 0
    for a, b in sorted((start[a], end[b]) for a, b in spans):
        out.append(text[at : max(at, a)])
        at = max(at, b)
    return "".join([*out, text[at:]])


def without_leaks(
    docs: DataFrame,
    items: DataFrame,
    whole: bool = False,
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 4,
    min_words: int = 15,
    min_share: float = 0.72,
    shared_share: float = 0.03,
    block_chars: int = 32_000_000,
) -> DataFrame:
    """The corpus without leaked documents (`whole`), or with the leaked passages cut out of them.

    Runs are found as in find_leaks and cut where the text is scanned: one pass over the
    corpus per block of items, no join and no shuffle; all passages are found in the text
    as it came before any is cut. All rows and columns are kept as they are (NULL texts,
    repeated ids and NULL ids too); documents without a leak come through untouched.
    """
    places = "__runs"
    while places in docs.columns:
        places += "_"
    span = StructType([StructField("a", IntegerType()), StructField("b", IntegerType())])
    rows = docs.withColumn(places, F.array().cast(ArrayType(span)))
    schema = rows.schema
    for sent in _indexes(items, item_id, item_text, n, min_words, shared_share, block_chars):

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k = batch.schema.get_field_index(places)
                runs_ = batch.column(k).to_pylist()
                for row, _, a, b in scan(batch.column(batch.schema.get_field_index(doc_text)).to_pylist(), sent.value, min_words, min_share):
                    runs_[row].append({"a": a, "b": b})
                yield batch.set_column(k, batch.schema.field(k), pa.array(runs_, batch.schema.field(k).type))

        rows = rows.mapInArrow(look, schema)
    if whole:
        return rows.filter(F.size(places) == 0).drop(places)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index(places)).to_pylist()
            k = batch.schema.get_field_index(doc_text)
            if any(spans):
                texts = batch.column(k).to_pylist()
                texts = [cut_out(t, [(x["a"], x["b"]) for x in s]) if s else t for t, s in zip(texts, spans)]
                batch = batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))
            yield batch

    return rows.mapInArrow(cut, schema).drop(places)
