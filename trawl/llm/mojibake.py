"""Text read in the wrong encoding: character n-gram models choose among encode-decode chains."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.runtime import spill

# How bytes were read, and what they were.
READ_AS = (
    "latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859-2", "iso8859-7", "iso8859-15",
    "cp437", "cp737", "cp850", "cp852", "cp866", "koi8-r", "mac-roman", "gbk", "cp932", "euc-jp", "big5", "cp949",
)
WERE = (
    "utf-8", "cp1252", "cp1250", "cp1251", "cp1253", "iso8859-2", "iso8859-7", "cp437", "cp850", "cp852", "cp866",
    "koi8-r", "mac-roman", "euc-jp", "cp932", "gbk",
)
_WIDE = {"gbk", "cp932", "euc-jp", "big5", "cp949"}
_UTF8 = re.compile(
    "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")
_SPACE = re.compile(r"[ \t\n\r]+")
_HIGH = re.compile(r"[^\x00-\x7f]")

BITS = 22
ESTABLISHED = 0.2  # outright acceptances per doubtful one that make a chain a known one
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pair_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slots of the hashed table for pairs of neighbouring characters."""
    h = (a.astype(np.uint64) + np.uint64(1)) * _A ^ (b.astype(np.uint64) + np.uint64(7)) * _B
    h ^= h >> np.uint64(31)
    return ((h * _A) >> np.uint64(64 - BITS)).astype(np.int64)


def pair_slot(a: int, b: int) -> int:
    """pair_slots() of one pair."""
    m = 0xFFFFFFFFFFFFFFFF
    h = (((a + 1) * 0x9E3779B97F4A7C15) & m) ^ (((b + 7) * 0xC2B2AE3D27D4EB4F) & m)
    h ^= h >> 31
    return ((h * 0x9E3779B97F4A7C15) & m) >> (64 - BITS)


@lru_cache(maxsize=None)
def _bytes_of(enc: str) -> dict[int, str]:
    """Per character of a one-byte encoding the byte it stands for, as a Latin-1 character.

    Bytes an encoding leaves out stand for the control character of their number, as
    browsers have it.
    """
    table: dict[int, str] = {}
    for b in range(0x80, 0x100):
        try:
            ch = bytes([b]).decode(enc)
        except UnicodeDecodeError:
            ch = chr(b)
        table.setdefault(ord(ch), chr(b))
    return table


@lru_cache(maxsize=None)
def _chars_of(enc: str) -> dict[int, str]:
    return {ord(b): chr(ch) for ch, b in _bytes_of(enc).items()}


_GAP = ""


def _as_bytes(text: str, read_as: str) -> str:
    """The bytes behind a text, as Latin-1 characters; _GAP for what the encoding can't have given."""
    return text.translate(_to_bytes(read_as))


class _WideBytes(dict):
    """Per character of an encoding of several bytes what it stands for, as it is met."""

    def __init__(self, enc: str):
        super().__init__()
        self.enc = enc

    def __missing__(self, cp: int) -> str:
        ch = chr(cp)
        try:
            to = ch if cp < 0x80 else ch.encode(self.enc).decode("latin-1")
        except UnicodeEncodeError:
            to = ch if 0x80 <= cp <= 0xA0 else _GAP
        self[cp] = to
        return to


class _ToBytes(dict):
    def __missing__(self, cp: int) -> int | str:
        return cp if cp < 0x80 else _GAP


@lru_cache(maxsize=None)
def _to_bytes(enc: str) -> dict:
    return _WideBytes(enc) if enc in _WIDE else _ToBytes(_bytes_of(enc))


@lru_cache(maxsize=None)
def _straight(read_as: str, was: str) -> dict[int, str]:
    """From one one-byte encoding to another."""
    to = _chars_of(was)
    return {ch: to.get(ord(b), b) for ch, b in _bytes_of(read_as).items()}


@lru_cache(maxsize=None)
def _letters(enc: str) -> frozenset[str]:
    return frozenset(map(chr, _bytes_of(enc)))


def undo(text: str, read_as: str, was: str) -> str | None:
    """`text` as it reads in encoding `was`, if it was read as `read_as`; None if it can't have been.

    For UTF-8 every run of bytes that is valid is put right and the rest stays, so a text
    that is damaged in places only is put right there. Other encodings must take it whole.
    """
    if was == "utf-8":
        raw = _as_bytes(text, read_as)
        if read_as not in _WIDE:
            out, at = [], 0
            for m in _UTF8.finditer(raw):
                out += (text[at : m.start()], m[0].encode("latin-1").decode("utf-8"))
                at = m.end()
            return "".join(out) + text[at:] if at else None
        rest, n = _UTF8.subn("", raw)
        if not n or len(_HIGH.findall(rest.replace(_GAP, ""))) > 2 + n:
            return None
        moved = _UTF8.sub(lambda m: _shift(m[0]), raw)
        return _unshift(re.sub(f"[\x80-\xff{_GAP}]+", "�", moved))
    if was == read_as:
        return None
    if read_as not in _WIDE and was not in _WIDE:
        return text.translate(_straight(read_as, was)) if _letters(read_as).issuperset(_HIGH.findall(text)) else None
    raw = _as_bytes(text, read_as)
    if _GAP in raw:
        return None
    if was not in _WIDE:
        return raw.translate(_chars_of(was))
    try:
        return raw.encode("latin-1").decode(was)
    except (UnicodeDecodeError, UnicodeEncodeError):
        return None


def _shift(s: str) -> str:
    """Characters decoded from bytes, moved out of the way of bytes not yet decoded."""
    return "".join(chr(0xF0000 + ord(c)) if ord(c) < 0x10000 else c for c in s.encode("latin-1").decode("utf-8"))


def _unshift(s: str) -> str:
    return "".join(chr(ord(c) - 0xF0000) if 0xF0000 <= ord(c) < 0x100000 else c for c in s)


class Model:
    """A smoothed character bigram model: hashed pair counts over single-character counts.

    Both tables are of fixed size whatever the corpus (2^22 slots, one per code point).
    """

    def __init__(self, pairs: np.ndarray, singles: np.ndarray, records: int = 0, strength: float = 20.0, share: float = 1e-3):
        total = float(singles.sum()) + 1.0
        # What fewer than `share` of the records show once may be damage itself: it counts as unseen.
        self.less = share * records
        self.base = ((np.maximum(singles - self.less, 0) + 0.02) / (total + 0.02 * len(singles))).astype(np.float64)
        self.pairs, self.singles, self.strength = pairs, singles, strength
        self.kept: dict[str, float] = {}

    def _log(self, pair: str) -> float:
        a, b = ord(pair[0]), ord(pair[1])
        slot = pair_slot(a, b)
        # A slot may be shared: no pair is more frequent than its rarer member.
        n = max(0.0, min(int(self.pairs[slot]), int(self.singles[a]), int(self.singles[b])) - self.less)
        v = math.log((n + self.strength * float(self.base[b])) / (int(self.singles[a]) + self.strength))
        if len(self.kept) < 1 << 20:
            self.kept[pair] = v
        return v

    def score(self, token: str, least: float = -math.inf) -> float:
        """Log-likelihood of a token between spaces; -inf as soon as it falls below `least`."""
        get, total, last = self.kept.get, 0.0, " "
        for ch in token + " ":
            v = get(last + ch)
            total += self._log(last + ch) if v is None else v
            if total < least:
                return -math.inf
            last = ch
        return total


def bodies(docs: DataFrame, file_id: str, text: str, packed: str) -> DataFrame:
    """(file_id, z, t, h): every body as its zstd frame, or as text where it has none; h is a hash of it.

    Two scans with filters on the packed column, so the text of a packed body is not read.
    """
    rows = docs.filter(F.col(file_id).isNotNull())
    own, none = F.col(file_id).alias("file_id"), F.lit(None)
    out = rows if packed not in docs.columns else rows.filter(F.col(packed).isNull())
    out = out.filter(F.col(text) != "").select(own, none.cast("binary").alias("z"), F.col(text).alias("t"))
    if packed in docs.columns:
        out = rows.filter(F.col(packed).isNotNull()).select(own, F.col(packed).alias("z"), none.cast("string").alias("t")).unionByName(out)
    return out.withColumn("h", F.xxhash64("z", "t"))


def unpacked(z: bytes | None, t: str | None) -> str:
    """The body; '' for none, and for a frame that can't be unpacked or holds no UTF-8."""
    if z is None:
        return t or ""
    try:
        return zstandard.ZstdDecompressor().decompressobj().decompress(bytes(z)).decode()
    except (zstandard.ZstdError, UnicodeDecodeError):
        return ""


def count_pairs(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Counts of neighbouring and of single characters over all clean bodies, and of those.

    Clean are bodies without lost characters, controls, or bytes that read as UTF-8 once
    put back through a common encoding. Each task adds up its batches in tables of fixed
    size and gives only what is not zero; what comes to the driver is bounded by the two
    tables.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = np.zeros(1 << BITS, np.int64)
        singles = np.zeros(0x110000, np.int64)
        records = np.zeros(1, np.int64)
        for pdf in batches:
            clean = [t for t in map(unpacked, pdf["z"].tolist(), pdf["t"].tolist()) if t and looks_clean(t)]
            records += len(clean)
            for at in range(0, len(clean), 4096):
                c = codes(" " + " ".join(_SPACE.sub(" ", t) for t in clean[at : at + 4096]) + " ")
                pairs += np.bincount(pair_slots(c[:-1], c[1:]), minlength=1 << BITS)
                singles[: c.max() + 1] += np.bincount(c)
        for kind, table in ((0, pairs), (1, singles), (2, records)):
            at = np.flatnonzero(table)
            yield pd.DataFrame({"kind": np.full(len(at), kind, np.int32), "slot": at.astype(np.int32), "n": table[at]})

    counted = rows.select("z", "t").mapInPandas(count, "kind int, slot int, n long")
    got = counted.groupBy("kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    pairs, singles = np.zeros(1 << BITS, np.int64), np.zeros(0x110000, np.int64)
    for kind, table in ((0, pairs), (1, singles)):
        part = got[got["kind"] == kind]
        table[part["slot"].to_numpy(np.int64)] = part["n"].to_numpy(np.int64)
    return pairs, singles, int(got.loc[got["kind"] == 2, "n"].sum())


_MISREAD = re.compile(
    "[ÂÃÄÅÆÎÏÐÑâãïĂГРСв├┬Γ]"
    "[\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™Ђ-Џђ-џ"
    "Ґґ№─-▓ĽĹŤŚŻťśż]"
)


def looks_clean(text: str) -> bool:
    return text.isascii() or not (_LOST.search(text) or _MISREAD.search(text))


_SCRIPTS = [re.compile(f"[{x}]") for x in ("A-Za-zÀ-ÖØ-öø-ɏ", "Ͱ-Ͽ", "Ѐ-ӿ", "぀-鿿가-힣")]


def _scripts(token: str) -> int:
    """In how many scripts a token is written."""
    return sum(p.search(token) is not None for p in _SCRIPTS)


def _price(read_as: str, was: str) -> float:
    """How much less likely a chain is beforehand than the commonest, in nats."""
    read = 0.0 if read_as in ("latin-1", "cp1252") else 1.0
    return 3.0 + read + {"utf-8": 0.0, "cp1252": 1.0, "cp1250": 1.0, "cp1251": 1.0}.get(was, 2.0)


_PRICES = {(r, w): _price(r, w) for r in READ_AS for w in WERE if r != w}
_OTHERS = [w for w in WERE if w != "utf-8"]
_ONE_BYTE = [w for w in _OTHERS if w not in _WIDE]
_LEAST_PRICE = min(p for (_, w), p in _PRICES.items() if w != "utf-8")
_TOKENS = re.compile(r"([ \t\n\r。、]+)")

# By whether a chain ends in UTF-8: what its margin is chosen from, and the ways to damage text that it is validated on.
GRIDS = {False: np.arange(7.0, 16.5, 0.5), True: np.arange(3.0, 12.5, 0.5)}
_DAMAGES = {u: [(r, w) for r, w in _PRICES if r not in _WIDE and (w == "utf-8" if u else w != "utf-8" and r in ("latin-1", "cp1252"))] for u in GRIDS}


class Fixer:
    """Finds and undoes wrong readings token by token, and by what tokens of a text share.

    Two readings of the counts are at work. In the plain one a correct but rare spelling
    stands by its own count, so it decides whether bytes were taken for those of another
    one-byte encoding, which fits any text. In the strict one what few records show counts
    as unseen, so damage can't vouch for itself; it decides on UTF-8, whose bytes hardly
    occur by chance.
    """

    def __init__(self, pairs: np.ndarray, singles: np.ndarray, records: int, margin: float, utf8_margin: float, rare: float = 1e-3):
        self.plain, self.strict = Model(pairs, singles), Model(pairs, singles, records)
        self.margin, self.utf8_margin, self.rare = margin, utf8_margin, rare
        self.doubt = min(5.0, utf8_margin)  # what a chain must gain to be thought of at all
        self.known: dict[str, dict] = {}

    def chains(self, token: str) -> dict[tuple, tuple[float, float, str]]:
        """Every chain that may apply to a token: what it gains in log-likelihood, plain and strict, and its result."""
        found = self.known.get(token)
        if found is not None:
            return found
        found = {}
        plain, strict = self.plain.score(token), self.strict.score(token)
        signs = not any(map(str.isalpha, token))  # frames and the like, unless their bytes are UTF-8
        scripts = _scripts(token)
        # Readings that come from the same bytes are tried once.
        behind: dict[tuple[str, bool], list[str]] = {}
        for read_as in READ_AS:
            behind.setdefault((_as_bytes(token, read_as), read_as in _WIDE), []).append(read_as)
        scored: dict[str, float] = {}
        for (raw, wide), readings in behind.items():
            if _UTF8.search(raw):
                for read_as in readings if wide else readings[:1]:
                    fixed = undo(token, read_as, "utf-8")
                    if fixed is not None and fixed != token:
                        gain = self.gain(self.strict, fixed, strict)
                        for r in [read_as] if wide else readings:
                            self._keep_utf8(found, r, fixed, gain - _PRICES[r, "utf-8"], strict)
            if _GAP in raw or signs:
                continue
            for was in _OTHERS:
                if was not in _WIDE:
                    fixed = raw.translate(_chars_of(was))
                else:
                    try:
                        fixed = raw.encode("latin-1").decode(was)
                    except (UnicodeDecodeError, UnicodeEncodeError):
                        continue
                if fixed == token:
                    continue
                gain = scored.get(fixed)
                if gain is None:
                    gain = self.gain(self.plain, fixed, plain)
                    if gain > 0 and scripts == 1 and _scripts(fixed) > 1:
                        gain = -math.inf  # no damage writes one word in two scripts
                    scored[fixed] = gain
                if gain <= _LEAST_PRICE:
                    continue
                strictly = self.gain(self.strict, fixed, strict)
                for r in readings:
                    if r != was and gain > (price := _PRICES[r, was]):
                        found[((r, was),)] = (gain - price, strictly - price, fixed)
        if len(self.known) < 1 << 17:
            self.known[token] = found
        return found

    def _keep_utf8(self, found: dict, read_as: str, fixed: str, gain: float, before: float) -> None:
        steps = [(read_as, "utf-8")]
        if _HIGH.search(fixed):  # misread more than once
            gain, fixed = self.again(fixed, before, gain, steps, read_as)
        if gain > 0:
            found[tuple(steps)] = (gain, gain, fixed)

    def again(self, fixed: str, before: float, gain: float, steps: list, read_as: str) -> tuple[float, str]:
        """More steps below a UTF-8 one: UTF-8 again, or in the end another one-byte encoding, if it gains the margin more."""
        for _ in range(2):
            tried, seen = [], set()
            for r in dict.fromkeys((read_as, "cp1252", "latin-1")):
                raw = _as_bytes(fixed, r)
                results = [("utf-8", undo(fixed, r, "utf-8"))] if _UTF8.search(raw) else []
                if _GAP not in raw and raw not in seen:  # of readings with the same bytes the first will do
                    seen.add(raw)
                    results += [(w, raw.translate(_chars_of(w))) for w in _ONE_BYTE]
                for w, more in results:
                    if r != w and more is not None and more != fixed and (w == "utf-8" or _scripts(more) <= 1):
                        price = 2.0 * len(steps) + (3.0 if w == "utf-8" else 2.0 + _PRICES[r, w])
                        tried.append((self.gain(self.strict, more, before) - price, more, (r, w)))
            best = max(tried, default=None)
            if best is None or best[0] <= gain + (0.0 if best[2][1] == "utf-8" else self.margin):
                break
            gain, fixed = best[0], best[1]
            steps.append(best[2])
            if best[2][1] != "utf-8":
                break
        return gain, fixed

    def gain(self, model: Model, fixed: str, before: float) -> float:
        shown = fixed.replace("\ufeff", "").replace("\xad", "")
        if not shown:
            return 12.0 if "\ufeff" in fixed else 0.0
        lost = 4.0 * len(_LOST.findall(shown))
        return model.score(shown, before + lost) - before - lost

    def best(self, token: str, utf8: bool) -> float:
        """What the best chain gains, of those that end in UTF-8 or of the others."""
        return max((gain for chain, (gain, _, _) in self.chains(token).items() if (chain[-1][1] == "utf-8") == utf8), default=0.0)

    def found(self, token: str, was_token: str, chain: tuple[str, str], enough: float) -> float:
        """best() of a token damaged by a chain; if the way back alone gains `enough`, other chains are not tried."""
        read_as, was = chain
        if undo(token, read_as, was) == was_token and (was == "utf-8" or (any(map(str.isalpha, token)) and not _scripts(token) == 1 < _scripts(was_token))):
            model = self.strict if was == "utf-8" else self.plain
            gain = self.gain(model, was_token, model.score(token)) - _PRICES[chain]
            if gain >= enough:
                return gain
        return self.best(token, was == "utf-8")

    def suspicious(self, texts: list[str]) -> Iterator[tuple[int, list[str]]]:
        """(text, its tokens with a rare transition, onwards or back, at a non-ASCII character)."""
        m, at = self.plain, 0
        while at < len(texts):
            n, size = at, 0
            while n < len(texts) and size < 1_000_000:
                size += len(texts[n]) + 1
                n += 1
            c = codes("\n" + "\n".join(texts[at:n]) + "\n")
            c = np.where((c == 9) | (c == 10) | (c == 13), np.uint32(32), c)
            where = np.flatnonzero((c[:-1] > 127) | (c[1:] > 127))
            a, b = c[where], c[where + 1]
            pairs = np.minimum(m.pairs[pair_slots(a, b)], np.minimum(m.singles[a], m.singles[b])) + 1.0
            odd = where[(pairs < self.rare * (m.singles[a] + 50)) | (pairs < self.rare * (m.singles[b] + 50))]
            starts = np.cumsum([1] + [len(t) + 1 for t in texts[at:n]])
            # The break before a text is taken as its own first character's neighbour.
            of = np.clip(np.searchsorted(starts - 1, odd, side="right") - 1, 0, n - at - 1)
            hits, first = np.unique(of, return_index=True)
            for k, here in zip(hits.tolist(), np.split(odd, first[1:])):
                text, here = texts[at + k], here - starts[k]
                parts = _TOKENS.split(text)
                ends = np.cumsum([len(t) for t in parts])
                # A transition belongs to the tokens on both its sides.
                hit = np.unique(np.searchsorted(ends, np.concatenate([here, here + 1]), side="right")).tolist()
                tokens = dict.fromkeys(parts[i] for i in hit if i < len(parts) and i % 2 == 0 and not parts[i].isascii())
                if tokens:
                    yield at + k, list(tokens)
            at = n

    def fix(self, text: str, tokens: list[str]) -> tuple[bool, bool, str, list[str], list[str], str | None, str | None]:
        """What is wrong with a text, and how it is put right.

        (damaged, bytes lost, the text put right as far as it can be, chains used, chains
        that may be, the likeliest of these, the text if that one is believed).
        """
        lost = _LOST.search(text) is not None
        by_chain: dict[tuple, float] = {}
        options = {t: self.chains(t) for t in tokens}
        for t, of in options.items():
            for chain, (gain, _, _) in of.items() if len(t) > 1 else ():
                by_chain[chain] = by_chain.get(chain, 0.0) + gain
        best = max(by_chain, key=lambda k: (by_chain[k], k)) if by_chain else None
        shared = best is not None and by_chain[best] >= self.least(best)
        used: dict[tuple, None] = {}
        maybe: dict[tuple, float] = {}
        change: dict[str, str] = {}
        for t, of in options.items():
            top = max(of, key=lambda k: (of[k][0], k)) if of else None
            if shared and best in of and of[top][0] <= of[best][0] + self.margin:
                top = best
            elif shared and best not in of and (as_others := self.like_others(t, best)) is not None:
                # Damage that many records share is no rare spelling; here the other tokens tell.
                change[t] = as_others
                continue
            elif top is None or of[top][0] < self.least(top) or (len(t) < 2 and top[-1][1] != "utf-8"):
                for k, (_, strict, _) in of.items():
                    if strict >= self.doubt and len(t) > 3:
                        maybe[k] = maybe.get(k, 0.0) + strict
                continue
            change[t] = of[top][2]
            used[top] = None
        put = lambda with_: "".join(with_.get(t, t) for t in _TOKENS.split(text)) if with_ else text
        likely = max(maybe, key=lambda k: (maybe[k], k)) if maybe else None
        more = {t: of[likely][2] for t, of in options.items() if likely in of and t not in change} if maybe else {}
        return (
            bool(change) or lost, lost, put(change), [_name(c) for c in used], [_name(c) for c in maybe],
            None if likely is None else _name(likely), put(change | more) if more else None,
        )

    def like_others(self, token: str, chain: tuple) -> str | None:
        """A token put right as the others of its text, if it reads better for it under the strict counts."""
        if len(chain) > 1 or chain[0][1] == "utf-8" or not any(map(str.isalpha, token)):
            return None
        fixed = undo(token, *chain[0])
        if fixed is None or fixed == token or _scripts(fixed) > 1:
            return None
        return fixed if self.gain(self.strict, fixed, self.strict.score(token)) >= self.doubt else None

    def least(self, chain: tuple) -> float:
        return self.utf8_margin if chain[-1][1] == "utf-8" else self.margin


def _name(chain: tuple) -> str:
    return " ".join(f"{r}>{w}" for r, w in chain)


def damage(text: str, read_as: str, was: str) -> str | None:
    """A text as it looks after its bytes in `was` were read as `read_as`; None if it can't be written so."""
    try:
        raw = text.encode(was)
    except UnicodeEncodeError:
        return None
    if read_as in _WIDE:
        return None
    return "".join(chr(b) if b < 0x80 else _chars_of(read_as).get(b, chr(b)) for b in raw)


def judged(probe: Fixer, tokens: list[str]) -> pd.DataFrame:
    """(script, utf8, at, n, changed, missed): how tokens held to be clean fare at each margin of a grid (`at`).

    n are the tokens of the script; changed are those the margin lets a chain change; missed,
    in millionths of a token, are the shares of the ways to damage a token at which none gains
    the margin. Every token is damaged in every way of _DAMAGES that can write it.
    """
    script = [next((i for i, p in enumerate(_SCRIPTS) if p.search(t)), -1) for t in tokens]
    sums = {(s, u): np.zeros((3, len(grid)), np.int64) for s in dict.fromkeys(script) for u, grid in GRIDS.items()}
    for utf8, grid in GRIDS.items():
        for at in range(0, len(tokens), 1000):
            some = tokens[at : at + 1000]
            hurt = [[(d, c) for c in _DAMAGES[utf8] if (d := damage(t, *c)) not in (None, t) and not d.isascii()] for t in some]
            of = list(dict.fromkeys([*some, *(d for each in hurt for d, _ in each)]))
            odd = {of[k] for k, _ in probe.suspicious(of)}
            for t, each, s in zip(some, hurt, script[at : at + 1000]):
                changed = (probe.best(t, utf8) if t in odd else 0.0) >= grid
                ways = dict(each)  # what looks the same is found or missed alike
                gain_of = {d: probe.found(d, t, c, grid[-1]) if d in odd else 0.0 for d, c in ways.items()}
                gains = np.array([gain_of[d] for d, _ in each])
                missed = (gains[:, None] < grid).sum(axis=0) * 1_000_000 // max(1, len(each))
                sums[s, utf8] += (np.ones(len(grid), np.int64), changed, missed)
    rows = [(s, u, k, *x) for (s, u), of in sums.items() for k, x in enumerate(of.T.tolist())]
    return pd.DataFrame(rows, columns=["script", "utf8", "at", "n", "changed", "missed"])


def chosen_margins(tally: pd.DataFrame, per_script: int = 100) -> tuple[float, float]:
    """(margin, margin for UTF-8) that best tell clean tokens from the same tokens damaged on purpose, by what judged() gave.

    Each margin is chosen from its grid by itself, over the chains it decides on: the
    smallest at which the fewest tokens are judged wrongly, a clean one changed counting
    like twenty damaged ones missed. All tokens count; a script weighs as much as it has
    tokens, but no more than `per_script` of them would.
    """
    wrong = {utf8: [Fraction(0)] * len(grid) for utf8, grid in GRIDS.items()}
    for x in tally.groupby(["script", "utf8", "at"], as_index=False)[["n", "changed", "missed"]].sum().itertuples():
        wrong[bool(x.utf8)][x.at] += Fraction(min(int(x.n), per_script), int(x.n)) * (20_000_000 * int(x.changed) + int(x.missed))
    margin, utf8_margin = (float(GRIDS[u][min(range(len(wrong[u])), key=wrong[u].__getitem__)]) for u in (False, True))
    return margin, utf8_margin


def clean_tokens(probe: Fixer, texts: list[str]) -> set[str]:
    """The non-ASCII tokens of the clean ones among texts.

    looks_clean() lets through damage that shows no sign of UTF-8. A text with a token that
    is changed at every margin of a grid is therefore left out; such a token can't tell one
    margin from another anyway.
    """
    texts = [t for t in texts if not t.isascii() and looks_clean(t)]
    sure = {k for k, of in probe.suspicious(texts) if any(probe.best(t, u) >= grid[-1] for t in of for u, grid in GRIDS.items())}
    return {w for k, t in enumerate(texts) if k not in sure for w in _TOKENS.split(t) if not w.isascii()}


def judged_bodies(rows: DataFrame, pairs: np.ndarray, singles: np.ndarray, records: int) -> pd.DataFrame:
    """judged() over the different tokens of all clean bodies, by counts that must not hold these."""
    context = rows.sparkSession.sparkContext
    sent = context.broadcast((pairs, singles))

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probe, given = Fixer(*sent.value, records, math.inf, math.inf), set()
        for pdf in batches:
            new = clean_tokens(probe, list(map(unpacked, pdf["z"].tolist(), pdf["t"].tolist()))) - given
            if len(given) < 1 << 17:
                given |= new
            yield pd.DataFrame({"token": sorted(new)}, dtype=object)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probe = Fixer(*sent.value, records, math.inf, math.inf)
        for pdf in batches:
            yield judged(probe, pdf["token"].tolist())

    every = rows.select("z", "t").mapInPandas(tokens, "token string").repartition(2 * context.defaultParallelism, "token").distinct()
    tally = every.mapInPandas(judge, "script int, utf8 boolean, at int, n long, changed long, missed long")
    got = tally.groupBy("script", "utf8", "at").agg(*[F.sum(c).alias(c) for c in ("n", "changed", "missed")]).toPandas()
    sent.destroy()
    return got


def fitted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, float, float]:
    """Counts over all clean bodies, how many those are, and the two margins validated on all their tokens.

    Bodies fall into two halves by their hash. The tokens of each half are judged by the
    counts of the other, so none vouches for itself; in the end the counts are added up.
    What comes to the driver is the counts and a row per script and margin.
    """
    halves = [rows.filter(F.pmod("h", F.lit(2)) == k) for k in (0, 1)]
    counts = [count_pairs(half) for half in halves]
    tally = pd.concat([judged_bodies(half, *other) for half, other in zip(halves, reversed(counts))])
    pairs, singles, records = (a + b for a, b in zip(*counts))
    return pairs, singles, records, *chosen_margins(tally)


def train(rows: DataFrame, held_out: int = 1000) -> tuple[np.ndarray, np.ndarray, int, float, float]:
    """As fitted(), but from one split with a bounded sample held out; no query uses it.

    Held out of the counts are at most `held_out` bodies, and at most a tenth: of a tenth of
    all by their hash, those with the smallest ones. The margins are validated on these alone.
    """
    tenth = F.pmod("h", F.lit(10)) == 0
    sample = rows.filter(tenth).orderBy("h").limit(held_out).collect()
    seen = rows.filter(~(tenth & (F.col("h") <= sample[-1].h))) if sample else rows
    pairs, singles, records = count_pairs(seen)
    probe = Fixer(pairs, singles, records, math.inf, math.inf)
    return pairs, singles, records, *chosen_margins(judged(probe, sorted(clean_tokens(probe, [unpacked(r.z, r.t) for r in sample]))))


def repaired(docs: DataFrame, file_id: str = "file_id", text: str = "text", packed: str = "text_zstd", established: float = ESTABLISHED) -> DataFrame:
    """(file_id, damaged, restored, chains) for every body with a place read wrongly.

    Bodies are read from their zstd frames (`packed`, if there is such a column), or from
    `text` where there is none. A character bigram model is trained on all clean bodies
    (see count_pairs), and its margins are validated on all their tokens (see fitted). Tokens with a transition that is rare under it are put through every
    chain "written in this, read as that", misread up to three times over; the likeliest
    chain is accepted if it gains more than the margin over leaving the token alone, for
    the token by itself or for all such tokens of the text together. A chain short of the
    margin is believed if it is a known one: accepted outright in `established` times as
    many bodies as it is short of the margin in, a share that is the same at any size. A
    replacement character or a stray control shows that bytes were lost: the body is
    damaged though that place can't be restored.

    NULL and empty bodies, frames that can't be unpacked and NULL ids yield nothing;
    repeated rows and ids each come out; texts are read whole, whatever their length; other
    columns are not read.
    """
    spark = docs.sparkSession
    rows = bodies(docs, file_id, text, packed)
    pairs, singles, records, margin, utf8_margin = fitted(rows)
    sent = spark.sparkContext.broadcast((pairs, singles))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fixer = Fixer(*sent.value, records, margin, utf8_margin)
        for pdf in batches:
            every = [(i, t) for i, t in zip(pdf["file_id"].tolist(), map(unpacked, pdf["z"].tolist(), pdf["t"].tolist())) if not t.isascii()]
            ids, texts = [i for i, _ in every], [t for _, t in every]
            tokens = dict(fixer.suspicious(texts))
            out = []
            for k, t in enumerate(texts):
                if k in tokens or _LOST.search(t):
                    x = fixer.fix(t, tokens.get(k, []))
                    if x[0] or x[4]:
                        out.append((ids[k], *x))
            yield pd.DataFrame(out, columns=["file_id", "damaged", "lost", "restored", "used", "maybe", "likely", "then"])

    kind = docs.schema[file_id].dataType.simpleString()
    columns = f"file_id {kind}, damaged boolean, lost boolean, restored string, used array<string>, maybe array<string>, likely string, then string"
    seen = spill(rows.select("file_id", "z", "t").mapInPandas(look, columns))
    # At most one row per chain.
    each = F.explode(F.array_distinct(F.concat(F.transform("used", lambda c: F.struct(c.alias("c"), F.lit(1).alias("sure"))), F.transform("maybe", lambda c: F.struct(c.alias("c"), F.lit(0).alias("sure"))))))
    often = seen.select(each.alias("x")).groupBy(F.col("x.c").alias("chain")).agg(F.sum("x.sure").alias("sure"), F.sum(1 - F.col("x.sure")).alias("short"))
    known = [r.chain for r in often.filter(F.col("sure") >= established * F.col("short")).filter("sure > 0").collect()]
    every = F.array(*[F.lit(c) for c in known]).cast("array<string>")
    believed, likely = F.arrays_overlap("maybe", every), F.array_contains(every, F.col("likely"))
    return seen.filter(F.col("damaged") | believed).select(
        "file_id",
        F.lit(True).alias("damaged"),
        F.when(likely, F.col("then")).otherwise(F.col("restored")).alias("restored"),
        F.array_join(F.when(likely, F.array_union("used", F.array("likely"))).otherwise(F.col("used")), "; ").alias("chains"),
    )


def damaged_files(docs: DataFrame) -> DataFrame:
    """(file_id), once each."""
    return repaired(docs).select("file_id").distinct()
