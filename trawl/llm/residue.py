"""Template residue, filler, error pages and script notices standing where content belongs.

Documents are cut into lines outside literal samples; each line is brought to a normal form
in which placeholders, dummy Latin, keyboard mashing and the like are single marks. The
distinct lines are the nodes of a near-duplicate graph (SimHash tables, Hamming distance,
text similarity; shared rarest shingles for links beyond the distance). Trusted labels start
at known wordings and at lines with a sure placeholder, and spread through its components.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.runtime import spill

# Wordings trusted to be residue, as lines of their own.
TRUSTED_LINES = (
    "Please enable JavaScript to view this page.",
    "You need to enable JavaScript to run this app.",
    "JavaScript is disabled in your browser.",
    "Scripts and cookies must be allowed to continue.",
    "Loading... If nothing happens, activate JavaScript.",
    "This viewer requires scripts. Turn on scripting in your browser and reload.",
    "Your browser does not support inline frames.",
    "Checking your browser before opening the catalog...",
    "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.",
    "Diese Ansicht benötigt Skripte.",
    "Veuillez activer JavaScript pour afficher cette page.",
    "Cette vue nécessite l'exécution de scripts.",
    "Active JavaScript para ver esta página.",
    "Esta vista requiere scripts activados.",
    "404 Not Found",
    "403 Forbidden",
    "500 Internal Server Error",
    "502 Bad Gateway",
    "503 Service Unavailable. Please try again later.",
    "504 Gateway Timeout",
    "Gateway timeout while contacting the index host.",
    "Error 404: the page you asked for does not exist.",
    "Page not found",
    "Access denied. You do not have permission to view this page.",
    "Too many requests. Slow down and retry.",
    "Oops! Something went wrong.",
    "Sorry, we can't find that page",
    "An unexpected error occurred (code 0x0001).",
    "This document could not be loaded.",
    "The requested file was moved or deleted.",
    "Preview is not available for this item.",
    "Your session has expired. Sign in again to continue.",
    "Seite nicht gefunden",
    "Zugriff verweigert",
    "Interner Serverfehler",
    "Das Dokument konnte nicht geladen werden.",
    "Page introuvable",
    "Accès refusé",
    "Erreur interne du serveur",
    "Le document n'a pas pu être chargé.",
    "Página no encontrada",
    "Acceso denegado",
    "Error interno del servidor",
    "No se pudo cargar el documento.",
    "Untitled document. Click to add text.",
    "This page intentionally left blank.",
    "Content to be supplied.",
    "Description goes here",
    "Coming soon",
    "TBD",
    "Your text here.",
    "Sample text goes here.",
    "Insert body copy.",
    "Placeholder paragraph.",
    "Lorem ipsum dolor sit amet",
    "asdf jkl qwer",
    "xxxx xx xxxx",
    "........ .... .....",
    "blah blah blah",
    "text text text",
    "test test test",
    "content content content",
)

# The words of the usual dummy Latin.
DUMMY_LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore "
    "magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat"
).split()
# Runs of neighbouring keys.
_MASH = re.compile(r"(?:asdf|sdf|qwer|qwerty|jkl|hjkl|fdsa|zxcv|uiop)+")

MARK, DUMMY, MASH, CROSS, DOTS = "", "", "", "", ""

_CODE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)|<(pre|code|noscript|script)\b.*?</\2>", re.S | re.M | re.I)
_INLINE = re.compile(r"``[^\n]*?``|`[^`\n]*`")
# Spellings that are placeholders wherever they stand in running text ...
_SURE = re.compile(
    r"\{\{\s*([^{}\n]{1,60}?)\s*\}\}|\$\{\s*([^{}\n]{1,60}?)\s*\}|#\{\s*([^{}\n]{1,60}?)\s*\}"
    r"|<%=?\s*([^%\n]{1,60}?)\s*%>|\{%\s*([^%\n]{1,60}?)\s*%\}|%\((\w{1,40})\)[sdif]|@@(\w{1,40}?)@@"
    r"|\[\[\s*([^\[\]\n|]{1,60}?)\s*\]\]|\bXX([a-z_]{2,40}?)XX\b|\[INSERT ([^\[\]\n]{1,60}?) HERE\]"
    r"|\[[Yy]our ([^\[\]\n]{1,60}?)\]|(?<![\w%{}])(?:\{\d\}|%[sd])(?![\w%{}])|\b__([A-Z][A-Z_]*[A-Z])__\b"
)
# ... and those that also mean other things; the names inside tell them apart.
_UNSURE = re.compile(
    r"(?<![{$#%\w])\{([A-Za-z_][\w -]{0,40})\}(?!\})|%([A-Z][A-Z_]{1,40})%|\$([A-Z][A-Z_]{1,40})\$"
    r"|(?<!\[)\[([A-Z][A-Z _]{1,40})\](?![\](])|«\s?([a-z_]{2,40})\s?»|</?([a-z][a-z_-]{1,40})>|\bTODO: ?([a-z_]+(?: [a-z_]+){0,2})"
)
_SURE_NAME = re.compile(r"(?:\{\{|\$\{|#\{|<%=)\s*([A-Za-z_][\w -]{0,40}?)\s*(?:\}|%>)", re.A)
_MARKS = re.compile(r"[{«]|<[%/a-z]|%[(A-Zsd]|\$[A-Z]|@@|\[[\[A-Zy]|XX|__|TODO")
_DIGITS = re.compile(r"\d+(?:x[0-9a-f]+)?")
_APART = re.compile(rf"[^\w\s{MARK}-{DOTS}]+|_+")
_ONLY_DOTS = re.compile(r"^[ \t]*[.…][.… \t]{3,}[.…][ \t]*$", re.M)


def name_of(raw: str) -> str:
    return re.sub(r"[\s-]+", "_", raw.strip().lower())


_STEMS = {w[:4] for w in DUMMY_LATIN if len(w) >= 4} | {"sita", "amen", "sedd", "exea", "dolu"}


def _is_dummy(words: list[str]) -> bool:
    """Five words or more, most of which, and one of the first four, begin like dummy Latin."""
    if len(words) < 5 or not (
        words[0][:4] in _STEMS or words[1][:4] in _STEMS or words[2][:4] in _STEMS or words[3][:4] in _STEMS
    ):
        return False
    return sum(w[:4] in _STEMS for w in words) >= 0.6 * len(words)


def _period(tokens: list[str]) -> int:
    """After how many tokens, eight at most, the line says the same again; 0 if it doesn't."""
    first = tokens[0]
    for k in range(1, min(9, len(tokens) // 2 + 1)):
        if tokens[k] == first and tokens[k:] == tokens[:-k]:
            return k
    return 0


def placeholders(line: str) -> tuple[str, bool, list[str]]:
    """(the line with sure placeholders as marks, whether there are any, names of unsure ones)."""
    line, hits = _SURE.subn(MARK, line)
    names: list[str] = []
    for m in _UNSURE.finditer(line):
        if m[6] and m[0].startswith("</"):
            continue
        if m[7]:
            words = m[7].split(" ")
            names += ["_".join(words[:k]) for k in range(1, len(words) + 1)]
        else:
            names.append(name_of(next(g for g in m.groups() if g)))
    return line, hits > 0, names


def all_marks(line: str) -> list[str]:
    """The line with its unsure placeholders as marks too; how far a TODO reaches is open, so up to three of them."""
    found = [m for m in _UNSURE.finditer(line) if not (m[6] and m[0].startswith("</"))]
    out = []
    for k in range(1, max((len((m[7] or "").split(" ")) for m in found), default=0) + 1):
        x, at = "", 0
        for m in found:
            left = " ".join(m[7].split(" ")[k:]) if m[7] else ""
            x += line[at : m.start()] + f" {MARK} {left}"
            at = m.end()
        out.append(x + line[at:])
    return out


def plain_words(text: str) -> str:
    """Lower case, words only, one space between them, numbers as 0; line for line."""
    text = text.lower()
    if "...." in text or "……" in text:
        text = _ONLY_DOTS.sub(DOTS, text)
    return _APART.sub(" ", _DIGITS.sub("0", text))


def form_of(tokens: list[str]) -> str:
    """What the words of a line come to: dummy text is one mark, what is repeated counts once."""
    first = tokens[0]
    if first[0] == "x" and all(set(t) == {"x"} for t in tokens):
        return CROSS
    if _MASH.fullmatch(first) and all(_MASH.fullmatch(t) for t in tokens):
        return MASH
    if _is_dummy(tokens):
        return DUMMY
    k = _period(tokens) if len(tokens) > 1 else 0
    return " ".join(tokens[:k] if k else tokens)


def normal_form(line: str) -> tuple[str, bool, list[str]]:
    """(normal form, a sure placeholder stands in it, names of the unsure ones) of one line."""
    sure, names = False, []
    if _MARKS.search(line):
        line, sure, names = placeholders(line)
    tokens = plain_words(line).split()
    return (form_of(tokens) if tokens else ""), sure, names


def lines_of(text: str) -> Iterator[tuple[str, bool, list[str], list[str]]]:
    """The lines of a document outside literal samples: as normal_form(), and their forms by all_marks()."""
    if "```" in text or "~~~" in text or "</" in text:
        text = _CODE.sub("\n", text)
    if "`" in text:
        text = _INLINE.sub(" ", text)
    marked: dict[int, tuple[bool, list[str], list[str]]] = {}
    if any(x in text for x in ("{", "[", "<", "%", "«", "$", "@@", "XX", "__", "TODO")) and _MARKS.search(text):
        lines = text.split("\n")
        for i, line in enumerate(lines):
            if _MARKS.search(line):
                lines[i], sure, names = placeholders(line)
                if sure or names:
                    full = [form_of(t) for x in all_marks(lines[i]) if (t := plain_words(x).split())] if names else []
                    marked[i] = (sure, names, full)
        text = "\n".join(lines)
    for i, line in enumerate(plain_words(text).split("\n")):
        tokens = line.split()
        if not tokens:
            continue
        yield form_of(tokens), *marked.get(i, (False, [], []))


def shingles(form: str) -> set[str]:
    s = f"  {form}  "
    return {s[i : i + 4] for i in range(len(s) - 3)}


def similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SPREAD2 = np.uint64(0xBF58476D1CE4E5B9)


_LANES = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], np.uint64)


def simhashes(forms: list[str]) -> np.ndarray:
    """64-bit SimHash of every form over its 4-byte windows, a batch at a time.

    The 64 counters of a form are kept as eight words of eight 8-bit lanes; runs of up to
    255 windows are added lane-wise, then the runs of a form in full width.
    """
    out = np.zeros(len(forms), np.uint64)
    chunk, size, start = [], 0, 0
    for i, f in enumerate(forms):
        b = b"  " + f.encode() + b"  "
        chunk.append(b)
        size += len(b)
        if size > 500_000 or i == len(forms) - 1:
            out[start : i + 1] = _simhash_batch(chunk)
            chunk, size, start = [], 0, i + 1
    return out


def _simhash_batch(chunk: list[bytes]) -> np.ndarray:
    lens = np.fromiter(map(len, chunk), np.int64, len(chunk))
    buf = np.frombuffer(b"".join(chunk) + b"   ", np.uint8).astype(np.uint64)
    w = buf[:-3] | (buf[1:-2] << np.uint64(8)) | (buf[2:-1] << np.uint64(16)) | (buf[3:] << np.uint64(24))
    w = (w + np.uint64(1)) * _SPREAD
    w = (w ^ (w >> np.uint64(29))) * _SPREAD2
    w ^= w >> np.uint64(32)
    ends = np.cumsum(lens)
    starts = ends - lens
    octets = w.view(np.uint8).reshape(-1, 8)
    for k in (1, 2, 3):  # windows that run into the next form count for none
        octets[ends - k] = 0
    runs = (lens + 254) // 255
    first = np.cumsum(runs) - runs
    cut = np.repeat(starts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    sums = np.stack([np.add.reduceat(_LANES[octets[:, k]], cut) for k in range(8)], axis=1)
    ones = sums.view(np.uint8).reshape(-1, 64).astype(np.int32)
    if len(cut) > len(lens):
        ones = np.add.reduceat(ones, first, axis=0)
    major = (2 * ones > (lens - 3)[:, None]).astype(np.uint8)
    return np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()


WORDING, TEMPLATE = 0, 1  # the graphs a line is a node of
MARKS_ALONE, NAME = 2, 3  # what stands beside them: lines without links, and names in sure placeholders
_SLOTS = 1 << 23  # of the bitmap of shingles, whatever their number
_LINES = "doc_id {}, space int, key long, form string, hash long, trusted boolean, names array<string>"


def _key(form: str) -> int:
    return int.from_bytes(hashlib.blake2b(form.encode(), digest_size=8).digest(), "little", signed=True)


def document_lines(docs: DataFrame, doc_id: str, text: str, horizon: int) -> DataFrame:
    """A row per distinct line of a document and graph it is in: its form there, SimHash, whether a sure placeholder stands in it.

    As a wording a line has its normal form; as a template its placeholders, unsure ones
    too, are marks (how far a TODO reaches is open, hence several rows). Lines of nothing
    but marks are like any other, so they are no node and only come out if trusted. What
    sure placeholders of the document are called, in literal samples too, are rows as well.
    """

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            texts = [(d, list(lines_of(t))) for d, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()) if t]
            long = list({x[0] for _, lines in texts for x in lines if len(x[0]) >= horizon})
            near = {f for f, few in zip(long, few_shingles(long, horizon)) if few}
            for d, lines in texts:
                seen: dict[tuple[int, str], list] = {}
                for form, sure, names, marked in lines:
                    if len(form) < horizon or form in near:
                        seen.setdefault((WORDING, form), [False, []])
                    for f in dict.fromkeys([*([form] if sure else []), *marked]):
                        space = TEMPLATE if f.replace(MARK, "").strip() else MARKS_ALONE
                        # Marks alone have no likeness: what they are called keeps them apart.
                        x = seen.setdefault((space, f if space == TEMPLATE else "\n".join([f, str(sure), *sorted(names)])), [False, []])
                        x[0] = x[0] or sure
                        x[1] = x[1] + names
                out += [(d, space, f, *x) for (space, f), x in seen.items()]
            for d, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                if t and any(x in t for x in ("{{", "${", "#{", "<%=")):
                    out += [(d, NAME, f, False, []) for f in {name_of(x) for x in _SURE_NAME.findall(t)}]
            ids, spaces, forms, sure, names = zip(*out) if out else ((), (), (), (), ())
            yield pd.DataFrame(
                {
                    "doc_id": ids,
                    "space": np.array(spaces, np.int32),
                    "key": np.array([_key(f) for f in forms], np.int64),
                    "form": forms,
                    "hash": simhashes(forms).view(np.int64),
                    "trusted": np.array(sure, bool),
                    "names": names,
                }
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.filter(f"`{doc_id}` is not null and `{text}` != ''")
    return rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(cut_up, _LINES.format(kind))


def _codes(text: str) -> np.ndarray:
    """A 40-bit code per window of 4 characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    w = c[:-3] | (c[1:-2] << np.uint64(21)) | (c[2:-1] << np.uint64(42))
    w = (w ^ (c[3:] * _SPREAD2)) * _SPREAD
    return w >> np.uint64(24)


def shingle_codes(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(form number, code) of all shingles, each once per form."""
    lens = np.fromiter(map(len, forms), np.int64, len(forms)) + 4
    code = _codes("".join(f"  {f}  " for f in forms) + "   ")
    inside = np.ones(len(code), bool)
    for k in (1, 2, 3):
        inside[np.cumsum(lens) - k] = False
    row = np.repeat(np.arange(len(forms), dtype=np.uint64), lens)
    key = np.sort((row[inside] << np.uint64(40)) | code[inside])
    key = key[np.r_[True, key[1:] != key[:-1]]]
    return (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1)


def few_shingles(forms: list[str], most: int) -> np.ndarray:
    """Which forms have at most `most` different shingles."""
    out = np.zeros(len(forms), bool)
    for at in range(0, len(forms), 1024):
        part = forms[at : at + 1024]
        # The beginning of most long lines proves too many (its padding adds three); the others are counted whole.
        n = np.bincount(shingle_codes([f[: most + 64] for f in part])[0], minlength=len(part))
        for i in np.flatnonzero(n <= most + 3).tolist():
            out[at + i] = len(shingles(part[i])) <= most
    return out


def _slots(code: np.ndarray, space: np.ndarray) -> np.ndarray:
    return ((code ^ (space.astype(np.uint64) * np.uint64(0x5BD1E995))) & np.uint64(_SLOTS - 1)).astype(np.int64)


def possible(forms: list[str], spaces: np.ndarray, known: np.ndarray, least: float) -> np.ndarray:
    """Which lines may have a near-duplicate among those whose shingles are known.

    Similarity `least` to any one line needs that share of the own shingles in common with
    it, and so with all of them together. One is let off, as codes may fall together.
    """
    out = np.zeros(len(forms), bool)
    for at in range(0, len(forms), 4096):
        part = forms[at : at + 4096]
        row, code = shingle_codes(part)
        hit = known[_slots(code, spaces[at : at + 4096][row])]
        n, k = np.bincount(row, minlength=len(part)), np.bincount(row[hit], minlength=len(part))
        out[at : at + 4096] = k + 1 >= least * n
    return out


def shingle_bitmap(front: DataFrame) -> np.ndarray:
    """A bit per slot that a shingle of the lines falls in; 1 MB in all, however many they are."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(_SLOTS, bool)
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                row, code = shingle_codes(part["form"].tolist())
                bits[_slots(code, part["space"].to_numpy()[row])] = True
        parts = np.packbits(bits).reshape(-1, 4096)
        at = np.flatnonzero(parts.any(axis=1))
        yield pd.DataFrame({"part": at.astype(np.int32), "bits": [parts[k].tobytes() for k in at]})

    got = front.select("form", "space").mapInPandas(mark, "part int, bits binary").groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits"))
    out = np.zeros((_SLOTS // 8 // 4096, 4096), np.uint8)
    for r in got.collect():  # 256 rows of 4 KB at most
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


_NODE = "space int, key long, form string, hash long, set array<long>"


def with_sets(nodes: DataFrame, known: np.ndarray | None = None, least: float = 0.8) -> DataFrame:
    """Nodes with the codes of their shingles; given a bitmap, only those that are possible (see there)."""
    sent = None if known is None else nodes.sparkSession.sparkContext.broadcast(known)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = None if sent is None else np.unpackbits(sent.value).view(bool)
        for pdf in batches:
            if bits is not None:
                pdf = pdf[possible(pdf["form"].tolist(), pdf["space"].to_numpy(), bits, least)]
            sets: list[np.ndarray] = []
            for at in range(0, len(pdf), 4096):
                part = pdf["form"].iloc[at : at + 4096].tolist()
                row, code = shingle_codes(part)
                sets += np.split(code.astype(np.int64), np.searchsorted(row, np.arange(1, len(part))))
            yield pdf.assign(set=pd.Series(sets, index=pdf.index, dtype=object))

    return nodes.select("space", "key", "form", "hash").mapInPandas(add, _NODE)


def _similar(least: float) -> Column:
    """The sets of a line and of one of the front are similar; codes of 40 bits hardly ever fall together."""
    both = F.size(F.array_intersect("set", "f_set"))
    return both >= least * (F.size("set") + F.size("f_set") - both) - 1e-9


def _sizes_fit(least: float) -> Column:
    n, m = F.size("set"), F.size("f_set")
    return (n >= least * m - 1e-9) & (m >= least * n - 1e-9)


def by_tables(lines: DataFrame, front: DataFrame, radius: int, least: float) -> DataFrame:
    """(space, key): the lines that are near-duplicates of one of the front, by partitioned SimHash tables.

    A fingerprint is cut into 8 bytes, and every pair of them is a key of 16 bits into one
    of 28 tables; those that agree in a key are compared by Hamming distance, then by their
    texts. A table is a join on the key, so none is held by any one task, and none is sent
    out (Spark would take it for as small as the lines it came from); a line is done with
    its first hit.
    """
    byte = [F.shiftrightunsigned("hash", 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    pairs = [(i, j) for i in range(8) for j in range(i)]
    at = F.array(*[byte[i] * 256 + byte[j] + (F.col("space") * len(pairs) + k) * 65536 for k, (i, j) in enumerate(pairs)])
    a = lines.select("space", "key", "set", "hash", F.explode(at).alias("at"))
    b = front.select(F.col("set").alias("f_set"), F.col("hash").alias("f_hash"), F.explode(at).alias("f_at"))
    close = F.bit_count(F.col("hash").bitwiseXOR(F.col("f_hash"))) <= radius
    near = (F.col("at") == F.col("f_at")) & close & _sizes_fit(least) & _similar(least)
    return a.join(b.hint("merge"), near, "left_semi").select("space", "key").distinct()


def by_shingles(lines: DataFrame, front: DataFrame, least: float) -> DataFrame:
    """(space, key): the lines that are near-duplicates of one of the front, whatever their fingerprints.

    Two lines that are similar enough share one of the rarest shingles of each (as many as
    may be missing, and one), so these are what the two sides are joined by.
    """
    count = front.select("space", F.explode("set").alias("s")).groupBy("space", "s").agg(F.count("*").alias("c"))

    def rarest(df: DataFrame) -> DataFrame:
        each = df.select("space", "key", F.explode("set").alias("s")).join(count, ["space", "s"], "left")
        one = F.struct(F.coalesce("c", F.lit(0)).alias("c"), "s")
        ranked = each.groupBy("space", "key").agg(F.sort_array(F.collect_list(one)).alias("r"))
        n = F.size("r")
        first = F.filter(F.slice("r", F.lit(1), n - F.ceil(F.lit(least) * n - 1e-9).cast("int") + 1), lambda x: x["c"] > 0)
        return ranked.select("space", "key", F.explode(first["s"]).alias("s")).join(df.select("space", "key", "set"), ["space", "key"])

    b = rarest(front).select(F.col("space").alias("f_space"), F.col("set").alias("f_set"), F.col("s").alias("f_s"))
    same = (F.col("space") == F.col("f_space")) & (F.col("s") == F.col("f_s"))
    return rarest(lines).join(b.hint("merge"), same & _sizes_fit(least) & _similar(least), "left_semi").select("space", "key").distinct()


def spread(nodes: DataFrame, trusted: DataFrame, radius: int = 11, least: float = 0.8) -> DataFrame:
    """(space, key, form, set): the nodes in components of the near-duplicate graph that hold a trusted line, and those lines.

    Both have (space, key, form, hash). The components grow outwards from the trusted
    lines, a round at a time, until a round adds nothing: nodes that may be linked to what
    the last round added are picked out by a bitmap of its shingles, a map-only step that
    loses none; these are looked up in the SimHash tables of the last round's lines, and
    those not found there by their rarest shingles. Everything is a join on keys, nothing
    comes to the driver but the bitmap, and lines in no such component are never linked, so
    the work follows the residue found, not the square of the corpus.
    """
    front = found = spill(with_sets(trusted.dropDuplicates(["space", "key"])))
    while True:
        lines = with_sets(nodes, shingle_bitmap(front), least)
        lines = spill(lines.join(found.select("space", "key"), ["space", "key"], "left_anti"))
        near = spill(by_tables(lines, front, radius, least))
        rest = lines.join(near, ["space", "key"], "left_anti")
        new = spill(lines.join(near.unionByName(by_shingles(rest, front, least)), ["space", "key"], "left_semi"))
        if new.isEmpty():
            return found.select("space", "key", "form", "set")
        front, found = new, found.unionByName(new)


def residue_lines(
    docs: DataFrame,
    trusted: tuple[str, ...] = TRUSTED_LINES,
    doc_id: str = "doc_id",
    text: str = "text",
    radius: int = 11,
    least: float = 0.8,
    name_least: int = 2,
) -> DataFrame:
    """(doc_id, key, kind): the lines of documents that are residue, by the key of their normal form.

    `kind` is 'wording' for lines in a component with a trusted wording, 'template' for
    lines in a component with a placeholder left standing. Placeholder spellings that mean
    other things too ([DATE], <title>, «owner», %TEMP%) are trusted if their name occurs in
    sure spellings in `name_least` documents; other such lines come out if they are in the
    component of a trusted one. Lines without any placeholder are in no template component.
    Code blocks and inline code are literal samples and are left out; a wording must make
    up the line, so quoting it in a sentence does not count.

    Of two near-duplicates neither has more than 1 / `least` times the different shingles of
    the other, so lines beyond a horizon of shingles need no node as a wording; should a
    component grow within reach of it, it is doubled and the lines are read again.

    NULL and empty texts and NULL ids yield nothing; equal documents under several ids all
    come out; ids need not be unique. Other columns are not read. A hot line, such as a
    menu a third of the corpus carries, is one node; nothing is gathered per line.
    """
    seeds = sorted({normal_form(t)[0] for t in trusted} | {DUMMY, MASH, CROSS, DOTS})
    size = max(len(shingles(f)) for f in seeds)
    horizon = int(1.6 * size)
    hashes = simhashes(seeds).view(np.int64).tolist()
    known = [(WORDING, _key(f), f, h) for f, h in zip(seeds, hashes)]
    known = docs.sparkSession.createDataFrame(known, "space int, key long, form string, hash long")
    while True:
        lines = spill(document_lines(docs, doc_id, text, horizon))
        named = lines.filter(F.col("space") == NAME).groupBy(F.col("form").alias("name")).agg(F.count_distinct("doc_id").alias("n"))
        named = named.filter(F.col("n") >= name_least).select("name")
        nodes = lines.filter(F.col("space") < MARKS_ALONE).groupBy("space", "key").agg(F.first("form").alias("form"), F.first("hash").alias("hash"))
        nodes = spill(nodes)
        by_name = lines.filter("size(names) > 0 and not trusted").withColumn("name", F.explode("names")).join(named, "name", "left_semi")
        sure = [df.select("space", "key", "form", "hash") for df in (lines.filter("trusted"), by_name)]
        found = spread(nodes, known.unionByName(sure[0]).unionByName(sure[1]), radius, least)
        longest = found.filter(F.col("space") == WORDING).agg(F.max(F.size("set"))).head()[0]
        if longest / least <= horizon:
            break
        horizon *= 2
    kind = F.when(F.col("space") == WORDING, "wording").otherwise("template").alias("kind")
    return lines.select("doc_id", "space", "key").join(found.select("space", "key"), ["space", "key"], "left_semi").select("doc_id", "key", kind).distinct()


def residue_documents(docs: DataFrame, **options) -> DataFrame:
    """(doc_id): documents with residue in them, wholly or in part, once each."""
    return residue_lines(docs, **options).select("doc_id").distinct()


def without_residue(docs: DataFrame, **options) -> DataFrame:
    """The documents free of residue, all columns kept."""
    return docs.join(residue_documents(docs, **options), "doc_id", "left_anti")
