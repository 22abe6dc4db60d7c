"""Text of files, by MIME type. Extractors are plain functions; the first that takes a type wins."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from trawl.model import ContentState
from trawl.sources.encoding import decode

MAX_MEMBER = 64 * 1024 * 1024
_PLAIN = {
    "application/json", "application/javascript", "application/xml", "application/toml", "application/yaml",
    "application/x-yaml", "application/sql", "application/x-sh", "application/x-tex", "application/xhtml+xml", "image/svg+xml",
}
_WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
_SLIDES = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
_SHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
_OPEN = "application/vnd.oasis.opendocument."


class ExtractError(ValueError):
    pass


def plain(data: bytes) -> str:
    return decode(data)


_RTF = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
_RTF_SKIP = {b"fonttbl", b"colortbl", b"stylesheet", b"info", b"pict", b"object", b"themedata", b"generator", b"listtable"}


def rtf(data: bytes) -> str:
    if not data.lstrip().startswith(b"{\\rtf"):
        raise ExtractError("not an RTF file")
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    skip, after, pending = False, 1, 0
    for m in _RTF.finditer(data):
        word, arg, hexa, sign, brace, text = m.groups()
        if brace == b"{":
            stack.append((skip, after))
        elif brace == b"}":
            skip, after = stack.pop() if stack else (False, 1)
        elif word is not None:
            if word in _RTF_SKIP:
                skip = True
            elif word == b"uc":
                after = int(arg or 1)
            elif skip:
                continue
            elif word in (b"par", b"line", b"row", b"sect", b"page"):
                out.append("\n")
            elif word in (b"tab", b"cell"):
                out.append("\t")
            elif word == b"u" and arg:
                out.append(chr(int(arg) & 0xFFFF))
                pending = after
        elif sign == b"*":
            skip = True
        elif not skip:
            if sign is not None:
                out.append({b"~": "\u00a0", b"_": "-", b"-": ""}.get(sign, sign.decode("latin-1")))
            elif hexa is not None:
                if pending:
                    pending -= 1
                else:
                    out.append(bytes([int(hexa, 16)]).decode("cp1252", "replace"))
            elif text is not None:
                s = text.decode("cp1252", "replace")
                out.append(s[pending:])
                pending = max(0, pending - len(s))
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()


def _member(z: zipfile.ZipFile, name: str) -> bytes:
    info = z.getinfo(name)
    if info.file_size > MAX_MEMBER:
        raise ExtractError(f"{name} is too large")
    return z.read(info)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _xml_text(data: bytes, text: set[str] | None, breaks: set[str], tabs: set[str] = frozenset()) -> str:
    """Text of the elements named (all if None), a line break after each of `breaks`."""
    out: list[str] = []
    for event, e in ElementTree.iterparse(io.BytesIO(data), ("start", "end")):
        name = _local(e.tag)
        if event == "end":
            if text is not None and name in text and e.text:
                out.append(e.text)
            if name in breaks:
                out.append("\n")
            if text is None and e.tail:
                out.append(e.tail)
        elif name in tabs:
            out.append("\t")
        elif text is None and e.text:
            out.append(e.text)
    return "".join(out)


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _zip(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ExtractError("malformed container") from e


def docx(data: bytes) -> str:
    with _zip(data) as z:
        return _xml_text(_member(z, "word/document.xml"), {"t"}, {"p", "br"}, {"tab"}).strip()


def pptx(data: bytes) -> str:
    with _zip(data) as z:
        slides = _numbered(z, r"ppt/slides/slide(\d+)\.xml")
        return "\n".join(_xml_text(_member(z, n), {"t"}, {"p"}).strip() for n in slides)


def xlsx(data: bytes) -> str:
    with _zip(data) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, e in ElementTree.iterparse(io.BytesIO(_member(z, "xl/sharedStrings.xml"))):
                if _local(e.tag) == "si":
                    shared.append("".join(t.text or "" for t in e.iter() if _local(t.tag) == "t"))
        out: list[str] = []
        for sheet in _numbered(z, r"xl/worksheets/sheet(\d+)\.xml"):
            for _, e in ElementTree.iterparse(io.BytesIO(_member(z, sheet))):
                if _local(e.tag) == "c":
                    value = next((x.text for x in e if _local(x.tag) == "v"), None)
                    if e.get("t") == "s" and value and value.isdigit() and int(value) < len(shared):
                        value = shared[int(value)]
                    elif e.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in e.iter() if _local(t.tag) == "t")
                    if value:
                        out.append(value + " ")
                elif _local(e.tag) == "row":
                    out.append("\n")
        return "".join(out).strip()


def open_document(data: bytes) -> str:
    with _zip(data) as z:
        return _xml_text(_member(z, "content.xml"), None, {"p", "h", "line-break", "table-row"}, {"tab"}).strip()


class Ole:
    """The streams of a compound file."""

    def __init__(self, data: bytes):
        if data[:8] != bytes.fromhex("D0CF11E0A1B11AE1") or len(data) < 512:
            raise ExtractError("not a compound file")
        self.data = data
        self.size = 1 << struct.unpack_from("<H", data, 30)[0]
        self.small = 1 << struct.unpack_from("<H", data, 32)[0]
        if not 64 <= self.size <= 1 << 16 or not 8 <= self.small <= self.size:
            raise ExtractError("malformed container")
        first_dir, self.cutoff = struct.unpack_from("<I", data, 48)[0], struct.unpack_from("<I", data, 56)[0]
        mini_start, difat, n_difat = struct.unpack_from("<I", data, 60)[0], *struct.unpack_from("<II", data, 68)
        sectors = list(struct.unpack_from("<109I", data, 76))
        for _ in range(min(n_difat, len(data) // self.size + 1)):
            block = self._sector(difat)
            if len(block) < self.size:
                break
            *more, difat = struct.unpack(f"<{self.size // 4}I", block)
            sectors += more
        fat = b"".join(self._sector(s) for s in sectors if s < 0xFFFFFFFA)
        self.fat = struct.unpack(f"<{len(fat) // 4}I", fat[: len(fat) // 4 * 4])
        self.entries: dict[str, tuple[int, int]] = {}
        root = (0xFFFFFFFE, 0)
        folder = self._chain(first_dir)
        for at in range(0, len(folder) - 127, 128):
            n = struct.unpack_from("<H", folder, at + 64)[0]
            kind = folder[at + 66]
            start, size = struct.unpack_from("<II", folder, at + 116)
            if kind == 5:
                root = (start, size)
            elif kind == 2 and 2 <= n <= 64:
                self.entries[folder[at : at + n - 2].decode("utf-16-le", "replace")] = (start, size)
        self.mini = self._chain(root[0])[: root[1]]
        table = self._chain(mini_start)
        self.mini_fat = struct.unpack(f"<{len(table) // 4}I", table[: len(table) // 4 * 4])

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        return self.data[at : at + self.size]

    def _chain(self, start: int) -> bytes:
        out, seen = [], 0
        while start < len(self.fat) and seen <= len(self.fat):
            out.append(self._sector(start))
            start, seen = self.fat[start], seen + 1
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        if name not in self.entries:
            raise ExtractError(f"no {name} stream")
        start, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], 0
        while start < len(self.mini_fat) and seen <= len(self.mini_fat):
            out.append(self.mini[start * self.small : (start + 1) * self.small])
            start, seen = self.mini_fat[start], seen + 1
        return b"".join(out)[:size]


def doc(data: bytes) -> str:
    ole = Ole(data)
    main = ole.stream("WordDocument")
    if len(main) < 0x1AA:
        raise ExtractError("malformed container")
    table = ole.stream("1Table" if struct.unpack_from("<H", main, 10)[0] & 0x200 else "0Table")
    at, size = struct.unpack_from("<II", main, 0x1A2)
    clx = table[at : at + size]
    i = 0
    while i < len(clx) and clx[i] == 1:
        i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
    if i >= len(clx) or clx[i] != 2:
        raise ExtractError("no piece table")
    n_bytes = struct.unpack_from("<I", clx, i + 1)[0]
    pieces = clx[i + 5 : i + 5 + n_bytes]
    n = (len(pieces) - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", pieces)
    out = []
    for k in range(n):
        where = struct.unpack_from("<I", pieces, 4 * (n + 1) + 8 * k + 2)[0]
        chars = max(0, ends[k + 1] - ends[k])
        if where & 0x40000000:
            where = (where & 0x3FFFFFFF) // 2
            out.append(main[where : where + chars].decode("cp1252", "replace"))
        else:
            out.append(main[where : where + 2 * chars].decode("utf-16-le", "replace"))
    text = re.sub(r"\x13[^\x13\x14\x15]*(?:\x14|(?=\x15))", "", "".join(out))  # field codes, not their results
    return text.translate({13: "\n", 7: "\t", 11: "\n", 12: "\n", 19: None, 20: None, 21: None, 1: None, 8: None}).strip()


def xls(data: bytes) -> str:
    ole = Ole(data)
    book = ole.stream("Workbook" if "Workbook" in ole.entries else "Book")
    records, at = [], 0
    while at + 4 <= len(book):
        kind, size = struct.unpack_from("<HH", book, at)
        records.append((kind, book[at + 4 : at + 4 + size]))
        at += 4 + size
    shared: list[str] = []
    for k, (kind, body) in enumerate(records):
        if kind == 0xFC:
            parts = [body[8:]]
            for kind2, more in records[k + 1 :]:
                if kind2 != 0x3C:
                    break
                parts.append(more)
            shared = _shared_strings(parts, struct.unpack_from("<I", body, 4)[0] if len(body) >= 8 else 0)
            break
    out: list[str] = []
    row = None
    for kind, body in records:
        value = None
        if kind == 0xFD and len(body) >= 10:
            k = struct.unpack_from("<I", body, 6)[0]
            value = shared[k] if k < len(shared) else None
        elif kind in (0x204, 0xD6) and len(body) > 8:
            n, flag = struct.unpack_from("<HB", body, 6)
            value = body[9 : 9 + n * (1 + (flag & 1))].decode("utf-16-le" if flag & 1 else "cp1252", "replace")
        elif kind == 0x203 and len(body) >= 14:
            value = f"{struct.unpack_from('<d', body, 6)[0]:g}"
        elif kind == 0x27E and len(body) >= 10:
            value = f"{_rk(struct.unpack_from('<I', body, 6)[0]):g}"
        if value:
            at_row = struct.unpack_from("<H", body)[0]
            if row is not None and at_row != row:
                out.append("\n")
            row = at_row
            out.append(value + " ")
    return "".join(out).strip()


def _rk(v: int) -> float:
    x = float(((v & 0xFFFFFFFC) ^ 0x80000000) - 0x80000000 >> 2) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return x / 100 if v & 1 else x


def _shared_strings(parts: list[bytes], count: int) -> list[str]:
    """Strings of a table that runs over several records; one that is split says its width anew."""
    out: list[str] = []
    part, at = 0, 0

    def need(n: int) -> bytes:
        nonlocal part, at
        got = b""
        while len(got) < n and part < len(parts):
            piece = parts[part][at : at + n - len(got)]
            got += piece
            at += len(piece)
            if at >= len(parts[part]) and len(got) < n:
                part, at = part + 1, 0
        return got

    while len(out) < count and part < len(parts):
        head = need(3)
        if len(head) < 3:
            break
        chars, flag = struct.unpack("<HB", head)
        runs = struct.unpack("<H", need(2).ljust(2, b"\0"))[0] if flag & 8 else 0
        extra = struct.unpack("<I", need(4).ljust(4, b"\0"))[0] if flag & 4 else 0
        text = ""
        while chars > 0 and part < len(parts):
            wide = 1 + (flag & 1)
            piece = parts[part][at : at + chars * wide]
            piece = piece[: len(piece) // wide * wide]
            text += piece.decode("utf-16-le" if wide == 2 else "latin-1", "replace")
            chars -= len(piece) // wide
            at += len(piece)
            if chars > 0:
                part, at = part + 1, 0
                if part < len(parts) and parts[part]:
                    flag, at = parts[part][0], 1
        need(4 * runs + extra)
        out.append(text)
    return out


def ppt(data: bytes) -> str:
    out: list[str] = []

    def walk(body: bytes, depth: int) -> None:
        at = 0
        while at + 8 <= len(body) and depth <= 32:
            head, kind, size = struct.unpack_from("<HHI", body, at)
            inner = body[at + 8 : at + 8 + size]
            if head & 15 == 15:
                walk(inner, depth + 1)
            elif kind in (4000, 4026):
                out.append(inner.decode("utf-16-le", "replace"))
            elif kind == 4008:
                out.append(inner.decode("cp1252", "replace"))
            at += 8 + size

    walk(Ole(data).stream("PowerPoint Document"), 0)
    return "\n".join(out).replace("\r", "\n").replace("\x0b", "\n").strip()


def audio(data: bytes) -> str:
    """Title, artist, album, genre and comment of ID3v2 tags."""
    if data[:3] != b"ID3" or len(data) < 10:
        return ""
    major = data[3]
    size = sum((b & 0x7F) << 7 * (3 - i) for i, b in enumerate(data[6:10]))
    names = {b"TIT2": 0, b"TT2": 0, b"TPE1": 1, b"TP1": 1, b"TALB": 2, b"TAL": 2, b"TCON": 3, b"TCO": 3, b"COMM": 4, b"COM": 4}
    found: dict[int, str] = {}
    at, end = 10, min(len(data), 10 + size)
    width, head = (3, 6) if major == 2 else (4, 10)
    while at + head <= end and data[at]:
        key, raw = data[at : at + width], data[at + width : at + 2 * width]
        n = sum((b & 0x7F) << 7 * (3 - i) for i, b in enumerate(raw)) if major == 4 else int.from_bytes(raw, "big")
        body = data[at + head : at + head + n]
        at += head + n
        if key in names and body:
            enc = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            text = body[1:]
            if key in (b"COMM", b"COM"):
                text = text[3:]
                gap = b"\0\0" if enc.startswith("utf-16") else b"\0"
                text = text.partition(gap)[2] or text
            found.setdefault(names[key], text.decode(enc, "replace").strip("\0﻿ "))
    return " ".join(found[k] for k in sorted(found) if found[k])


def pdf(data: bytes) -> str:
    try:
        import pypdf
    except ImportError as e:
        raise ExtractError("no extractor for PDF is installed") from e
    return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages).strip()


Extractor = Callable[[bytes], str]
_REGISTRY: list[tuple[Callable[[str], bool], Extractor]] = [
    (lambda m: m in ("application/rtf", "text/rtf"), rtf),
    (lambda m: m.startswith("text/") or m in _PLAIN, plain),
    (lambda m: m == _WORD, docx),
    (lambda m: m == _SLIDES, pptx),
    (lambda m: m == _SHEET, xlsx),
    (lambda m: m.startswith(_OPEN), open_document),
    (lambda m: m == "application/msword", doc),
    (lambda m: m == "application/vnd.ms-excel", xls),
    (lambda m: m == "application/vnd.ms-powerpoint", ppt),
    (lambda m: m == "application/pdf", pdf),
    (lambda m: m.startswith("audio/"), audio),
]


def register(takes: Callable[[str], bool], extractor: Extractor) -> None:
    """Put an extractor before those there are, in this process."""
    _REGISTRY.insert(0, (takes, extractor))


def extractor_for(mime: str | None) -> Extractor | None:
    return next((e for takes, e in _REGISTRY if takes(mime)), None) if mime else None


def cut_bytes(text: str, most: int) -> str:
    """At most so many bytes of UTF-8, whole characters only."""
    data = text.encode("utf-8", "replace")
    return text if len(data) <= most else data[:most].decode("utf-8", "ignore")


def decide(mime: str | None, data: bytes | None, most: int) -> tuple[int, str | None, str | None]:
    """(state, text, reason) of one file. An extractor that raises, however, is a failure with its reason."""
    extract = extractor_for(mime)
    if extract is None:
        return int(ContentState.NOT_APPLICABLE), None, None
    if data is None:
        return int(ContentState.FAILED), None, "unreadable"
    try:
        return int(ContentState.DONE), cut_bytes(extract(data), most), None
    except Exception as e:
        return int(ContentState.FAILED), None, f"{e}" or type(e).__name__


def extract_texts(files: DataFrame, most: int = 256 * 1024, reads: int | None = None, held: int = 8 << 20) -> DataFrame:
    """(id, content_state, text, reason) from (id, mime, content), or from (id, mime, path) with `reads`.

    With paths a task opens one file at a time, takes at most `reads` bytes of it (the
    extractors of containers get what they need, no larger file is offered), and hands
    texts on whenever `held` characters have gathered: what it holds is bounded by sizes,
    not by numbers of files.
    """
    schema = "id long, content_state int, text string, reason string"

    def frame(got: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"id": [g[0] for g in got], "content_state": [g[1] for g in got], "text": [g[2] for g in got], "reason": [g[3] for g in got]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got, size = [], 0
            for i, m, x in zip(pdf["id"].tolist(), pdf["mime"].tolist(), pdf["content" if reads is None else "path"].tolist()):
                data = x if reads is None else head_of(x, reads)
                got.append((i, *decide(m, None if data is None else bytes(data), most)))
                size += len(got[-1][2] or "")
                if size >= held:
                    yield frame(got)
                    got, size = [], 0
            yield frame(got)

    return files.select("id", "mime", "content" if reads is None else "path").mapInPandas(run, schema)


def head_of(path: str, n: int) -> bytes | None:
    """The first n bytes of a file, None if it can't be read."""
    try:
        with open(path, "rb") as f:
            return f.read(n)
    except OSError:
        return None
