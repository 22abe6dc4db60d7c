"""What a file is: MIME type from name and head, type bits from the MIME type."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.text import extension_of
from trawl.model import FileType as T

# Extension -> MIME type, extensions that decide before the content does, and
# extensions whose files may be something else, where the content decides.
PINNED = dict.fromkeys(("bat", "cmd", "inf", "ps1", "psd1", "psm1", "url"), "text/plain")
AMBIGUOUS = ("mod", "mts", "org", "pot", "scm", "ts", "vhd")
BY_EXTENSION = {
    "txt": "text/plain", "log": "text/plain", "md": "text/markdown", "csv": "text/csv", "html": "text/html",
    "htm": "text/html", "xml": "text/xml", "css": "text/css", "py": "text/x-python", "rs": "text/x-rust",
    "c": "text/x-c", "h": "text/x-c", "java": "text/x-java", "go": "text/x-go", "ts": "text/typescript",
    "org": "text/org", "toml": "application/toml", "yaml": "application/yaml", "yml": "application/yaml",
    "json": "application/json", "js": "application/javascript", "sh": "application/x-sh", "sql": "application/sql",
    "tex": "application/x-tex", "xhtml": "application/xhtml+xml", "svg": "image/svg+xml", "png": "image/png",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp",
    "tif": "image/tiff", "tiff": "image/tiff", "mp3": "audio/mpeg", "flac": "audio/flac", "ogg": "audio/ogg",
    "wav": "audio/x-wav", "m4a": "audio/mp4", "mp4": "video/mp4", "mkv": "video/x-matroska", "avi": "video/x-msvideo",
    "mov": "video/quicktime", "mts": "video/mp2t", "pdf": "application/pdf", "rtf": "application/rtf",
    "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "odt": "application/vnd.oasis.opendocument.text", "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "odp": "application/vnd.oasis.opendocument.presentation", "epub": "application/epub+zip", "zip": "application/zip",
    "tar": "application/x-tar", "7z": "application/x-7z-compressed", "rar": "application/x-rar-compressed",
    "gz": "application/gzip", "bz2": "application/x-bzip2", "xz": "application/x-xz",
    "deb": "application/vnd.debian.binary-package", "rpm": "application/x-rpm",
}
# Heads in hexadecimal.
MAGIC = (
    ("25504446", "application/pdf"), ("7B5C727466", "application/rtf"), ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("504B0304", "application/zip"), ("1F8B", "application/gzip"),
    ("425A68", "application/x-bzip2"), ("FD377A585A00", "application/x-xz"), ("377ABCAF271C", "application/x-7z-compressed"),
    ("526172211A07", "application/x-rar-compressed"), ("494433", "audio/mpeg"), ("664C6143", "audio/flac"),
    ("4F676753", "audio/ogg"), ("D0CF11E0A1B11AE1", "application/x-ole-storage"),
)
OLE = "application/x-ole-storage"
# Subtypes, whatever stands before the slash.
_DOCUMENT = (
    "msword", "vnd.openxmlformats-officedocument.wordprocessingml.document", "vnd.oasis.opendocument.text", "rtf", "pdf",
    "epub+zip", "x-mobipocket-ebook", "vnd.ms-outlook", "vnd.ms-htmlhelp",
)
_SHEET = ("vnd.ms-excel", "vnd.openxmlformats-officedocument.spreadsheetml.sheet", "vnd.oasis.opendocument.spreadsheet")
_SLIDES = (
    "vnd.ms-powerpoint", "vnd.openxmlformats-officedocument.presentationml.presentation",
    "vnd.oasis.opendocument.presentation",
)
_ARCHIVE = (
    "zip", "x-tar", "x-7z-compressed", "x-rar", "x-rar-compressed", "gzip", "x-bzip", "x-bzip2", "x-xz",
    "vnd.debian.binary-package", "x-rpm", "vnd.ms-cab-compressed", "x-msi",
)
_CODE = ("json", "javascript", "xml", "toml", "yaml", "x-yaml", "sql", "x-sh", "x-tex", "svg+xml")
_TOP = {"audio": T.AUDIO, "image": T.IMAGE, "video": T.VIDEO, "text": T.TEXT}
_SUB = [
    (("html",), T.DOCUMENT), (_DOCUMENT, T.DOCUMENT), (_SHEET, T.DOCUMENT | T.SPREADSHEET), (_SLIDES, T.DOCUMENT | T.PRESENTATION),
    (_ARCHIVE, T.ARCHIVE), (("xhtml+xml",), T.TEXT | T.DOCUMENT), (_CODE, T.TEXT),
]


def known_extensions() -> dict[str, str]:
    """MIME types by extension: the list above, and what Python's own table has beyond it."""
    more = mimetypes.MimeTypes(filenames=()).types_map[True]
    return {e[1:]: m for e, m in sorted(more.items()) if m != "application/octet-stream"} | BY_EXTENSION


def type_bits(mime: Column) -> Column:
    """Type bits of a MIME type; 0 without a slash, NULL for NULL. Bits add up: SVG is image and text."""
    parts = F.split(mime, "/", 2)
    top, sub = parts[0], F.try_element_at(parts, F.lit(2))
    bits = F.lit(0)
    for name, bit in _TOP.items():
        bits = bits.bitwiseOR(F.when(top == name, int(bit)).otherwise(0))
    for names, bit in _SUB:
        if names == ("html",):
            bits = bits.bitwiseOR(F.when((top == "text") & (sub == "html"), int(bit)).otherwise(0))
        else:
            bits = bits.bitwiseOR(F.when(sub.isin(*names), int(bit)).otherwise(0))
    return F.when(mime.isNull(), None).when(~mime.contains("/"), 0).otherwise(bits).cast("int")


def guess_mime(name: Column, head: Column) -> Column:
    """MIME type by pinned extensions, then extension, then magic bytes, then whether it reads as text.

    For ambiguous extensions the content comes before the extension. An OLE container says
    less than an Office extension. NULL: nothing fits.
    """
    from trawl.sources.encoding import looks_like_text

    ext = extension_of(name)
    table = F.create_map(*[F.lit(x) for kv in known_extensions().items() for x in kv])
    pinned = F.create_map(*[F.lit(x) for kv in PINNED.items() for x in kv])
    magic = F.lit(None).cast("string")
    for bytes_, mime in reversed(MAGIC):
        n = len(bytes_) // 2
        magic = F.when(F.hex(F.substring(head, 1, n)) == bytes_, mime).otherwise(magic)
    by_ext = F.try_element_at(table, ext)
    text = F.when(looks_like_text(head), "text/plain")
    sure = F.when(magic != OLE, magic)
    return F.coalesce(
        F.try_element_at(pinned, ext), F.when(ext.isin(*AMBIGUOUS), F.coalesce(sure, text)), by_ext, sure, magic, text
    )
