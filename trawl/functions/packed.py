"""Bodies as zstd frames: packed and unpacked in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

LEVEL = 3


def packed(text: Column, level: int = LEVEL) -> Column:
    """The text as one zstd frame; NULL for NULL."""

    @F.arrow_udf(BinaryType())
    def pack(texts: pa.Array) -> pa.Array:
        compress = zstandard.ZstdCompressor(level=level).compress  # one context for a batch
        return pa.array([None if t is None else compress(t.encode()) for t in texts.to_pylist()], pa.binary())

    return pack(text)


def unpacked(frame: Column) -> Column:
    """The text of a frame; NULL for NULL, for a frame that is broken and for one that holds no UTF-8."""

    @F.arrow_udf(StringType())
    def unpack(frames: pa.Array) -> pa.Array:
        context = zstandard.ZstdDecompressor()

        def one(z: bytes | None) -> str | None:
            try:
                return None if z is None else context.decompressobj().decompress(z).decode()
            except (zstandard.ZstdError, UnicodeDecodeError):
                return None

        return pa.array([one(z) for z in frames.to_pylist()], pa.string())

    return unpack(frame)


def with_texts(bodies: DataFrame) -> DataFrame:
    """(file_id, text) of bodies stored as frames, as text, or some so and some so."""
    if "text_zstd" not in bodies.columns:
        return bodies.select("file_id", "text")
    text = unpacked(F.col("text_zstd"))
    return bodies.select("file_id", F.coalesce(F.col("text"), text).alias("text") if "text" in bodies.columns else text.alias("text"))
