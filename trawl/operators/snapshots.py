"""What changed between consecutive full deliveries of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = "18446744073709551616"  # 2^64
_HALF = "9223372036854775808"  # 2^63


def row_hash(cols: Sequence[str]) -> Column:
    """64-bit hash of values and of which of them are NULL (xxhash64 alone skips NULLs)."""
    parts = []
    for c in cols:
        parts += [F.col(c).isNull().cast("int"), F.col(c)]
    return F.xxhash64(*parts)


def snapshot_changes(
    df: DataFrame,
    snap: str = "snap_no",
    key: str = "path",
    loaded: str = "loaded_at",
    values: Sequence[str] = ("mtime", "size"),
) -> DataFrame:
    """(snap, key, change_kind) from each snapshot to the next one that exists.

    Every row goes out once per comparison it takes part in, tagged with its side; one
    aggregation shuffle on (comparison, key) finds the row that holds on either side and
    classifies by the two row hashes. Within a snapshot the row with the latest `loaded`
    holds; rows without a load time come before all others, and equal load times are
    decided by the larger row hash. The pair (load time, hash) travels as one decimal,
    so the aggregate stays a fixed-width hash aggregate with map-side combine: repeated
    keys, however hot, shrink before the shuffle.

    NULL equals NULL and differs from any value. Rows with a NULL key or snapshot number
    belong to no record and are left out. An empty table, or a single snapshot, has no
    changes. Further columns, whatever their names, are not read.
    Two different rows hash alike with probability 2^-64.
    """
    rows = df.select(
        F.col(snap).alias("__snap"),
        F.col(key).alias("__key"),
        F.coalesce(F.unix_micros(F.col(loaded).cast("timestamp")), F.lit(-(10**17))).alias("__at"),
        row_hash(values).alias("__h"),
    ).filter("__snap is not null and __key is not null")

    # One number per delivery: as many rows as snapshots were delivered, not as they have rows.
    numbers = sorted(r[0] for r in df.select(snap).filter(F.col(snap).isNotNull()).distinct().collect())
    follows = {a: b for a, b in zip(numbers, numbers[1:])}
    if not follows:
        kind = df.schema[snap].dataType.simpleString()
        return rows.filter("false").select(
            F.col("__snap").cast(kind).alias(snap), F.col("__key").alias(key), F.lit("").alias("change_kind")
        )
    pairs = F.create_map(*[F.lit(x) for ab in follows.items() for x in ab])

    sides = F.array(
        F.struct(F.when(F.col("__snap") > F.lit(numbers[0]), F.col("__snap")).alias("to"), F.lit(True).alias("new")),
        F.struct(F.try_element_at(pairs, F.col("__snap")).alias("to"), F.lit(False).alias("new")),
    )
    span, half = F.lit(_SPAN).cast("decimal(20,0)"), F.lit(_HALF).cast("decimal(19,0)")
    held = F.col("__at").cast("decimal(18,0)") * span + F.col("__h").cast("decimal(19,0)") + half
    tagged = (
        rows.select("__key", held.cast("decimal(38,0)").alias("__held"), F.explode(sides).alias("__s"))
        .filter("__s.to is not null")
        .select("__key", "__held", F.col("__s.to").alias("__to"), F.col("__s.new").alias("__new"))
    )
    both = tagged.groupBy("__to", "__key").agg(
        F.max(F.when(F.col("__new"), F.col("__held"))).alias("__n"),
        F.max(F.when(~F.col("__new"), F.col("__held"))).alias("__o"),
    )
    n, o = F.pmod(F.col("__n"), span), F.pmod(F.col("__o"), span)
    kind = (
        F.when(F.col("__o").isNull(), "added")
        .when(F.col("__n").isNull(), "removed")
        .when(n != o, "changed")
    )
    return both.select(F.col("__to").alias(snap), F.col("__key").alias(key), kind.alias("change_kind")).filter(
        F.col("change_kind").isNotNull()
    )
