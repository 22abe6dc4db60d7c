"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from trawl.runtime import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """The tokenizer of a rank file, once per process."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[vocabulary] = tiktoken.Encoding(
            os.path.basename(vocabulary), pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _encoders[vocabulary]


def n_tokens(text, vocabulary: str = VOCABULARY):
    """Column: tokens of the whole text; 0 for NULL and ''."""

    @F.pandas_udf(LongType())
    def count(batch: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary).encode_ordinary
        for texts in batch:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def sainte_lague(weights: Mapping, seats: int, caps: Mapping | None = None) -> dict:
    """Seats by highest quotients w / (2k + 1), never above a cap; ties go to the smaller key.

    Quotas that are certain are given at once (a source gets round(w / d) seats for some
    common d), the rest by a heap, so the work doesn't grow with the number of seats.
    """
    live = {k: w for k, w in sorted(weights.items()) if w > 0 and (caps is None or caps[k] > 0)}
    got = dict.fromkeys(sorted(weights), 0)
    if not live or seats <= 0:
        return got
    cap = (lambda k: caps[k]) if caps is not None else (lambda k: seats)
    seats = min(seats, sum(cap(k) for k in live))
    lo, hi = 0.0, 2.0 * (seats + len(live)) / min(live.values())
    for _ in range(200):  # the largest multiplier that gives away no more than there is
        mid = (lo + hi) / 2
        if sum(min(cap(k), int(w * mid + 0.5)) for k, w in live.items()) <= seats:
            lo = mid
        else:
            hi = mid
    for k, w in live.items():
        got[k] = max(0, min(cap(k), int(w * lo + 0.5) - 1))
    heap = [(-w / (2 * got[k] + 1), k) for k, w in live.items() if got[k] < cap(k)]
    heapq.heapify(heap)
    left = seats - sum(got.values())
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        got[k] += 1
        left -= 1
        if got[k] < cap(k):
            heapq.heappush(heap, (-live[k] / (2 * got[k] + 1), k))
    return got


def shard_quotas(shards: DataFrame, quotas: DataFrame, block_tokens: int, grid: int = 32, left_over: int = 10_000) -> DataFrame:
    """(mix_name, source, shard, tokens, max_repeats, blocks): a source's blocks apportioned to its shards, Sainte-Lague.

    `shards` has (source, shard, tokens), `quotas` (mix_name, source, quota, max_repeats),
    as many rows as sources in mixes. The divisor at which the rounded quotients give the
    quota is closed in on by counting at `grid` divisors at once, for all mixes and sources
    in one aggregate; what comes to the driver is a count per divisor and source of a mix.
    Once no more than `left_over` seats lie between the ends of a bracket these go by
    highest quotient, ties to the smaller shard; the result is the same for any bracket.
    """
    spark = shards.sparkSession
    rows = shards.join(F.broadcast(quotas), "source")
    rows = cut(rows.withColumn("cap", F.ceil(F.col("tokens") * F.col("max_repeats") / block_tokens)))
    seats = lambda d: F.least(F.col("cap"), F.floor(F.col("tokens") / d + 0.5))
    whole = rows.groupBy("mix_name", "source", "quota").agg(F.sum("cap").alias("caps"), F.max("tokens").alias("top")).collect()
    quota = {(r.mix_name, r.source): r.quota for r in whole}
    # (divisor, seats at it): 0 stands for all caps, and beyond twice the largest shard there is no seat.
    bracket = {(r.mix_name, r.source): ((0.0, r.caps), (2.0 * r.top + 1.0, 0)) for r in whole}
    for k in range(12):
        wide = {key: b for key, b in bracket.items() if b[0][1] - b[1][1] > left_over}
        if not wide:
            break
        at = {}
        for key, ((lo, _), (hi, _)) in wide.items():
            # Over orders of magnitude at first, then evenly.
            at[key] = [hi * 10.0 ** (-12 * (1 - i / grid)) if k == 0 else lo + (hi - lo) * (i / grid) for i in range(1, grid)]
        tried = spark.createDataFrame([(*key, d) for key, ds in at.items() for d in ds], "mix_name string, source string, d double")
        found = rows.join(F.broadcast(tried), ["mix_name", "source"]).groupBy("mix_name", "source", "d").agg(F.sum(seats(F.col("d"))).alias("n"))
        counts: dict[tuple, list] = {}
        for r in found.collect():
            counts.setdefault((r.mix_name, r.source), []).append((r.d, r.n))
        for key, of in counts.items():  # fewer seats the larger the divisor
            lo, hi = bracket[key]
            bracket[key] = (
                max((x for x in of if x[1] > quota[key]), default=lo),
                min((x for x in of if x[1] <= quota[key]), default=hi),
            )
    ends = [(*key, lo, hi, quota[key] - n) for key, ((lo, _), (hi, n)) in bracket.items()]
    ends = spark.createDataFrame(ends, "mix_name string, source string, lo double, hi double, left long")
    most = F.when(F.col("lo") > 0, seats(F.col("lo"))).otherwise(F.col("cap"))
    rows = rows.join(F.broadcast(ends), ["mix_name", "source"])
    rows = cut(rows.select("mix_name", "source", "shard", "tokens", "max_repeats", "left", seats(F.col("hi")).alias("sure"), most.alias("most")))
    more = rows.filter("most > sure").select("mix_name", "source", "shard", "tokens", "left", F.explode(F.sequence(F.col("sure") + 1, F.col("most"))).alias("seat"))
    first = Window.partitionBy("mix_name", "source").orderBy(F.desc(F.col("tokens") / (2 * F.col("seat") - 1)), "shard", "seat")
    more = more.withColumn("n", F.row_number().over(first)).filter("n <= left").groupBy("mix_name", "source", "shard").agg(F.count("*").alias("more"))
    blocks = F.col("sure") + F.coalesce("more", F.lit(0))
    return rows.join(more, ["mix_name", "source", "shard"], "left").select(
        "mix_name", "source", "shard", "tokens", "max_repeats", blocks.alias("blocks")
    )


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    seed: int = 17,
    block_tokens: int = 512,
    shard_tokens: int = 1_000_000,
    total_tokens: int | None = None,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(mix_name, doc_id, source, n_tokens, repeats): how often each document is used.

    Sizes are tokens of whole texts. Documents of a source are dealt into shards of about
    `shard_tokens` by a seeded hash; inside a shard they stand in seeded order, and every
    `block_tokens` of them form a block. Blocks are apportioned to sources by Sainte-Lague
    over the weights, capped at max_repeats times what the source has, then to the shards
    of the source in the same way (see shard_quotas); of each shard whole rounds repeat
    everything, and the rest of its quota picks blocks by a seeded hash. Without
    `total_tokens` a mix is made as large as the scarcest source allows at its weight. What
    comes to the driver is per source of a mix, never per shard or document.

    A document goes with the block it begins in and is used at most max_repeats times.
    Sources without documents, with weight NULL or <= 0, or with max_repeats NULL or < 1
    get nothing, the others share by weight. Empty and NULL texts have no tokens and are
    left out, as are NULL ids and sources in no mix. Repeated target rows of a source add
    their weights under the smallest max_repeats.
    """
    wanted = (
        targets.filter("mix_name is not null and source is not null and weight > 0 and max_repeats >= 1")
        .groupBy("mix_name", "source")
        .agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    )
    sized = docs.filter("doc_id is not null and text != ''").join(wanted.select("source").distinct(), "source", "left_semi")
    sized = cut(sized.select("doc_id", "source", n_tokens("text", vocabulary).alias("n_tokens")).filter("n_tokens > 0"))

    tokens = {r.source: r.tokens for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}
    mixes: dict[str, dict[str, tuple[float, int]]] = {}
    for r in wanted.collect():
        if r.source in tokens:
            mixes.setdefault(r.mix_name, {})[r.source] = (r.weight, r.max_repeats)
    spark = sized.sparkSession
    if not mixes:
        return spark.createDataFrame([], "mix_name string, doc_id long, source string, n_tokens long, repeats int")
    given = []
    for name, parts in sorted(mixes.items()):
        weights = {s: w for s, (w, _) in parts.items()}
        caps = {s: -(-tokens[s] * m // block_tokens) for s, (_, m) in parts.items()}
        whole = sum(weights.values())
        most = min(tokens[s] * m * whole / weights[s] for s, (_, m) in parts.items())
        seats = int((most if total_tokens is None else total_tokens) // block_tokens)
        given += [(name, s, q, parts[s][1]) for s, q in sainte_lague(weights, seats, caps).items()]
    quotas = spark.createDataFrame(given, "mix_name string, source string, quota long, max_repeats int")

    shards = {s: max(1, round(t / shard_tokens)) for s, t in tokens.items()}
    n_shards = F.create_map(*[F.lit(x) for kv in shards.items() for x in kv])[F.col("source")]
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), n_shards))
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    before = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    blocks = cut(dealt.withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / block_tokens)))

    supply = cut(blocks.groupBy("source", "shard").agg(F.sum("n_tokens").alias("tokens")))
    own = F.col("blocks") * block_tokens
    plan = shard_quotas(supply, quotas, block_tokens).select(
        "mix_name", "source", "shard", "max_repeats", F.floor(own / F.col("tokens")).cast("int").alias("rounds"), (own % F.col("tokens")).cast("double").alias("rest")
    )
    # Blocks in seeded order until the rest of the quota is filled.
    sizes = blocks.groupBy("source", "shard", "block").agg(F.sum("n_tokens").alias("size"))
    pick = Window.partitionBy("source", "shard").orderBy(F.xxhash64("source", "shard", "block", F.lit(seed + 2)), "block")
    upto = sizes.withColumn("upto", F.sum("size").over(pick.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = blocks.join(upto.drop("size").withColumnRenamed("upto", "__upto"), ["source", "shard", "block"]).join(
        plan, ["source", "shard"]
    )
    block_size = F.lit(block_tokens / 2)
    repeats = F.least(
        F.col("max_repeats"), F.col("rounds") + F.when(F.col("__upto") <= F.col("rest") + block_size, 1).otherwise(0)
    )
    return chosen.select("mix_name", "doc_id", "source", "n_tokens", repeats.cast("int").alias("repeats")).filter(
        "repeats > 0"
    )


def mix_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, share, tokens, docs, max_used): what a mix came to."""
    got = mix.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"),
        F.count("*").alias("docs"),
        F.max("repeats").alias("max_used"),
    )
    aim = targets.groupBy("mix_name", "source").agg(F.sum("weight").alias("weight"))
    every = Window.partitionBy("mix_name")
    return (
        aim.join(got, ["mix_name", "source"], "left")
        .withColumn("target_share", F.col("weight") / F.sum("weight").over(every))
        .withColumn("share", F.coalesce(F.col("tokens") / F.sum("tokens").over(every), F.lit(0.0)))
        .select(
            "mix_name",
            "source",
            "target_share",
            "share",
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("docs", F.lit(0)).alias("docs"),
            F.coalesce("max_used", F.lit(0)).alias("max_used"),
        )
    )
