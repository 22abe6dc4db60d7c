"""One surviving record per group of copies: a latent two-sided truth model over the sources."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.runtime import cut

NO_ROOT = "(no root)"


def claims_of(df: DataFrame, entity: str, source: str, value: str, field: str | None = None) -> DataFrame:
    """(e, f, v, pattern): what each source that covers the entity says of the value (of the field).

    The pattern is a list of (source, said) over all sources with a row in the entity, said
    being whether the source gave the value at least once. Rows are reduced to distinct
    triples before they meet, so a group holding a third of all rows is combined where it
    is read; what one entity gathers is bounded by its number of sources, not of rows.
    """
    of = F.lit("") if field is None else F.col(field)
    rows = df.select(F.col(entity).alias("e"), of.alias("f"), F.col(source).alias("s"), F.col(value).alias("v")).filter("e is not null")
    told = rows.filter("v is not null").groupBy("e", "f", "v").agg(F.collect_set("s").alias("said"))
    covering = rows.groupBy("e").agg(F.array_sort(F.collect_set("s")).alias("covering"))
    pattern = F.transform("covering", lambda s: F.struct(s.alias("s"), F.array_contains("said", s).alias("said")))
    return told.join(covering, "e").select("e", "f", "v", pattern.alias("pattern"))


@dataclass(frozen=True)
class Quality:
    """By (field, source): how often it gives a true value, how often it leaves out a false one; by field: how often one is true."""

    sensitivity: dict[tuple[str, str], float]
    specificity: dict[tuple[str, str], float]
    prior: dict[str, float]

    def log_odds(self) -> Column:
        """Of a claim (f, pattern): the log odds that the value is true."""
        if not self.sensitivity:
            return F.lit(0.0)
        key = lambda f, s: f"{f}\0{s}"
        table = lambda of: F.create_map(*[F.lit(x) for f, s in self.sensitivity for x in (key(f, s), of((f, s)))])
        yes, no = table(self._yes), table(self._no)
        start = F.create_map(*[F.lit(x) for f, p in self.prior.items() for x in (f, math.log(p / (1 - p)))])
        at = lambda x: F.concat("f", F.lit("\0"), x["s"])
        return F.aggregate("pattern", start[F.col("f")], lambda acc, x: acc + F.when(x["said"], yes[at(x)]).otherwise(no[at(x)]))

    def truth(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))

    def _yes(self, s: tuple[str, str]) -> float:
        return math.log(self.sensitivity[s] / (1 - self.specificity[s]))

    def _no(self, s: tuple[str, str]) -> float:
        return math.log((1 - self.sensitivity[s]) / self.specificity[s])


def fit_quality(claims: DataFrame, rounds: int = 12, settle: float = 1e-3) -> Quality:
    """Expectation-maximisation over the claims (see claims_of), for all fields at once.

    Claims with equal patterns have equal posteriors, so they are counted once and for
    all; each round then is one aggregate over the patterns (a few thousand for the handful
    of sources there are, a table like any other if there were more), and what comes to the
    driver is one row per source and field. Beta priors (10:10 sensitivity, 90:10
    specificity, 10:10 truth) keep every figure away from 0 and 1.
    """
    patterns = cut(claims.groupBy("f", "pattern").agg(F.count("*").cast("double").alias("n")))
    sources = [(r.f, r.s) for r in patterns.select("f", F.explode("pattern.s").alias("s")).distinct().toLocalIterator()]
    quality = Quality(dict.fromkeys(sources, 0.7), dict.fromkeys(sources, 0.9), dict.fromkeys((f for f, _ in sources), 0.5))
    every = F.struct(F.lit(None).cast("string").alias("s"), F.lit(True).alias("said"))  # NULL: all claims of the field together
    for _ in range(rounds if sources else 0):
        judged = patterns.select("f", "n", quality.truth().alias("t"), F.explode(F.array_append("pattern", every)).alias("x"))
        sums = {
            (r.f, r.s): r
            for r in judged.groupBy("f", F.col("x.s").alias("s"))
            .agg(
                F.sum(F.col("n") * F.col("t")).alias("true"),
                F.sum(F.col("n") * (1 - F.col("t"))).alias("false"),
                F.sum(F.when(F.col("x.said"), F.col("n") * F.col("t")).otherwise(0.0)).alias("told_true"),
                F.sum(F.when(~F.col("x.said"), F.col("n") * (1 - F.col("t"))).otherwise(0.0)).alias("kept_false"),
            )
            .collect()
        }
        whole = {f: sums.pop((f, None)) for f in quality.prior}
        new = Quality(
            {s: (r.told_true + 10) / (r.true + 20) for s, r in sums.items()},
            {s: (r.kept_false + 90) / (r.false + 100) for s, r in sums.items()},
            {f: (r.true + 10) / (r.true + r.false + 20) for f, r in whole.items()},
        )
        moved = max(
            abs(a[s] - b[s])
            for a, b in ((new.sensitivity, quality.sensitivity), (new.specificity, quality.specificity))
            for s in sources
        )
        quality = new
        if moved < settle:
            break
    return quality


def true_values(claims: DataFrame, quality: Quality, least: float = 0.5) -> DataFrame:
    """(e, f, v, best): a row for every value judged true; if an entity has none of the field, for its likeliest.

    `best` marks the likeliest, of equal ones the longer, then the larger. Rows, not lists: how many values
    of a field are true is not bounded (a content may go by any number of names).
    """
    judged = claims.select("e", "f", "v", quality.truth().alias("truth"))
    best = judged.groupBy("e", "f").agg(F.max(F.struct("truth", F.length("v"), "v")).alias("top"))
    rows = judged.join(best, ["e", "f"]).withColumn("best", F.col("v") == F.col("top.v"))
    return rows.filter((F.col("truth") >= least) | F.col("best")).select("e", "f", "v", "best")


def with_root(files: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """files with `root` and `trust`: the longest root the path starts with, followed by '/'.

    Roots are settings, a handful of rows; they become a map that the folders above a path
    are looked up in, so nothing is shuffled. Without a root both are NULL.
    """
    listed = roots.filter("root is not null").groupBy("root").agg(F.max("trust").cast("int").alias("trust")).collect()
    none = F.lit(None)
    if not listed:
        return files.select("*", none.cast("string").alias("root"), none.cast("int").alias("trust"))
    known = F.create_map(*[F.lit(x) for r in listed for x in (r.root, r.trust)]).cast("map<string,int>")
    parts = F.split(path, "/")
    above = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(parts)), lambda n: n < F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    longest = F.try_element_at(F.filter(above, lambda a: F.map_contains_key(known, a)), F.lit(-1))
    return files.select("*", longest.alias("root"), F.try_element_at(known, longest).alias("trust"))


def _believable(meta: DataFrame) -> Column:
    """mtime lies in 1 .. last_full_index; a missing last_full_index bounds nothing."""
    until = meta.filter("key = 'last_full_index'").select(F.expr("try_cast(value as bigint)")).head()
    test = F.col("mtime") >= 1
    return test & (F.col("mtime") <= until[0]) if until and until[0] is not None else test


def _copies(files: DataFrame, roots: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Rows that may have copies, with their root as `source`; only the columns in use."""
    wanted = list(dict.fromkeys(["id", "path", "size", "mtime", "mime", "content_state", "hash", *more]))
    rows = with_root(files.select(*wanted).filter("hash is not null and size > 0 and id is not null"), roots)
    return rows.withColumn("source", F.coalesce("root", F.lit(NO_ROOT)))


def _kept(rows: DataFrame, believable: Column) -> DataFrame:
    sound = F.when(believable, F.col("mtime"))
    order = F.struct(
        (F.col("mime").isNotNull().cast("int") + F.coalesce(F.col("content_state") == 1, F.lit(False)).cast("int")).alias("a"),
        F.when(F.col("root").isNotNull(), F.coalesce("trust", F.lit(-(2**31) + 1))).otherwise(-(2**31)).alias("b"),
        F.coalesce(sound, F.lit(0)).alias("c"),
        (-F.col("id")).alias("d"),
        F.col("path").alias("p"),
    )
    kept = rows.groupBy("hash").agg(F.count("*").alias("copies"), F.max(order).alias("top"), F.max(sound).alias("newest_mtime"))
    return kept.filter("copies >= 2").select(
        "hash",
        F.lower(F.hex("hash")).alias("hash_hex"),
        (-F.col("top.d")).alias("keep_id"),
        "copies",
        F.col("top.p").alias("keep_path"),
        "newest_mtime",
    )


def surviving_files(files: DataFrame, roots: DataFrame, meta: DataFrame) -> DataFrame:
    """(hash_hex, keep_id, copies, keep_path, newest_mtime): the row to keep of each content in two places or more.

    Groups are rows with equal non-NULL hash and size > 0. The row kept is the most
    complete (mime known, content done), then the most trusted root, the latest believable
    mtime (1 .. meta.last_full_index; others come last, alike), the smallest id. It is a
    maximum, so it combines before the shuffle and no group is ever gathered.
    newest_mtime is NULL if no mtime is believable.

    NULL ids can't be kept and are left out, a NULL trust counts below any other but above
    no root, NULL mtimes are not believable. A missing last_full_index bounds nothing.
    Clashing names of further columns don't matter; an empty table gives no rows.
    """
    return _kept(_copies(files, roots), _believable(meta)).drop("hash")


def fused_values(
    files: DataFrame,
    roots: DataFrame,
    meta: DataFrame,
    fields: Sequence[str] = ("mime", "name", "path", "mtime"),
    rounds: int = 12,
    least: float = 0.5,
) -> DataFrame:
    """(hash_hex, field, value, best): every value of a field that the truth model judges true of a content.

    The sources are the roots: each has a sensitivity (how many of the true values of the
    contents it holds it gives) and a specificity (how many false ones it leaves out), per
    field, by expectation-maximisation. A field may have several true values (a content
    goes by several names, was changed at several times); all of them come out, `best`
    marking the likeliest. A path is told by one root at most, so for paths what is claimed
    of a content is the folder's last component: under which kinds of folder it belongs. Of
    mtimes only believable ones are claims.

    Values are text. Contents as in surviving_files; a field without any value in a group
    has no row there.
    """
    rows = _copies(files, roots, fields)
    sound = F.when(_believable(meta), F.col("mtime"))
    copied = rows.groupBy("hash").agg(F.count("*").alias("n")).filter("n >= 2").select("hash")
    folder = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    told = {f: {"path": folder, "mtime": sound}.get(f, F.col(f)).cast("string") for f in fields}
    rows = rows.join(copied, "hash", "left_semi").select(
        "hash", "source", F.inline(F.array(*[F.struct(F.lit(f).alias("f"), v.alias("v")) for f, v in told.items()]))
    )
    claims = cut(claims_of(rows, "hash", "source", "v", "f"))
    values = true_values(claims, fit_quality(claims, rounds), least)
    return values.select(F.lower(F.hex("e")).alias("hash_hex"), F.col("f").alias("field"), F.col("v").alias("value"), "best")


def fused_files(files: DataFrame, roots: DataFrame, meta: DataFrame, **options) -> DataFrame:
    """(hash_hex, keep_id, mime, name, folder, mtime, values): one built record per content.

    Each field has the likeliest of its true values, NULL where nobody gives one; `values`
    counts all values judged true. keep_id is the row of surviving_files.
    """
    values = fused_values(files, roots, meta, **options)
    pick = lambda f: F.max(F.when((F.col("field") == f) & F.col("best"), F.col("value")))
    built = values.groupBy("hash_hex").agg(
        pick("mime").alias("mime"), pick("name").alias("name"), pick("path").alias("folder"),
        pick("mtime").cast("long").alias("mtime"), F.count("*").alias("values"),
    )
    kept = surviving_files(files, roots, meta).select("hash_hex", "keep_id")
    return kept.join(built, "hash_hex", "left").select("hash_hex", "keep_id", "mime", "name", "folder", "mtime", F.coalesce("values", F.lit(0)).alias("values"))
