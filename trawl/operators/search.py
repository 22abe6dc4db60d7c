"""Ranked search: eleven tiers over names, bodies and paths.

Names and paths are ranked where the catalog is read, bodies are searched where they are
read; neither is shuffled. Only a row of counts per body that matched meets the catalog, by
an inner join, and of the hits of a file the best is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions import kernels
from trawl.functions.text import ascii_fold, ascii_lower, count_fraction, ignored
from trawl.model import Outcome
from trawl.query import Query, parse
from trawl.runtime import spill

DEFAULT_LIMIT = 1000
FLOOR = 3  # shorter terms, in characters, are looked for in names only
_KEPT = ("id", "name", "path", "parent", "size", "mtime")
_FIELDS = {"rank": "rank", "name": "name", "path": "path", "size": "size", "modified": "mtime", "mtime": "mtime"}


def _no_hits(files: DataFrame) -> DataFrame:
    return files.filter("false").select(
        F.col("id").alias("file_id"), "name", "path", "size", "mtime", F.lit(0.0).alias("rank"),
        F.lit(0).alias("stage"), F.lit("").alias("match_field"),
    )


def hits(
    files: DataFrame,
    texts: DataFrame | None,
    query: Query | str,
    fuzzy: bool = False,
    max_edits: int = 2,
    ignore: Sequence[str] = (),
    grams: DataFrame | None = None,
) -> DataFrame:
    """All files that match, with rank and stage; not ordered.

    Filters and ignore patterns apply before anything else and reach the scan. Bodies are
    read only if the term is long enough to be looked for in them. `grams` (gram, file_id),
    an index of all bodies, spares bodies it rules out and finds files whose body is indexed
    but not stored; these rank last in tier 6. Ids are taken to be unique.
    """
    query = parse(query) if isinstance(query, str) else query
    if query.empty:
        return _no_hits(files)
    rows = files
    for f in query.filters:
        rows = rows.filter(f)
    if ignore:
        rows = rows.filter(~ignored(F.col("path"), list(ignore)))
    if query.pattern.empty:
        return _regex_only(rows, texts, query)
    p = query.pattern
    term = ascii_lower(query.term)
    budget = kernels.edit_budget(len(term.encode()), max_edits) if fuzzy and p.literal is not None else None
    long_enough = p.chars >= FLOOR
    none = [F.lit(None).cast("int").alias(c) for c in ("__same", "__any", "__near")]
    found = _ranked(rows.select("*", *none, F.lit(None).cast("boolean").alias("__rx")), p, term, budget, query, False)
    more = []
    if texts is not None:
        if grams is not None and long_enough and budget is None and query.regex is None:
            texts = _pruned(texts, grams, p.segments)
        bodies = _body_hits(texts, p, term, budget, query)
        if bodies is not None:
            more.append(_ranked(rows.join(bodies, "id"), p, term, budget, query, True))
    if grams is not None and long_enough:
        unstored = _indexed(grams, p.segments)
        if texts is not None:
            unstored = unstored.join(texts.filter("text is not null").select(F.col("file_id").alias("id")), "id", "left_anti")
        last = rows.join(unstored, "id")
        if query.regex is not None:
            last = last.filter(kernels.re2_match(F.col("path"), query.regex.pattern))
        more.append(last.withColumn("__hit", _first([(6, F.lit(True), F.lit(6.999))])))
    return _finish(found, *more)


def _ranked(rows: DataFrame, p, term: str, budget: int | None, query: Query, body: bool) -> DataFrame:
    """rows with `__hit`, the rank and stage of the first tier that accepts each.

    With `body` they are files whose body may count (see _body_hits), else any, judged by
    name and path alone.
    """
    long_enough = p.chars >= FLOOR
    if not body:
        # What any accepted row must meet, cheap and before the rank.
        may = p.holds_all(F.col("path")) | p.holds_all(F.col("name"))
        if budget is not None:
            may = may | kernels.may_be_near(F.col("name"), term, budget) | kernels.may_be_near(F.col("path"), term, budget)
        rows = rows.filter(may)
    if query.regex is not None:
        fits = kernels.re2_match(F.col("path"), query.regex.pattern)
        rows = rows.filter(F.coalesce("__rx", F.lit(False)) | fits)
    tiers = _name_tiers(p)
    if long_enough and body:
        tiers += [
            (5, F.col("__same") > 0, F.lit(5.0) + count_fraction(F.col("__same"))),
            (6, F.col("__any") > 0, F.lit(6.0) + count_fraction(F.col("__any"))),
        ]
    exact = _first(tiers)
    if budget is None:
        return rows.withColumn("__hit", F.coalesce(exact, _first(_path_tiers(p))))

    # Only rows no exact tier took go through the fuzzy kernels: the others hand over NULL.
    rows = rows.withColumn("__exact", exact)
    left = F.col("__exact").isNull()
    near = {c: F.when(left & kernels.may_be_near(F.col(c), term, budget), F.col(c)) for c in ("name", "path")}
    rows = rows.select(
        "*",
        kernels.best_distance(near["name"], term, budget).alias("__dn"),
        (kernels.best_distance(near["path"], term, budget) if long_enough else F.lit(None).cast("int")).alias("__dp"),
    )
    hit = F.coalesce(
        F.col("__exact"),
        _first([(7, F.col("__dn").isNotNull(), F.lit(7.0) + F.lit(0.1) * F.col("__dn"))]),
        _first([(8, F.col("__near") > 0, F.lit(8.0) + count_fraction(F.col("__near")))]),
        _first(_path_tiers(p)),
        _first([(11, F.col("__dp").isNotNull(), F.lit(11.0) + F.lit(0.1) * F.col("__dp"))]),
    )
    return rows.withColumn("__hit", hit)


def _pruned(texts: DataFrame, grams: DataFrame, segments: Sequence[str], most: int = 1_000_000) -> DataFrame:
    """Bodies the trigram index allows; all of them if it allows more than `most`, which are not sent out."""
    ids = spill(_indexed(grams, segments).select(F.col("id").alias("file_id")))
    return texts.join(F.broadcast(ids), "file_id", "left_semi") if ids.count() <= most else texts


def _body_hits(texts: DataFrame, p, term: str, budget: int | None, query: Query) -> DataFrame | None:
    """(id, __same, __any, __near, __rx): of each body that may count, how often it holds the term.

    The text itself stays behind. Scanned once, filtered where it is read; None if the term
    is too short to be looked for in bodies and nothing else asks for them.
    """
    text = F.col("text")
    long_enough = p.chars >= FLOOR
    if not long_enough and budget is None and query.regex is None:
        return None
    rows = texts.filter("text is not null").select(F.col("file_id").alias("id"), "text")
    none = F.lit(None).cast("int")
    inside = p.inside(text, True) if long_enough else F.lit(False)
    close = kernels.may_be_near(text, term, budget) if budget is not None else F.lit(False)
    if query.regex is not None:
        # A file counts if the expression fits its path too, so bodies that hold the term stay.
        rows = rows.withColumn("__rx", kernels.re2_match(text, query.regex.pattern)).filter(F.col("__rx") | inside | close)
    else:
        rows = rows.filter(inside | close).withColumn("__rx", F.lit(False))
    return rows.select(
        "id",
        (F.when(p.inside(text, False), p.count(text, False)) if long_enough else none).alias("__same"),
        (F.when(inside, p.count(text, True)) if long_enough else none).alias("__any"),
        (kernels.fuzzy_count(F.when(~inside & close, text), term, budget) if budget is not None else none).alias("__near"),
        "__rx",
    )


def _first(tiers: list[tuple[int, Column, Column]]) -> Column:
    """The rank and stage of the first tier that accepts the row, NULL if none does."""
    out = F.lit(None).cast("struct<rank:double,stage:int>")
    for stage, accepts, rank in reversed(tiers):
        one = F.struct(rank.cast("double").alias("rank"), F.lit(stage).alias("stage"))
        out = F.when(F.coalesce(accepts, F.lit(False)), one).otherwise(out)
    return out


def _name_tiers(p) -> list:
    name = F.col("name")
    return [
        (1, p.whole(name, False), F.lit(1.0)),
        (2, p.whole(name, True), F.lit(2.0)),
        (3, p.inside(name, False), F.lit(3.0)),
        (4, p.holds_all(name) & p.inside(name, True), F.lit(4.0)),
    ]


def _path_tiers(p) -> list:
    if p.chars < FLOOR:
        return []
    path = F.col("path")
    return [(9, p.inside(path, False), F.lit(9.0)), (10, p.holds_all(path) & p.inside(path, True), F.lit(10.0))]


def _regex_only(rows: DataFrame, texts: DataFrame | None, query: Query) -> DataFrame:
    pattern = query.regex.pattern
    name, path = (kernels.re2_match(F.col(c), pattern) for c in ("name", "path"))
    own = rows.select("*", name.alias("__n"), path.alias("__p")).withColumn(
        "__hit", _first([(4, F.col("__n"), F.lit(4.0)), (10, F.col("__p"), F.lit(10.0))])
    )
    if texts is None:
        return _finish(own)
    counted = texts.select(F.col("file_id").alias("id"), kernels.re2_count(F.col("text"), pattern).alias("__b")).filter("__b > 0")
    inside = rows.join(counted, "id").withColumn("__hit", _first([(6, F.lit(True), F.lit(6.0) + count_fraction(F.col("__b")))]))
    return _finish(own, inside)


def _finish(rows: DataFrame, *more: DataFrame) -> DataFrame:
    """The hits of all frames, of each file the best. A generator keeps rows with a hit rather than
    a filter: a filter on the rank would be pushed below it, and rank and kernels computed twice."""
    hit = F.explode(F.filter(F.array("__hit"), lambda h: h.isNotNull())).alias("h")
    out, *rest = (r.select("id", "name", "path", "size", "mtime", hit) for r in (rows, *more))
    if rest:
        for r in rest:
            out = out.unionByName(r)
        best = out.groupBy("id").agg(F.min(F.struct("h", "name", "path", "size", "mtime")).alias("b"))
        out = best.select("id", "b.name", "b.path", "b.size", "b.mtime", "b.h")
    stage = F.col("h.stage")
    field = F.when(stage.isin(1, 2, 3, 4, 7), "name").when(stage.isin(5, 6, 8), "contents").otherwise("path")
    return out.select(
        F.col("id").alias("file_id"), "name", "path", "size", "mtime",
        F.col("h.rank").alias("rank"), stage.alias("stage"), field.alias("match_field"),
    )


def search(files: DataFrame, texts: DataFrame | None, query: Query | str, limit: int = DEFAULT_LIMIT, **options) -> DataFrame:
    """The best `limit` hits by rank, name, path: a top-k, not a sort of everything."""
    return hits(files, texts, query, **options).orderBy("rank", "name", "path").limit(limit)


def run(files: DataFrame, texts: DataFrame | None, query: str, limit: int = DEFAULT_LIMIT, **options):
    """(rows, outcome): what a caller shows. One row beyond the limit tells whether there are more."""
    got = search(files, texts, query, limit + 1, **options).collect()
    return got[:limit], Outcome(min(len(got), limit), len(got) > limit)


def resort(found: DataFrame, by: str = "rank", descending: bool = False) -> DataFrame:
    """Hits in another order; the path decides ties. Unknown columns fall back to the rank."""
    col = F.col(_FIELDS.get(by.lower(), "rank"))
    return found.orderBy(col.desc() if descending else col.asc(), F.col("path").asc())


def with_snippets(
    found: DataFrame, texts: DataFrame | None, query: Query | str, max_edits: int = 2, budget: int = 600, page: int = 100_000
) -> DataFrame:
    """The top hits with a snippet of what matched; NULL where the body isn't stored.

    Up to `page` hits are sent to where bodies are read and pick theirs; beyond that both
    sides meet by key.
    """
    query = parse(query) if isinstance(query, str) else query
    p = query.pattern
    k = kernels.edit_budget(len(ascii_lower(query.term).encode()), max_edits) if p.literal is not None else None
    import re

    if p.empty:
        exact = folded = re.compile(query.regex.source, re.I | re.M) if query.regex else None
    else:
        exact, folded = p.python(False), p.python(True)
    rows = found
    if texts is not None:
        rows = spill(found)
        wanted = rows.filter("match_field = 'contents'").select("file_id")
        wanted = F.broadcast(wanted) if wanted.count() <= page else wanted
        rows = rows.join(texts.select("file_id", "text").join(wanted, "file_id", "left_semi"), "file_id", "left")
    else:
        rows = found.withColumn("text", F.lit(None).cast("string"))
    source = F.when(F.col("match_field") == "name", F.col("name")).when(F.col("match_field") == "path", F.col("path")).otherwise(F.col("text"))
    return rows.withColumn("snippet", kernels.snippets(source, F.col("stage"), query.term, exact, folded, k, budget)).drop("text")


def trigram_index(texts: DataFrame, text: str = "text") -> DataFrame:
    """(gram, file_id): the distinct trigrams of every body, ASCII case and accents apart left as they are."""
    # A look-ahead takes every place once; folding once before keeps it linear in the text.
    grams = F.regexp_extract_all(ascii_fold(text), F.lit("(?s)(?=(...))"), F.lit(1))
    return texts.filter(F.length(text) >= 3).select("file_id", F.explode(F.array_distinct(grams)).alias("gram")).select("gram", "file_id")


def _indexed(grams: DataFrame, segments: Sequence[str]) -> DataFrame:
    """Ids whose index holds every trigram of the literal pieces."""
    wanted = sorted({ascii_lower(s)[i : i + 3] for s in segments for i in range(len(s) - 2)})
    found = grams.filter(F.col("gram").isin(*wanted)).groupBy(F.col("file_id").alias("id")).agg(F.count_distinct("gram").alias("n"))
    return found.filter(F.col("n") == len(wanted)).select("id", F.lit(1).alias("__indexed"))
