"""Command line: index trees, search them, and report.

    python -m trawl CATALOG index ROOT... | search QUERY | status PATH... | failed | duplicates | sizes
                            | verify | pending | roots | refresh PATH... | clear --yes
"""

from __future__ import annotations

import argparse
import sys

from trawl.catalog import Catalog, CatalogDrift
from trawl.engine import Engine
from trawl.model import Config
from trawl.operators import ingest, reports, search
from trawl.query import QueryError


def main(args: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="trawl", description=__doc__)
    ap.add_argument("catalog")
    sub = ap.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index")
    p.add_argument("roots", nargs="+")
    p.add_argument("--config")
    p = sub.add_parser("search")
    p.add_argument("query", nargs="+")
    p.add_argument("--fuzzy", action="store_true")
    p.add_argument("--limit", type=int, default=50)
    p.add_argument("--long", action="store_true", help="with snippets")
    p = sub.add_parser("status")
    p.add_argument("paths", nargs="+")
    p = sub.add_parser("refresh")
    p.add_argument("paths", nargs="+")
    p = sub.add_parser("clear")
    p.add_argument("--yes", action="store_true", required=True, help="the catalog is emptied")
    for name in ("failed", "duplicates", "sizes", "verify", "pending", "roots"):
        sub.add_parser(name)
    a = ap.parse_args(args)

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        catalog = Catalog(spark, a.catalog, create=a.command == "index")
    except (FileNotFoundError, CatalogDrift) as e:
        print(e, file=sys.stderr)
        return 2
    files, texts, failed = (catalog.table(t) for t in ("files", "documents_text", "failed_files"))
    if a.command == "index":
        config = Config.load(a.config) if a.config else Config()
        print(ingest.full_run(spark, catalog, Config(**{**config.__dict__, "roots": tuple(a.roots)})))
    elif a.command == "search":
        try:
            found = search.search(files, texts, " ".join(a.query), a.limit + 1, fuzzy=a.fuzzy)
        except QueryError as e:
            print(e, file=sys.stderr)
            return 2
        rows = (search.with_snippets(found, texts, " ".join(a.query)) if a.long else found).collect()
        for r in sorted(rows, key=lambda r: (r.rank, r.name, r.path))[: a.limit]:
            print(f"{r.rank:.3f}\t{r.path}")
            if a.long and r.snippet and r.snippet.window is not None:
                print("\t" + render(r.snippet))
        print(f"{min(len(rows), a.limit)}{'+' if len(rows) > a.limit else ''} hits")
    elif a.command == "status":
        paths = spark.createDataFrame([(p,) for p in a.paths], "path string")
        reports.status_of_paths(paths, files, failed).show(truncate=False)
    elif a.command == "failed":
        reports.failures(files, failed, 1000).show(1000, truncate=False)
    elif a.command == "duplicates":
        reports.duplicate_groups(files, 500).show(500, truncate=False)
    elif a.command == "verify":
        reports.verify_on_disk(files).filter("verdict != 'identical'").show(1000, truncate=False)
    elif a.command == "pending":
        reports.page_by_id(files, 0, 1000).show(1000, truncate=False)
    elif a.command == "roots":  # as the last full run counted them
        for k, v in sorted(catalog.meta().items()):
            if k.startswith("root."):
                print(f"{k[5:]}\t{v}")
    elif a.command == "refresh":
        print(Engine(spark, a.catalog).refresh(a.paths))
    elif a.command == "clear":
        Engine(spark, a.catalog).clear()
    else:
        reports.size_breakdown(files, texts).show(truncate=False)
    return 0


def render(snippet, bold: tuple[str, str] = ("", "")) -> str:
    """A snippet on one line, ellipses where it is cut, matches between the marks of `bold`."""
    data, out, at = snippet.window.encode(), [], 0
    for r in snippet.ranges:
        out += [data[at : r.start], bold[0].encode(), data[r.start : r.end], bold[1].encode()]
        at = r.end
    text = b"".join([*out, data[at:]]).decode("utf-8", "replace")
    text = " ".join(text.split())
    return ("…" if snippet.truncated_start else "") + text + ("…" if snippet.truncated_end else "")


if __name__ == "__main__":
    sys.exit(main())
