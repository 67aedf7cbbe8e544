"""Command line: python -m pagestrata COMMAND PAGES [...], PAGES being a parquet table of page snapshots."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from pagestrata.operators import checks, graph, scoring, surface
from pagestrata.runtime import session, written
from pagestrata.sources import sitemaps
from pagestrata.sources.snapshots import audit_pages

COMMANDS = {
    "score": "health score of each crawl", "summary": "totals of each crawl", "answer": "score, totals, worst pages and categories of each crawl", "issues": "findings of one crawl",
    "inspect": "findings of one address", "compare": "what changed between two crawls", "crawls": "stored crawls, newest first (PAGES is the table of crawls)", "links": "most linked pages",
    "sitemap": "write XML sitemaps", "csv": "write the flat export", "json": "write pages as JSON lines",
}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pagestrata", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in COMMANDS.items():
        sub = commands.add_parser(name, help=text)
        sub.add_argument("pages")
        if name in ("sitemap", "csv", "json"):
            sub.add_argument("folder")
        if name in ("issues", "inspect"):
            sub.add_argument("--crawl", type=int, required=True)
        if name == "issues":
            sub.add_argument("--pattern")
            sub.add_argument("--category")
            sub.add_argument("--severity")
            sub.add_argument("--page", type=int, default=1)
        if name == "inspect":
            sub.add_argument("--url", required=True)
        if name == "compare":
            sub.add_argument("--baseline", type=int, required=True)
            sub.add_argument("--current", type=int, required=True)
        if name == "links":
            sub.add_argument("--top", type=int, default=15)
        if name == "crawls":
            sub.add_argument("--domain")
            sub.add_argument("--limit", type=int, default=20)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = session()
    given = spark.read.parquet(args.pages)
    if args.command == "crawls":
        surface.list_crawls(given, args.domain, args.limit).show(200, truncate=False)
        return
    # Of the crawls, only those that are asked for are read.
    wanted = [x for x in (getattr(args, name, None) for name in ("crawl", "baseline", "current")) if x is not None]
    pages = audit_pages(given.where(F.col("crawl_id").isin(wanted)) if wanted else given)
    if args.command == "summary":
        scoring.crawl_summary(pages).orderBy("crawl_id").show(1000, truncate=False)
    elif args.command == "sitemap":
        sitemaps.write(pages, args.folder)
    elif args.command == "csv":
        surface.write_csv(pages, args.folder)
    elif args.command == "json":
        surface.write_json(pages, args.folder)
    elif args.command == "links":
        graph.degrees(*graph.graph(pages)).orderBy(F.col("in_degree").desc(), "node").show(args.top, truncate=False)
    else:
        pages = written(pages.drop("body_text"), "audit-pages")
        found = written(checks.page_issues(pages), "audit-issues")
        if args.command == "score":
            scoring.health_score(pages, found).orderBy("crawl_id").show(1000, truncate=False)
        elif args.command == "answer":
            surface.crawl_answer(pages, found).orderBy("crawl_id").show(1000, truncate=False)
        elif args.command == "inspect":
            surface.inspect(pages, found, args.url).orderBy("category", "check").show(1000, truncate=False)
        elif args.command == "compare":
            of = lambda df, crawl: df.where(F.col("crawl_id") == crawl)
            surface.compare(of(pages, args.baseline), of(found, args.baseline), of(pages, args.current), of(found, args.current)).orderBy("change", "url_key", "check").show(1000, truncate=False)
        else:
            query = surface.Query(args.crawl, url_pattern=args.pattern, category=args.category, severity=args.severity, page=args.page)
            surface.query(pages, found, query).show(1000, truncate=False)


if __name__ == "__main__":
    main()
