"""SQL surface: temporary views over audited pages, and functions for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.functions.urls import norm, resolve
from pagestrata.operators import checks, graph
from pagestrata.runtime import ship
from pagestrata.sources.html import parse_html
from pagestrata.sources.robots import is_allowed

c = F.col


class ParsedPage:
    """Table function: parse_page(html, url) gives a page's main fields as one row."""

    def eval(self, html: str, url: str):
        p = parse_html(html or "", url)
        yield p["title"], p["meta_description"], p["canonical"], p["word_count"], p["body_text"], [x["url"] for x in p["internal_links"]], [x["url"] for x in p["external_links"]]


def register(spark: SparkSession, pages: DataFrame) -> list[str]:
    """Create the views pages, links, images, headings, hreflang, scripts, issues, nodes and edges, and the SQL
    functions norm_url, resolve_url, robots_allow and parse_page. Returns the views' names."""
    parts = {"images": "images", "headings": "headings", "hreflang": "hreflang_tags", "scripts": "scripts"}
    views = {"pages": pages, "issues": checks.page_issues(pages)}
    for name, column in parts.items():
        exploded = pages.select("crawl_id", "page_id", c("url").alias("page_url"), F.posexplode(column).alias("pos", "x"))
        views[name] = exploded.select("crawl_id", "page_id", "page_url", "pos", "x.*")
    both = [pages.select("crawl_id", "page_id", c("url").alias("page_url"), F.lit(kind).alias("kind"), F.posexplode(f"{kind}_links").alias("pos", "x")) for kind in ("internal", "external")]
    views["links"] = both[0].unionByName(both[1]).select("crawl_id", "page_id", "page_url", "kind", "pos", "x.*")
    views["nodes"], views["edges"] = graph.graph(pages)
    for name, view in views.items():
        view.createOrReplaceTempView(name)
    ship(spark)
    # What no built-in expresses; rows travel in Arrow batches.
    arrow = lambda name, function, kind: spark.udf.register(name, F.udf(function, kind, useArrow=True))
    arrow("norm_url", lambda u: None if u is None else norm(u), "string")
    arrow("resolve_url", lambda base, ref: None if base is None or ref is None else resolve(base, ref), "string")
    arrow("robots_allow", lambda text, agent, url: is_allowed(text, agent, url), "boolean")
    table = F.udtf(ParsedPage, returnType="title string, meta_description string, canonical string, word_count int, body_text string, internal_links array<string>, external_links array<string>")
    spark.udtf.register("parse_page", table)
    return list(views)
