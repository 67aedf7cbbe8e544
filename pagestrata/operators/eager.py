"""Eager aggregation through joins: aggregate first, join compact states, combine them by algebra.

A join followed by a group-by multiplies rows before it adds them up; where a few keys hold most rows this
concentrates the work on a few tasks. Here both inputs are first aggregated by the join key, which combines
on the map side, so that a key of a billion rows reaches the join as one state. Counts of joined rows are
then products of counts, sums are sums times the other side's counts, and the result is rolled up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.functions.urls import norm_url
from pagestrata.runtime import one_delivery


def join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_by: list[str] = (),
    right_by: list[str] = (),
    left_sums: list[str] = (),
    right_sums: list[str] = (),
    how: str = "inner",
) -> DataFrame:
    """Group the join of left and right by left_by and right_by without joining rows.

    Gives joined_rows, left_<c> and right_<c> (sums over the joined rows) for each column summed, the same
    as joining first. Null keys match nothing; with how="left" or "right" groups without a partner keep
    their row with joined_rows 0. Columns that clash between the sides are told apart by their side's prefix.
    """
    l = left.groupBy(*on, *left_by).agg(F.count("*").alias("__nl"), *[F.sum(c).alias(f"__l_{c}") for c in left_sums])
    r = right.groupBy(*on, *right_by).agg(F.count("*").alias("__nr"), *[F.sum(c).alias(f"__r_{c}") for c in right_sums])
    nl, nr = (F.coalesce(F.col(c), F.lit(0)) for c in ("__nl", "__nr"))
    joined = l.join(r, list(on), how)
    out = [F.sum(nl * nr).cast("long").alias("joined_rows")]
    out += [F.sum(F.col(f"__l_{c}") * nr).alias(f"left_{c}") for c in left_sums]
    out += [F.sum(F.col(f"__r_{c}") * nl).alias(f"right_{c}") for c in right_sums]
    return joined.groupBy(*left_by, *right_by).agg(*out)


def page_links(pages: DataFrame) -> DataFrame:
    """(crawl_id, target, page_id): each page's distinct link targets of its crawl, without itself.

    Targets are normalised and made distinct within the page, before anything is shuffled; a page delivered
    twice counts once. Null link arrays, null urls and null page_ids give nothing.
    """
    targets = F.array_distinct(F.transform("internal_links", lambda link: norm_url(link["url"])))
    own = norm_url(F.col("url"))
    links = pages.where(F.size("internal_links") > 0).select(
        "page_id", "crawl_id", F.filter(targets, lambda t: t.isNotNull() & ~t.eqNullSafe(own)).alias("targets")
    )
    return one_delivery(links, "page_id", ["crawl_id", "targets"]).select("crawl_id", F.explode("targets").alias("target"), "page_id")


def in_degrees(pages: DataFrame) -> DataFrame:
    """(page_id, in_degree) of every crawled page."""
    crawled = one_delivery(pages, "page_id", ["crawl_id", "url"]).select("page_id", "crawl_id", norm_url(F.col("url")).alias("target"))
    found = join_aggregate(page_links(pages), crawled, ["crawl_id", "target"], right_by=["page_id"], how="right")
    return found.withColumnRenamed("joined_rows", "in_degree")


def site_in_degrees(pages: DataFrame) -> DataFrame:
    """(domain, pages, in_links): crawled pages of each site and the distinct page-to-page links that reach them.

    The join states are rolled up to the site; hot targets and hot sites are partial sums by then.
    """
    crawled = one_delivery(pages, "page_id", ["crawl_id", "url", "domain"]).select("domain", "crawl_id", norm_url(F.col("url")).alias("target"))
    reached = join_aggregate(page_links(pages), crawled, ["crawl_id", "target"], right_by=["domain"], how="right").withColumnRenamed("joined_rows", "in_links")
    return reached.join(crawled.groupBy("domain").agg(F.count("*").alias("pages")), "domain").select("domain", "pages", "in_links")


def wrong_in_degrees(ranked: DataFrame, pages: DataFrame) -> DataFrame:
    """(rank_id): stored in-degrees that are null or differ from the links of the crawl."""
    stored = one_delivery(ranked, "rank_id", ["crawl_id", "url", "in_degree"])
    stored = stored.select("rank_id", "crawl_id", norm_url(F.col("url")).alias("target"), "in_degree")
    counted = join_aggregate(page_links(pages), stored, ["crawl_id", "target"], right_by=["rank_id", "in_degree"], how="right")
    return counted.where(~F.col("in_degree").eqNullSafe(F.col("joined_rows"))).select("rank_id")
