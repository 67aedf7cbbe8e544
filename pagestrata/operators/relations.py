"""Relations between pages of a crawl: redirect aliases, resolved links, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.functions.urls import norm_url

c = F.col


def last_by_key(pages: DataFrame) -> DataFrame:
    """One page for each (crawl_id, url_key): the last by page_id where several share an address."""
    columns = ["page_id", "status", "noindex", "canonical", "canonical_source", "url"]
    kept = pages.groupBy("crawl_id", "url_key").agg(F.max_by(F.struct(*columns), "page_id").alias("p"))
    return kept.select("crawl_id", "url_key", *[c(f"p.{x}") for x in columns])


def aliases(pages: DataFrame) -> DataFrame:
    """(crawl_id, requested, served): every address a crawl asked for and the one that answered.

    A page answers for its own address whatever redirects say; among redirects the first page's wins.
    """
    own = pages.select("crawl_id", c("url_key").alias("requested")).distinct().withColumn("served", c("requested"))
    hops = pages.where(F.size("redirect_chain") > 0).select("crawl_id", "page_id", "url_key", F.posexplode("chain_urls").alias("pos", "hop"))
    first = hops.groupBy("crawl_id", norm_url(c("hop")).alias("requested")).agg(F.min_by("url_key", F.struct("page_id", "pos")).alias("served"))
    return own.unionByName(first.join(own.select("crawl_id", "requested"), ["crawl_id", "requested"], "left_anti"))


def resolved_links(pages: DataFrame) -> DataFrame:
    """(crawl_id, page_id, url, url_key, is_ok, link, target): each page's distinct internal links with the address that serves them.

    Links are made distinct within the page before the shuffle; the aliases that matter are the few whose
    requested and served address differ.
    """
    distinct = F.array_distinct(F.transform("internal_links", lambda l: norm_url(l["url"])))
    links = pages.select("crawl_id", "page_id", "url", "url_key", "is_ok", F.explode(distinct).alias("link")).where(c("link").isNotNull())
    moved = aliases(pages).where("requested <> served")
    joined = links.join(moved.withColumnRenamed("requested", "link"), ["crawl_id", "link"], "left")
    return joined.select("crawl_id", "page_id", "url", "url_key", "is_ok", "link", F.coalesce("served", "link").alias("target"))
