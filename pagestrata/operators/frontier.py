"""A crawl's breadth-first frontier replayed over a known link graph, and samples of its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.runtime import written

c = F.col


def depths(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(crawl_id, node, depth): every node within max_depth links of its crawl's seed, at its least depth.

    One level a round: the frontier's targets less what was visited. edges: (crawl_id, src, dst); seeds:
    (crawl_id, node). Each round ends in a written table, so the plan does not grow with the depth.
    """
    frontier = written(seeds.select("crawl_id", "node").distinct().withColumn("depth", F.lit(0)), "frontier")
    visited = frontier
    for depth in range(1, max_depth + 1):
        reached = edges.join(frontier.select("crawl_id", c("node").alias("src")), ["crawl_id", "src"]).select("crawl_id", c("dst").alias("node")).distinct()
        fresh = reached.join(visited.select("crawl_id", "node"), ["crawl_id", "node"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = written(fresh, "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def crawl_order(visited: DataFrame, max_pages: int) -> DataFrame:
    """The first max_pages nodes of each crawl by depth, then address (the crawl's own limit).

    Whole levels are taken by their counts; only the level that the limit cuts is ordered.
    """
    from pyspark.sql import Window

    counts = visited.groupBy("crawl_id", "depth").agg(F.count("*").alias("n"))
    upto = counts.withColumn("before", F.sum("n").over(Window.partitionBy("crawl_id").orderBy("depth")) - c("n")).where(c("before") < max_pages)
    placed = visited.join(upto, ["crawl_id", "depth"])
    whole = placed.where(c("before") + c("n") <= max_pages).select("crawl_id", "node", "depth")
    cut = placed.where(c("before") + c("n") > max_pages)
    nth = F.row_number().over(Window.partitionBy("crawl_id").orderBy("node"))
    return whole.unionByName(cut.withColumn("nth", nth).where(c("before") + c("nth") <= max_pages).select("crawl_id", "node", "depth"))


def redirect_chains(hops: DataFrame, max_hops: int = 5) -> DataFrame:
    """(crawl_id, url, served, chain): redirects followed from a table of single hops (crawl_id, url, status, location).

    A chain ends where an address does not redirect, where it would repeat, or after one hop more than max_hops.
    """
    step = hops.where(c("location").isNotNull()).select("crawl_id", "url", "status", "location")
    first = F.array(F.struct("status", "url"))
    walk = step.select("crawl_id", "url", c("location").alias("served"), first.alias("chain"))
    nxt = step.select("crawl_id", c("url").alias("served"), c("status").alias("s"), c("location").alias("l"))
    for _ in range(max_hops):
        seen = F.exists("chain", lambda h: h["url"] == c("served"))
        joined = walk.join(nxt, ["crawl_id", "served"], "left").withColumn("on", c("l").isNotNull() & ~seen)
        longer = F.concat("chain", F.array(F.struct(c("s").alias("status"), c("served").alias("url"))))
        walk = joined.select("crawl_id", "url", F.when(c("on"), c("l")).otherwise(c("served")).alias("served"), F.when(c("on"), longer).otherwise(c("chain")).alias("chain"))
    return walk


def sample_pages(pages: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n pages of each crawl in a seeded order (a sampling operator)."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("crawl_id").orderBy(F.xxhash64(F.lit(seed), "page_id")))
    return pages.withColumn("__nth", nth).where(c("__nth") <= n).drop("__nth")
