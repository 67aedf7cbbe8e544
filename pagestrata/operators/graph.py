"""The internal link graph of each crawl: degrees, PageRank, components, orphans, hubs, silos."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.functions.urls import first_path_segment
from pagestrata.operators import relations
from pagestrata.runtime import free, written

c = F.col
DAMPING, ROUNDS = 0.85, 40
# A crawl with at most this many links is ranked within one task, all such crawls side by side; the rounds of
# larger ones are distributed.
TASK_EDGES = 1_000_000


def graph(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes (crawl_id, node, url), one an address; edges (crawl_id, src, dst) between nodes, each once, none to itself."""
    nodes = pages.groupBy("crawl_id", c("url_key").alias("node")).agg(F.min_by("url", "page_id").alias("url"))
    known = nodes.select("crawl_id", c("node").alias("target"))
    links = relations.resolved_links(pages).where("target <> url_key")
    edges = links.join(known, ["crawl_id", "target"], "left_semi").select("crawl_id", c("url_key").alias("src"), c("target").alias("dst")).distinct()
    return nodes, edges


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out = edges.groupBy("crawl_id", c("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy("crawl_id", c("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    return nodes.join(out, ["crawl_id", "node"], "left").join(into, ["crawl_id", "node"], "left").na.fill(0, ["out_degree", "in_degree"])


def _numbered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges under 64-bit ids, written once: rounds then shuffle numbers, not addresses."""
    ids = written(nodes.select("crawl_id", "node", F.monotonically_increasing_id().alias("id")), "graph-nodes")
    a = ids.select("crawl_id", c("node").alias("src"), c("id").alias("s"))
    b = ids.select("crawl_id", c("node").alias("dst"), c("id").alias("d"))
    return ids, written(edges.join(a, ["crawl_id", "src"]).join(b, ["crawl_id", "dst"]).select("crawl_id", "s", "d"), "graph-edges")


def _split(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """(rows of small crawls, nodes and edges of large ones), by the checked number of a crawl's nodes and links.

    Rows are (crawl_id, src, dst): every node with a null dst, and every link.
    """
    rows = nodes.select("crawl_id", c("node").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(edges)
    sizes = written(rows.groupBy("crawl_id").agg(F.count("*").alias("size")), "graph-sizes")
    small, large = sizes.where(c("size") <= limit).select("crawl_id"), sizes.where(c("size") > limit).select("crawl_id")
    if large.isEmpty():
        return rows, None, None
    return rows.join(small, "crawl_id", "left_semi"), nodes.join(large, "crawl_id", "left_semi"), edges.join(large, "crawl_id", "left_semi")


def _indexed(rows):
    """Node names in order, and source and target numbers of the links of one crawl."""
    import numpy as np

    names = np.sort(rows.src[rows.dst.isna()].to_numpy())
    linked = rows[rows.dst.notna()]
    return names, np.searchsorted(names, linked.src.to_numpy()), np.searchsorted(names, linked.dst.to_numpy())


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, task_edges: int = TASK_EDGES) -> DataFrame:
    """(crawl_id, node, pagerank): a fixed number of rounds from a uniform start; pages without links spread their rank evenly."""
    rows, large_nodes, large_edges = _split(nodes, edges, task_edges)

    def rank_crawl(crawl):
        import numpy as np
        import pandas as pd

        names, src, dst = _indexed(crawl)
        n = len(names)
        out = np.bincount(src, minlength=n)
        rank = np.full(n, 1.0 / n)
        for _ in range(rounds):
            got = np.bincount(dst, rank[src] / out[src], n)
            rank = (1 - damping) / n + damping * (got + rank[out == 0].sum() / n)
        return pd.DataFrame({"crawl_id": crawl.crawl_id.iloc[0], "node": names, "pagerank": rank})

    found = rows.groupBy("crawl_id").applyInPandas(rank_crawl, "crawl_id long, node string, pagerank double")
    return found if large_nodes is None else found.unionByName(_pagerank_rounds(large_nodes, large_edges, rounds, damping))


def _pagerank_rounds(nodes: DataFrame, edges: DataFrame, rounds: int, damping: float) -> DataFrame:
    """The same, distributed. A hot target is a partial sum on the map side; each round ends in a written table."""
    ids, links = _numbered(nodes, edges)
    out = links.groupBy("s").agg(F.count("*").alias("out"))
    sized = ids.groupBy("crawl_id").agg(F.count("*").alias("n"))
    fixed = written(ids.select("crawl_id", "id").join(sized, "crawl_id").join(out.withColumnRenamed("s", "id"), "id", "left"), "graph-fixed")
    rank = fixed.select("crawl_id", "id", "n", "out", (F.lit(1.0) / c("n")).alias("rank"))
    kept: list[DataFrame] = []
    for _ in range(rounds):
        given = links.join(rank.where("out is not null").select(c("id").alias("s"), (c("rank") / c("out")).alias("share")), "s").groupBy(c("d").alias("id")).agg(F.sum("share").alias("got"))
        lost = rank.where("out is null").groupBy("crawl_id").agg(F.sum("rank").alias("lost"))
        fresh = rank.select("crawl_id", "id", "n", "out").join(given, "id", "left").join(lost, "crawl_id", "left")
        value = (1 - damping) / c("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) / c("n"))
        rank = fresh.select("crawl_id", "id", "n", "out", value.alias("rank"))
        rank = written(rank, "graph-rank")
        kept.append(rank)
        if len(kept) > 2:
            free(kept.pop(0))
    return rank.join(ids.select("id", "node"), "id").select("crawl_id", "node", c("rank").alias("pagerank"))


def components(nodes: DataFrame, edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(crawl_id, node, component): weakly connected components of each crawl, each named by one of its nodes."""
    rows, large_nodes, large_edges = _split(nodes, edges, task_edges)

    def join_crawl(crawl):
        import numpy as np
        import pandas as pd

        names, src, dst = _indexed(crawl)
        label = np.arange(len(names))
        while True:
            fresh = label.copy()
            low = np.minimum(label[src], label[dst])
            np.minimum.at(fresh, src, low)
            np.minimum.at(fresh, dst, low)
            fresh = fresh[fresh]
            if (fresh == label).all():
                break
            label = fresh
        return pd.DataFrame({"crawl_id": crawl.crawl_id.iloc[0], "node": names, "component": names[label]})

    found = rows.groupBy("crawl_id").applyInPandas(join_crawl, "crawl_id long, node string, component string")
    if large_nodes is None:
        return found
    return found.unionByName(_component_stars(large_nodes, large_edges))


def _component_stars(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same, distributed, for crawls of any size.

    Alternating large-star and small-star steps: every node points at smaller ids until no edge changes,
    in a number of rounds that grows with the logarithm of the longest path. Isolated nodes stand alone.
    """
    ids, links = _numbered(nodes, edges)
    pairs = links.select(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).distinct()
    kept: list[DataFrame] = []
    while True:
        both = pairs.select(c("a").alias("u"), c("b").alias("v")).union(pairs.select(c("b").alias("u"), c("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(c("m").alias("a"), c("v").alias("b")).distinct()
        down = large.where("a < b")
        low = down.groupBy("b").agg(F.min("a").alias("m"))
        small = down.join(low, "b").select(F.explode(F.array(F.struct(c("m").alias("a"), c("b").alias("b")), F.struct(c("m").alias("a"), c("a").alias("b")))).alias("e")).select("e.a", "e.b").where("a < b").distinct()
        small = written(small, "graph-stars")
        changed = small.join(pairs, ["a", "b"], "left_anti").limit(1).count() + pairs.join(small, ["a", "b"], "left_anti").limit(1).count()
        pairs = small
        kept.append(small)
        if len(kept) > 2:
            free(kept.pop(0))
        if not changed:
            break
    root = pairs.groupBy(c("b").alias("id")).agg(F.min("a").alias("component"))
    named = ids.select(c("id").alias("component"), c("node").alias("name"))
    placed = ids.join(root, "id", "left").select("crawl_id", "node", F.coalesce("component", "id").alias("component"))
    return placed.join(named, "component").select("crawl_id", "node", c("name").alias("component"))


def link_graph(pages: DataFrame, seeds: DataFrame, top: int = 15) -> dict[str, DataFrame]:
    """The link-graph report: totals, ranked pages, hubs, orphans and silos, `top` of each a crawl (a report's limit).

    seeds: (crawl_id, seed_url). Orphans are addresses no other page links to, without the seed's.
    """
    from pagestrata.functions.urls import norm_url

    nodes, edges = graph(pages)
    deg = degrees(nodes, edges)
    totals = deg.groupBy("crawl_id").agg(F.count("*").alias("nodes"), F.sum("in_degree").alias("edges"), F.round(F.avg("out_degree"), 6).alias("avg_out_degree"))
    moved = relations.aliases(pages).where("requested <> served")
    seed = seeds.select("crawl_id", norm_url(c("seed_url")).alias("requested")).join(moved, ["crawl_id", "requested"], "left").select("crawl_id", F.coalesce("served", "requested").alias("node"))
    return {
        "totals": totals,
        "ranked": _top(pagerank(nodes, edges), "pagerank", top),
        "hubs": _top(deg.select("crawl_id", "node", "out_degree"), "out_degree", top),
        "orphans": deg.where("in_degree = 0").join(seed, ["crawl_id", "node"], "left_anti").select("crawl_id", "node"),
        "silos": silos(pages),
    }


def _top(df: DataFrame, by: str, n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy("crawl_id").orderBy(c(by).desc(), "node"))).where(c("place") <= n)


def silos(pages: DataFrame) -> DataFrame:
    """(crawl_id, silo, pages): pages by the first segment of their path."""
    return pages.groupBy("crawl_id", first_path_segment(c("url")).alias("silo")).agg(F.count("*").alias("pages"))
