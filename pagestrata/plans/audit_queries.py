"""The registered audit queries over the crawl tables, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.functions import text, urls
from pagestrata.operators import checks, graph, relations, scoring, surface
from pagestrata.runtime import spread, table, written
from pagestrata.sources.sitemaps import listed_urls
from pagestrata.sources.snapshots import audit_pages
from pagestrata.streaming import streams

c = F.col


def pages(spark: SparkSession, sf_dir: str, crawl_id: int | None = None) -> DataFrame:
    """Audited pages of all crawls, or of one: that filter reaches the scan."""
    given = table(spark, sf_dir, "page_data")
    return audit_pages(spread(given if crawl_id is None else given.where(c("crawl_id") == crawl_id)))


def issues(spark: SparkSession, sf_dir: str, crawl_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages and all their findings; both are written once, as reports read them several times."""
    p = written(pages(spark, sf_dir, crawl_id).drop("body_text"), "audit-pages")
    return p, written(checks.page_issues(p), "audit-issues")


def _of_pages(operator):
    return lambda spark, sf_dir: operator(pages(spark, sf_dir))


def row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.row_issues(pages(spark, sf_dir)).drop("detail")


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_issues(pages(spark, sf_dir)).drop("detail", "severity")


def canonical_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.canonical_issues(pages(spark, sf_dir)).drop("severity")


def link_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.link_issues(pages(spark, sf_dir)).drop("detail", "severity")


def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.aliases(pages(spark, sf_dir)).where("requested <> served")


def link_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*graph.graph(pages(spark, sf_dir))).select("crawl_id", "node", "in_degree", "out_degree")


def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = (written(x, "graph-input") for x in graph.graph(pages(spark, sf_dir)))
    return graph.pagerank(nodes, edges).select("crawl_id", "node", F.round("pagerank", 9).alias("pagerank"))


def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = (written(x, "graph-input") for x in graph.graph(pages(spark, sf_dir)))
    found = graph.components(nodes, edges)
    return found.groupBy("crawl_id", "component").agg(F.count("*").alias("nodes"), F.min("node").alias("first_node")).select("crawl_id", "nodes", "first_node")


def orphan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return graph.degrees(*graph.graph(p)).where("in_degree = 0").select("crawl_id", "node")


def silos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.silos(pages(spark, sf_dir))


def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.health_score(*issues(spark, sf_dir))


def severity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.severity_totals(issues(spark, sf_dir)[1])


def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.category_summary(issues(spark, sf_dir)[1])


def check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.check_counts(issues(spark, sf_dir)[1])


def worst_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.worst_pages(*issues(spark, sf_dir)).drop("place")


def top_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.top_issues(issues(spark, sf_dir)[1])


def query_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of warnings about the shop section of crawl 1."""
    p, found = issues(spark, sf_dir, crawl_id=1)
    return surface.query(p, found, surface.Query(1, url_pattern="*/shop/*", severity="warning", urls_per_issue=500)).drop("detail")


def query_all_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of warnings about the shop section of each crawl."""
    p, found = issues(spark, sf_dir)
    return surface.query(p, found, surface.Query(None, url_pattern="*/shop/*", severity="warning", urls_per_issue=500)).drop("detail")


def compare_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl with the largest id of each site against all its others taken together."""
    p, found = issues(spark, sf_dir)
    crawls = table(spark, sf_dir, "crawls").select("crawl_id", "site_id")
    last = crawls.groupBy("site_id").agg(F.max("crawl_id").alias("latest"))
    sited = crawls.join(last, "site_id")
    role = sited.select("crawl_id", c("site_id").alias("pair"), (c("crawl_id") == c("latest")).alias("is_latest"))
    keyed = lambda df, latest: df.join(role.where(c("is_latest") == latest), "crawl_id").drop("crawl_id", "is_latest").withColumnRenamed("pair", "crawl_id")
    return surface.compare(keyed(p, False), keyed(found, False), keyed(p, True), keyed(found, True))


def compare_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each crawl against the next one of its site."""
    return surface.compare_consecutive(*issues(spark, sf_dir), table(spark, sf_dir, "crawls"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = c("url")
    p = pages(spark, sf_dir).select("page_id", F.explode(F.transform("internal_links", lambda l: l["url"])).alias("url")).distinct()
    return p.select("page_id", "url", urls.norm_url(u).alias("url_key"), urls.host_of(u).alias("host"), urls.path_of(u).alias("path"), urls.first_path_segment(u).alias("segment"), urls.without_fragment(u).alias("bare"))


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and pixel widths of titles and descriptions, words of bodies."""
    p = pages(spark, sf_dir)
    return p.select("page_id", "title_length", "title_pixel_width", "meta_description_length", "meta_description_pixel_width", text.word_count(c("body_text")).alias("words"))


def reading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.round(text.reading_ease(c("body_text")), 6).alias("reading_ease"))


def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed_urls(pages(spark, sf_dir))


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.csv_rows(pages(spark, sf_dir))


def crawl_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composed answer about each crawl, its lists as text."""
    a = surface.crawl_answer(*issues(spark, sf_dir))
    shown = lambda column, *fields: F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), "|")
    return a.withColumns({"top_categories": shown("top_categories", "category", "found", "urls"), "worst_pages": shown("worst_pages", "url_key", "total")})


def score_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.score_changes(*issues(spark, sf_dir), table(spark, sf_dir, "crawls"))


def list_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of stored crawls, newest first (a page of 20, as the listing is asked for)."""
    return surface.list_crawls(table(spark, sf_dir, "crawls")).select("crawl_id", "domain", "crawl_date", "pages_crawled")


def page_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.page_issue_counts(*issues(spark, sf_dir))


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.hourly(table(spark, sf_dir, "events"))


def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"))


QUERIES = {
    "health_score": health_score,
    "row_checks": row_checks,
    "duplicates": duplicates,
    "canonical_checks": canonical_checks,
    "link_checks": link_checks,
    "alias_resolution": alias_resolution,
    "link_degrees": link_degrees,
    "pagerank": pagerank,
    "component_sizes": component_sizes,
    "orphan_nodes": orphan_nodes,
    "silos": silos,
    "severity_totals": severity_totals,
    "category_summary": category_summary,
    "check_counts": check_counts,
    "page_issue_counts": page_issue_counts,
    "worst_pages": worst_pages,
    "top_issues": top_issues,
    "query_issues": query_issues,
    "query_all_issues": query_all_issues,
    "compare_crawls": compare_crawls,
    "compare_consecutive": compare_consecutive,
    "crawl_summary": _of_pages(scoring.crawl_summary),
    "status_counts": _of_pages(scoring.status_counts),
    "status_classes": _of_pages(scoring.status_classes),
    "response_histogram": _of_pages(scoring.response_histogram),
    "depth_distribution": _of_pages(scoring.depth_distribution),
    "directory_tree": _of_pages(scoring.directory_tree),
    "script_rendering": _of_pages(scoring.rendered_by_script),
    "url_parts": url_parts,
    "text_measures": text_measures,
    "reading_scores": reading_scores,
    "sitemap_urls": sitemap_urls,
    "csv_export": csv_export,
    "crawl_answer": crawl_answer,
    "score_changes": score_changes,
    "list_crawls": list_crawls,
    "events_hourly": events_hourly,
    "events_sessions": events_sessions,
}
