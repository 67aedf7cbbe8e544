"""Health score, summaries and distributions of a crawl, all as grouped aggregates keyed by crawl_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.operators import relations
from pagestrata.operators.checks import without_alt
from pagestrata.plans.check_catalog import SEVERITY_RANK, catalog

c = F.col
# Weights and caps of the score, grade bands, and the share of unreadable pages that ends scoring.
BROKEN, DEFECTIVE = 100.0, 55.0
SITE_HIGH, SITE_MEDIUM, MINOR = 12.0, 4.0, 1.0
SITE_HIGH_CAP, SITE_MEDIUM_CAP, MINOR_CAP = 24.0, 14.0, 12.0
COVERAGE_FLOOR, LEAST_PAGES, UNREADABLE = 0.12, 5, 0.8
BANDS = [(90, "A", "Excellent"), (80, "B", "Good"), (70, "C", "Needs Work"), (60, "D", "Poor"), (0, "F", "Critical")]
NOT_REACHED = ["internal_server_error", "internal_client_error", "internal_no_response", "internal_access_restricted"]


def health_score(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """(crawl_id, pages, broken, defective, score, grade, verdict, and the points of each part).

    A page counts once among the broken and once among the defective, however many checks found it; a
    site-level finding counts as one address. Bounded findings weigh by the root of the share of pages.
    """
    sized = pages.groupBy("crawl_id").agg(F.count("*").alias("pages"))
    known = issues.join(F.broadcast(catalog(issues.sparkSession).select("category", "check", "tier")), ["category", "check"], "left")
    known = known.withColumn("address", F.coalesce("url", "check"))
    # One row an address first: broken before defective.
    per_url = known.where(c("tier").isin("broken", "defective")).groupBy("crawl_id", "address").agg(F.max((c("tier") == "broken").cast("int")).alias("is_broken"))
    pages_hit = per_url.groupBy("crawl_id").agg(F.sum("is_broken").alias("broken"), F.sum(1 - c("is_broken")).alias("defective"))
    per_check = known.groupBy("crawl_id", "category", "check", "tier", "severity").agg(F.count("url").alias("rows"), F.count_distinct("url").alias("urls"))
    per_check = per_check.join(sized, "crawl_id")
    coverage = F.when(c("rows") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(COVERAGE_FLOOR), F.sqrt(c("rows") / c("pages")))))
    part = lambda tier, weight: F.sum(F.when(c("tier") == tier, coverage * weight).otherwise(0.0))
    named = lambda check: F.max(F.when(c("check") == check, c("urls")).otherwise(0))
    totals = per_check.groupBy("crawl_id").agg(
        part("site_high", SITE_HIGH).alias("high"), part("site_medium", SITE_MEDIUM).alias("medium"), part("minor", MINOR).alias("small"),
        named("low_content").alias("thin"), named("exact_duplicate").alias("same"), named("no_internal_outlinks").alias("linkless"),
        F.max((c("severity") == "critical").cast("int")).alias("has_critical"), F.max((c("severity") == "warning").cast("int")).alias("has_warning"),
    )
    walled = known.where((c("category") == "response_codes") & c("check").isin(NOT_REACHED)).groupBy("crawl_id").agg(F.count_distinct("url").alias("unreached"))
    s = sized.join(pages_hit, "crawl_id", "left").join(totals, "crawl_id", "left").join(walled, "crawl_id", "left").na.fill(0)
    base = F.greatest(c("pages"), F.lit(LEAST_PAGES))
    s = s.withColumns(
        {
            "broken_points": BROKEN * F.least(F.lit(1.0), c("broken") / base),
            "defective_points": DEFECTIVE * F.least(F.lit(1.0), c("defective") / base),
            "site_points": F.least(c("high"), F.lit(SITE_HIGH_CAP)) + F.least(c("medium"), F.lit(SITE_MEDIUM_CAP)),
            "minor_points": F.least(c("small"), F.lit(MINOR_CAP)),
        }
    )
    raw = 100 - (c("broken_points") + c("defective_points") + c("site_points") + c("minor_points"))
    score = F.floor(F.greatest(F.round(raw, 9), F.lit(0.0))).cast("int")
    blocked = (c("unreached") > 0) & (c("unreached") >= c("pages"))
    unread = (c("thin") / c("pages") >= UNREADABLE) & ((c("same") / c("pages") >= UNREADABLE) | (c("linkless") / c("pages") >= UNREADABLE))
    s = s.withColumn("scorable", ~(blocked | unread)).withColumn("score", F.when(c("scorable"), score).otherwise(0))
    grade = verdict = None
    for least, letter, word in reversed(BANDS):
        grade = F.lit(letter) if grade is None else F.when(c("score") >= least, letter).otherwise(grade)
        verdict = F.lit(word) if verdict is None else F.when(c("score") >= least, word).otherwise(verdict)
    softened = F.when(c("has_warning") == 1, "Widespread Warnings").otherwise("Many Minor Issues")
    verdict = F.when((c("score") < 60) & (c("has_critical") == 0), softened).otherwise(verdict)
    return s.select(
        "crawl_id", "pages", "broken", "defective", "score",
        F.when(c("scorable"), grade).otherwise("–").alias("grade"),
        F.when(blocked, "Crawl blocked").when(unread, "No readable content").otherwise(verdict).alias("verdict"),
        *[F.round(x, 6).alias(x) for x in ("broken_points", "defective_points", "site_points", "minor_points")],
    )


def severity_totals(issues: DataFrame) -> DataFrame:
    """Findings by severity; a site-level finding counts as one."""
    return issues.groupBy("crawl_id", "severity").agg(F.count("*").alias("found"))


def category_summary(issues: DataFrame) -> DataFrame:
    counted = [F.count_if(c("severity") == s).alias(s) for s in SEVERITY_RANK]
    return issues.groupBy("crawl_id", "category").agg(F.count_distinct("check").alias("checks"), F.count("*").alias("found"), *counted, F.count_distinct("url").alias("urls"))


def check_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("crawl_id", "category", "check", "severity").agg(F.count("*").alias("found"), F.count_distinct("url").alias("urls"))


def crawl_summary(pages: DataFrame) -> DataFrame:
    """Totals and whole-number means of each crawl; exact p50 (mean of the middle two, rounded down) and p95 (nearest rank) of response times."""
    size = lambda a: F.when(c(a).isNull(), 0).otherwise(F.size(c(a)))
    return pages.groupBy("crawl_id").agg(
        F.count("*").alias("pages"),
        F.floor(F.sum("response_time_ms") / F.count("*")).cast("long").alias("mean_response_ms"),
        F.sum("word_count").cast("long").alias("words"),
        F.floor(F.sum("word_count") / F.count("*")).cast("long").alias("mean_words"),
        F.sum(size("internal_links")).cast("long").alias("internal_links"),
        F.sum(size("external_links")).cast("long").alias("external_links"),
        F.sum(size("images")).cast("long").alias("images"),
        F.sum(without_alt(c("images"))).cast("long").alias("images_without_alt"),
        F.count_if(size("schema_types") > 0).alias("pages_with_schema"),
        F.floor(F.percentile("response_time_ms", 0.5)).cast("long").alias("p50_response_ms"),
        F.expr("percentile_disc(0.95) within group (order by response_time_ms)").cast("long").alias("p95_response_ms"),
    )


def cwv_summary(pages: DataFrame) -> DataFrame:
    tested = c("performance_score").isNotNull()
    return pages.groupBy("crawl_id").agg(
        F.count_if(tested).alias("tested"),
        *[F.count_if(tested & (c("cwv_status") == s)).alias(s) for s in ("good", "needs_improvement", "poor")],
        *[F.avg(m).alias(f"mean_{m}") for m in ("lcp_ms", "cls", "inp_ms")],
        F.floor(F.avg("performance_score")).cast("int").alias("mean_score"),
    )


def cwv_status(lcp: Column, inp: Column, cls: Column) -> Column:
    """The worst of the measured vitals; null where neither LCP nor CLS was measured."""
    rank = lambda v, good, poor: F.when(v > poor, 2).when(v > good, 1).when(v.isNotNull(), 0)
    worst = F.greatest(rank(lcp, 2500, 4000), rank(cls, 0.1, 0.25), rank(inp, 200, 500))
    return F.when(lcp.isNotNull() | cls.isNotNull(), F.element_at(F.lit(["good", "needs_improvement", "poor"]), worst + 1))


def status_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("crawl_id", "status").agg(F.count("*").alias("pages"))


def status_classes(pages: DataFrame) -> DataFrame:
    kind = F.concat(F.floor(c("status") / 100).cast("string"), F.lit("xx"))
    counted = pages.where("status between 200 and 599").groupBy("crawl_id", kind.alias("status_class")).agg(F.count("*").alias("pages"))
    return counted.withColumn("percent", F.round(100.0 * c("pages") / F.sum("pages").over(Window.partitionBy("crawl_id")), 6))


def response_histogram(pages: DataFrame) -> DataFrame:
    ms = c("response_time_ms")
    bucket = F.when(ms < 200, "0-199").when(ms < 500, "200-499").when(ms < 1000, "500-999").otherwise("1000+")
    return pages.where(ms.isNotNull()).groupBy("crawl_id", bucket.alias("bucket")).agg(F.count("*").alias("pages"))


def depth_distribution(pages: DataFrame) -> DataFrame:
    """Every depth from 0 to the deepest, those without pages too."""
    counts = pages.where("depth is not null").groupBy("crawl_id", "depth").agg(F.count("*").alias("pages"))
    span = counts.groupBy("crawl_id").agg(F.max("depth").alias("deepest")).select("crawl_id", F.explode(F.sequence(F.lit(0), c("deepest"))).alias("depth"))
    return span.join(counts, ["crawl_id", "depth"], "left").na.fill(0, ["pages"])


def directory_tree(pages: DataFrame, levels: int = 24) -> DataFrame:
    """(crawl_id, directory, pages): how many pages lie at or under each path prefix."""
    from pagestrata.functions.urls import path_of

    parts = F.slice(F.filter(F.split(path_of(c("url")), "/"), lambda s: s != ""), 1, levels)
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return pages.select("crawl_id", F.explode(prefixes).alias("directory")).groupBy("crawl_id", "directory").agg(F.count("*").alias("pages"))


def page_issue_counts(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """(crawl_id, url_key, critical, warning, info, total) with findings under redirected addresses counted where they were served."""
    from pagestrata.functions.urls import norm_url

    moved = relations.aliases(pages).where("requested <> served")
    keyed = issues.where("url is not null").withColumn("requested", norm_url(c("url"))).join(moved, ["crawl_id", "requested"], "left")
    counted = [F.count_if(c("severity") == s).alias(s) for s in SEVERITY_RANK]
    return keyed.groupBy("crawl_id", F.coalesce("served", "requested").alias("url_key")).agg(*counted, F.count("*").alias("total"))


def rendered_by_script(pages: DataFrame) -> DataFrame:
    """(crawl_id, empty, considered, suspected): HTML pages that answer 200 without a word; over a quarter suggests client-side rendering."""
    considered = F.count_if(c("is_html") & (c("status") == 200))
    empty = F.count_if(c("is_html") & (c("status") == 200) & (F.coalesce("word_count", F.lit(0)) == 0) & ~F.coalesce("has_body", F.lit(False)))
    counted = pages.groupBy("crawl_id").agg(empty.alias("empty"), considered.alias("considered"))
    return counted.withColumn("suspected", (c("considered") > 0) & (F.floor(100 * c("empty") / F.nullif(c("considered"), F.lit(0))) > 25))
