"""What users ask of stored crawls: filtered pages of findings, summaries, comparisons, inspection, exports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.functions.urls import glob_matches, norm_url
from pagestrata.operators import relations, scoring
from pagestrata.operators.checks import without_alt
from pagestrata.plans.check_catalog import SEVERITY_RANK

c = F.col
# Limits of the answers.
MOST_PER_PAGE, MOST_URLS = 100, 500
FORMULA_STARTS = "^[=+\\-@\t\r]"


@dataclass
class Query:
    """A request for findings of one crawl, or of each one where crawl_id is None. urls and url_pattern are alternatives; the other filters all apply."""

    crawl_id: int | None
    urls: list[str] = field(default_factory=list)
    url_pattern: str | None = None
    category: str | None = None
    severity: str | None = None
    page: int = 1
    per_page: int = 20
    urls_per_issue: int = 5

    def __post_init__(self) -> None:
        if self.severity is not None and self.severity not in SEVERITY_RANK:
            raise ValueError(f"severity is one of {', '.join(SEVERITY_RANK)}")
        self.page = max(1, int(self.page))
        self.per_page = min(MOST_PER_PAGE, max(1, int(self.per_page)))
        self.urls_per_issue = min(MOST_URLS, max(1, int(self.urls_per_issue)))
        if self.category == "java_script":
            self.category = "javascript"


def _served(pages: DataFrame, df: DataFrame) -> DataFrame:
    """df with url_key, the normalised address that served its url."""
    moved = relations.aliases(pages).where("requested <> served")
    keyed = df.withColumn("requested", norm_url(c("url"))).join(moved, ["crawl_id", "requested"], "left")
    return keyed.withColumn("url_key", F.coalesce("served", "requested")).drop("requested", "served")


def query(pages: DataFrame, issues: DataFrame, q: Query) -> DataFrame:
    """One page of findings by check: (category, check, severity, total_urls, url_no, url, detail, page_count),
    with crawl_id before them and a page for each crawl if all are asked for.

    A finding's address is kept if it matches itself or if the page that served it does; site-level findings
    always stay. At most urls_per_issue addresses a check are shown; total_urls counts all.
    """
    if q.crawl_id is not None:
        pages, issues = pages.where(c("crawl_id") == q.crawl_id), issues.where(c("crawl_id") == q.crawl_id)
    if q.category:
        issues = issues.where(c("category") == q.category)
    if q.severity:
        issues = issues.where(c("severity") == q.severity)
    if q.urls or q.url_pattern:

        def matches(url: Column) -> Column:
            hit = url.isin(q.urls) if q.urls else F.lit(False)
            return (hit | glob_matches(q.url_pattern, url)) if q.url_pattern else hit

        chosen = pages.where(matches(c("url"))).select("crawl_id", "url_key").distinct().withColumn("chosen", F.lit(True))
        site = issues.where("url is null").withColumn("url_key", F.lit(None).cast("string"))
        own = _served(pages, issues.where("url is not null")).join(chosen, ["crawl_id", "url_key"], "left").where(matches(c("url")) | c("chosen")).drop("chosen")
        issues = own.unionByName(site)
    check = ["crawl_id", "category", "check", "severity"]
    counted = issues.groupBy(*check).agg(F.count("url").alias("total_urls"))
    rank = F.create_map(*[x for s, r in SEVERITY_RANK.items() for x in (F.lit(s), F.lit(r))])
    # At most one row a check of the catalogue, so one ordering over all of a crawl is bounded.
    place = F.row_number().over(Window.partitionBy("crawl_id").orderBy(rank[c("severity")], c("total_urls").desc(), "category", "check"))
    of = F.count("*").over(Window.partitionBy("crawl_id"))
    shown = counted.withColumns({"place": place, "page_count": F.greatest(F.lit(1), F.ceil(of / q.per_page)).cast("int")})
    shown = shown.where(F.floor((c("place") - 1) / q.per_page) == q.page - 1)
    nth = F.row_number().over(Window.partitionBy(*check).orderBy("url", "detail"))
    shown = shown if q.crawl_id is None else F.broadcast(shown)
    first = issues.join(shown.select(*check), check, "left_semi").withColumn("url_no", nth).where(c("url_no") <= q.urls_per_issue)
    return first.join(shown, check).select(*check[q.crawl_id is not None :], "total_urls", "url_no", "url", "detail", "page_count")


def inspect(pages: DataFrame, issues: DataFrame, url: str) -> DataFrame:
    """Findings of one address: those filed under it or under what it was served as, and the site-level ones."""
    keyed = _served(pages, issues.where("url is not null"))
    wanted = _served(pages, pages.select("crawl_id", F.lit(url).alias("url")).distinct()).select("crawl_id", "url_key")
    own = keyed.join(wanted, ["crawl_id", "url_key"], "left_semi").drop("url_key")
    return own.unionByName(issues.where("url is null").join(wanted.select("crawl_id").distinct(), "crawl_id", "left_semi"))


def query_pages(pages: DataFrame, q: Query, fields: list[str]) -> DataFrame:
    """Chosen fields of the matching pages, one page of them in the order of their ids."""
    own = pages if q.crawl_id is None else pages.where(c("crawl_id") == q.crawl_id)
    if q.urls or q.url_pattern:
        hit = c("url").isin(q.urls) if q.urls else F.lit(False)
        own = own.where((hit | glob_matches(q.url_pattern, c("url"))) if q.url_pattern else hit)
    unknown = set(fields) - set(pages.columns)
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
    return own.orderBy("page_id").offset((q.page - 1) * q.per_page).limit(q.per_page).select(*fields)


def worst_pages(pages: DataFrame, issues: DataFrame, top: int = 10) -> DataFrame:
    """The pages of each crawl with most findings (a top-k report)."""
    counted = scoring.page_issue_counts(pages, issues)
    place = F.row_number().over(Window.partitionBy("crawl_id").orderBy(c("total").desc(), "url_key"))
    return counted.withColumn("place", place).where(c("place") <= top)


def top_issues(issues: DataFrame, top: int = 3) -> DataFrame:
    """The checks of each crawl to mend first: by severity, then by findings (a top-k report)."""
    rank = F.create_map(*[x for s, r in SEVERITY_RANK.items() for x in (F.lit(s), F.lit(r))])
    counted = issues.groupBy("crawl_id", "category", "check", "severity").agg(F.count("*").alias("found"))
    place = F.row_number().over(Window.partitionBy("crawl_id").orderBy(rank[c("severity")], c("found").desc(), "category", "check"))
    return counted.withColumn("place", place).where(c("place") <= top)


def compare(pages_a: DataFrame, issues_a: DataFrame, pages_b: DataFrame, issues_b: DataFrame, compat: bool = False) -> DataFrame:
    """(category, check, url_key, change): findings new in the second crawl, and those it no longer has.

    Findings are keyed by category, check and served address; compat leaves the category out of the key.
    Site-level findings are not compared.
    """
    key = (["check"] if compat else ["category", "check"]) + ["url_key"]
    a, b = (_served(p, i.where("url is not null")).select(*key).distinct() for p, i in ((pages_a, issues_a), (pages_b, issues_b)))
    new = b.join(a, key, "left_anti").withColumn("change", F.lit("new"))
    return new.unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("resolved")))


def crawl_pairs(crawls: DataFrame) -> DataFrame:
    """(crawl_a, crawl_b): each crawl and the next one of its site, by date and then by id."""
    following = F.lead("crawl_id").over(Window.partitionBy("site_id").orderBy(c("crawl_date").asc_nulls_first(), "crawl_id"))
    return crawls.where("site_id is not null").select(c("crawl_id").alias("crawl_a"), following.alias("crawl_b")).where("crawl_b is not null")


def compare_consecutive(pages: DataFrame, issues: DataFrame, crawls: DataFrame, compat: bool = False) -> DataFrame:
    """(crawl_a, crawl_b, category, check, url_key, change): compare() for each crawl of a site and the next one.

    Addresses are resolved within their own crawl. A site's only crawl has nothing to be compared with.
    """
    key = (["check"] if compat else ["category", "check"]) + ["url_key"]
    pair = crawl_pairs(crawls)
    sides = [pair.select("crawl_a", "crawl_b", c(of).alias("crawl_id"), F.lit(of == "crawl_b").alias("later")) for of in ("crawl_a", "crawl_b")]
    # Each finding once for either side it stands on; those on one side only have changed.
    keyed = _served(pages, issues.where("url is not null")).select("crawl_id", *key).join(sides[0].unionByName(sides[1]), "crawl_id")
    seen = keyed.groupBy("crawl_a", "crawl_b", *key).agg(F.min("later").alias("first"), F.max("later").alias("last")).where(c("first") == c("last"))
    return seen.select("crawl_a", "crawl_b", *key, F.when(c("last"), "new").otherwise("resolved").alias("change"))


def regressions(changes: DataFrame, top: int = 50) -> DataFrame:
    """Addresses with most new checks (a top-k report)."""
    return changes.where("change = 'new'").groupBy("url_key").agg(F.count("*").alias("checks"), F.array_sort(F.collect_set("check")).alias("names")).orderBy(c("checks").desc(), "url_key").limit(top)


def improvements(changes: DataFrame) -> DataFrame:
    return changes.where("change = 'resolved'").groupBy("category").agg(F.count("*").alias("resolved"))


def rendered_flags(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """What scripts injected: rendered pages with flags for parts the static page lacked. Both have the page fields."""
    size = lambda a: F.when(c(a).isNull(), 0).otherwise(F.size(c(a)))
    s = static.select("crawl_id", "url", *[c(x).alias(f"s_{x}") for x in ("title", "meta_description", "canonical", "h1", "schema_types", "word_count")])
    r = rendered.join(s, ["crawl_id", "url"], "left")
    gained = lambda x: c(f"s_{x}").isNull() & c(x).isNotNull()
    filled = lambda x: (size(f"s_{x}") == 0) & (size(x) > 0)
    return r.select(
        "crawl_id", "url", gained("title").alias("js_injected_title"), gained("meta_description").alias("js_injected_description"),
        gained("canonical").alias("js_injected_canonical"), filled("h1").alias("js_injected_h1"), filled("schema_types").alias("js_injected_structured_data"),
        (F.coalesce("word_count", F.lit(0)) - F.coalesce("s_word_count", F.lit(0))).alias("words_gained"),
    )


def merge_rendered(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """Rendered pages that stand for their static form (answered 200 to 399): what the response decides stays with the static page, the
    rest is as rendered, with the flags of what scripts injected and the words they added."""
    kept = ["response_time_ms", "depth", "security_headers", "x_robots_tag", "redirect_chain"]
    flags = rendered_flags(static, rendered)
    fetched = static.where(c("status").between(200, 399)).select("crawl_id", "url", *[c(x).alias(f"s_{x}") for x in kept])
    merged = rendered.drop(*[f for f in flags.columns if f not in ("crawl_id", "url")]).join(flags, ["crawl_id", "url"]).join(fetched, ["crawl_id", "url"])
    return merged.withColumns({x: c(f"s_{x}") for x in kept}).drop(*[f"s_{x}" for x in kept])


def render_deltas(static: DataFrame, rendered: DataFrame, static_issues: DataFrame, rendered_issues: DataFrame) -> DataFrame:
    """(crawl_id, url, metric, static, rendered, delta): the two forms of each page side by side; presence counts as 0 or 1."""
    size = lambda a: F.when(c(a).isNull(), 0).otherwise(F.size(c(a)))
    metrics = {
        "title": c("title").isNotNull(), "meta_description": c("meta_description").isNotNull(), "word_count": F.coalesce("word_count", F.lit(0)), "internal_links": size("internal_links"),
        "external_links": size("external_links"), "images": size("images"), "schema_types": size("schema_types"), "h1": size("h1"),
    }

    def side(pages: DataFrame, issues: DataFrame, name: str) -> DataFrame:
        found = issues.where("url is not null").groupBy("crawl_id", "url").agg(F.count("*").alias("issues"))
        values = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("long").alias("v")) for k, v in (metrics | {"issues": F.coalesce("issues", F.lit(0))}).items()])
        return pages.join(found, ["crawl_id", "url"], "left").select("crawl_id", "url", F.explode(values).alias("m")).select("crawl_id", "url", "m.metric", c("m.v").alias(name))

    both = side(static, static_issues, "static").join(side(rendered, rendered_issues, "rendered"), ["crawl_id", "url", "metric"])
    return both.withColumn("delta", c("rendered") - c("static"))


def crawl_answer(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """One row a crawl: score, grade and verdict, findings by severity, response times, the ten categories with most findings and the ten
    worst pages (a top-k report), most first."""
    score = scoring.health_score(pages, issues).select("crawl_id", "score", "grade", "verdict")
    times = scoring.crawl_summary(pages).select("crawl_id", "pages", "mean_response_ms", "p50_response_ms", "p95_response_ms")
    totals = issues.groupBy("crawl_id").agg(F.count("*").alias("total"), *[F.count_if(c("severity") == s).alias(s) for s in SEVERITY_RANK])
    place = F.row_number().over(Window.partitionBy("crawl_id").orderBy(c("found").desc(), "category"))
    categories = scoring.category_summary(issues).withColumn("place", place).where("place <= 10")
    categories = categories.groupBy("crawl_id").agg(F.array_sort(F.collect_list(F.struct("place", "category", "found", "urls"))).alias("top_categories"))
    worst = worst_pages(pages, issues).groupBy("crawl_id").agg(F.array_sort(F.collect_list(F.struct("place", "url_key", "total"))).alias("worst_pages"))
    out = score.join(times, "crawl_id")
    for part in (totals, categories, worst):
        out = out.join(part, "crawl_id", "left")
    return out.na.fill(0, ["total", *SEVERITY_RANK])


def score_changes(pages: DataFrame, issues: DataFrame, crawls: DataFrame) -> DataFrame:
    """(crawl_a, crawl_b, score_from, score_to, score_delta, grade_from, grade_to, new_issues, resolved_issues, regressed_urls) for each
    crawl of a site and the next one."""
    score = scoring.health_score(pages, issues)
    a, b = (score.select(c("crawl_id").alias(f"crawl_{k}"), c("score").alias(f"score_{w}"), c("grade").alias(f"grade_{w}")) for k, w in (("a", "from"), ("b", "to")))
    of = lambda change: F.count_if(c("change") == change)
    counted = compare_consecutive(pages, issues, crawls, compat=True).groupBy("crawl_a", "crawl_b").agg(
        of("new").alias("new_issues"), of("resolved").alias("resolved_issues"), F.count_distinct(F.when(c("change") == "new", c("url_key"))).alias("regressed_urls")
    )
    out = crawl_pairs(crawls).join(a, "crawl_a").join(b, "crawl_b").join(counted, ["crawl_a", "crawl_b"], "left").na.fill(0, ["new_issues", "resolved_issues", "regressed_urls"])
    return out.withColumn("score_delta", c("score_to") - c("score_from"))


def list_crawls(crawls: DataFrame, domain: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Stored crawls, newest first, of one domain or of all: one page of 1 to 200."""
    chosen = crawls if domain is None else crawls.where(c("domain") == domain)
    return chosen.orderBy(c("crawl_date").desc_nulls_last(), c("crawl_id").desc()).offset(max(0, int(offset))).limit(min(200, max(1, int(limit))))


def csv_rows(pages: DataFrame) -> DataFrame:
    """The flat export, one row a page, its 31 columns in their order after the crawl's id; absent texts are empty, absent counts 0.
    Text that a spreadsheet would take for a formula gets an apostrophe."""
    text = lambda x: F.coalesce(F.when(x.rlike(FORMULA_STARTS), F.concat(F.lit("'"), x)).otherwise(x), F.lit(""))
    number = lambda x: F.coalesce(x, F.lit(0))
    size = lambda a: F.when(c(a).isNull(), 0).otherwise(F.size(c(a)))
    # Ties go to the even digit.
    fixed = lambda x, n: F.coalesce(F.bround(x.cast("double").cast("decimal(30,15)"), n).cast("string"), F.lit(""))
    blocking = F.size(F.filter(F.coalesce("scripts", F.array()), lambda s: ~s["is_async"] & ~s["is_defer"] & ~s["is_module"]))
    columns = {
        "url": text(c("url")), "status": c("status"), "title": text(c("title")), "title_length": number(c("title_length")),
        "meta_description": text(c("meta_description")), "meta_description_length": number(c("meta_description_length")),
        "h1_count": size("h1"), "h1_text": text(F.array_join("h1", "; ")), "word_count": number(c("word_count")), "response_time_ms": number(c("response_time_ms")),
        "depth": number(c("depth")), "canonical": text(c("canonical")), "is_https": c("is_https"), "internal_links": size("internal_links"),
        "external_links": size("external_links"), "images": size("images"), "images_missing_alt": without_alt(c("images")),
        "has_schema": size("schema_types") > 0, "schema_types": text(F.array_join("schema_types", "; ")), "meta_robots": text(c("meta_robots")),
        "x_robots_tag": text(c("x_robots_tag")), "is_indexable": c("indexable"), "hreflang_count": size("hreflang_tags"),
        "readability_score": fixed(c("readability_score"), 1), "lcp_ms": fixed(c("lcp_ms"), 0), "inp_ms": fixed(c("inp_ms"), 0), "cls": fixed(c("cls"), 3),
        "performance_score": F.coalesce(c("performance_score").cast("string"), F.lit("")), "script_count": size("scripts"),
        "render_blocking_scripts": blocking, "console_error_count": size("console_errors"),
    }
    return pages.select("crawl_id", *[v.cast("string").alias(k) for k, v in columns.items()])


def write_csv(pages: DataFrame, folder: str) -> None:
    csv_rows(pages).write.partitionBy("crawl_id").mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)


def write_json(pages: DataFrame, folder: str, body_text: bool = True) -> None:
    """Pages as JSON lines, a folder a crawl; without body_text the texts are blank."""
    kept = pages if body_text else pages.withColumn("body_text", F.lit(""))
    kept.write.partitionBy("crawl_id").mode("overwrite").option("ignoreNullFields", False).json(folder)
