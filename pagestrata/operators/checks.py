"""The quality checks over audit-ready pages.

Row-local checks are one projection: an array of findings a page, exploded once, so that any number of
them costs one scan. Checks that compare pages are joins and counts within a crawl. Every finding is a row
(crawl_id, category, check, severity, url, detail); site-level findings have no url.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions import text, urls
from pagestrata.operators import relations
from pagestrata.plans.check_catalog import SEVERITY
from pagestrata.runtime import ship

ISSUE = ["crawl_id", "category", "check", "severity", "url", "detail"]
# Statuses that refuse a crawler rather than break a page; anchors that say nothing; limits.
REFUSED = [401, 403, 429]
EMPTY_ANCHORS = ["click here", "read more", "learn more", "here", "link", "more", "continue", "click", "this"]
UNSAFE_REFERRER = ["unsafe-url", "no-referrer-when-downgrade"]

c = F.col


def _n(array: str) -> Column:
    return F.when(c(array).isNull(), 0).otherwise(F.size(c(array)))


def _any(array: str, test) -> Column:
    return F.exists(c(array), test)


def _blank(column: Column) -> Column:
    return column.isNull() | (F.trim(column) == "")


def needs_alt(image: Column) -> Column:
    """Whether an image says something: no data URI, and not known to be a pixel or a spacer by both its dimensions."""
    decorative = image["width"].isNotNull() & image["height"].isNotNull() & ((image["width"] <= 1) | (image["height"] <= 1))
    return ~F.coalesce(F.lower(F.ltrim(image["src"])).startswith("data:"), F.lit(False)) & ~decorative


def without_alt(images: Column) -> Column:
    """How many images need a text and have none."""
    return F.size(F.filter(F.coalesce(images, F.array()), lambda i: i["alt"].isNull() & needs_alt(i)))


def row_checks(languages: list[str], countries: list[str]) -> list[tuple[str, str, Column, Column | None]]:
    """(category, check, predicate, detail) of every check that one page decides by itself."""
    html, index, ok, url = c("is_html"), c("indexable"), c("is_ok"), c("url")
    path = urls.path_of(url)
    bare_path = F.regexp_replace(path, "%[0-9A-Fa-f]{2}", "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    via = F.coalesce(F.concat(F.lit(", via redirect from "), F.get("chain_urls", 0)), F.lit(""))
    status_detail = F.concat(F.lit("status "), c("status").cast("string"), via)
    hops = _n("redirect_chain")
    first_hop = F.concat_ws(" -> ", F.concat(c("chain_urls"), F.array(url)))
    headers = c("security_headers")
    lengths = lambda name: F.concat(c(name).cast("string"), F.lit(" characters"))
    pixels = lambda name: F.concat(c(name).cast("string"), F.lit(" px"))
    wide_title, wide_description = text.is_full_width_text(c("title")), text.is_full_width_text(c("meta_description"))
    has_title, has_description = F.length("title") > 0, F.length("meta_description") > 0
    levels = F.transform("headings", lambda h: h["level"])
    jumps = F.exists(F.transform(F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0))), lambda x, i: x - F.get(levels, i)), lambda d: d > 1)
    effective = c("canonical").isNotNull() & c("canonical_source").isNotNull()
    meta = F.coalesce("meta_robots_directives", F.array().cast("array<string>"))
    scoped = F.coalesce(c("x_robots_tag").rlike(r"(?i)^\s*(?!max-snippet|max-image-preview|max-video-preview|unavailable_after)[a-z0-9_-]+\s*:"), F.lit(False))
    heard = F.when(scoped, meta).otherwise(c("directives"))
    said = F.concat(meta, F.filter(F.split(F.lower(F.coalesce("x_robots_tag", F.lit(""))), r"[,\s]+"), lambda t: t != ""))
    said = F.flatten(F.transform(said, lambda t: F.when(t == "none", F.array(F.lit("noindex"), F.lit("nofollow"))).when(t == "all", F.array(F.lit("index"), F.lit("follow"))).otherwise(F.array(t))))
    both = (F.size(meta) > 0) & c("x_robots_tag").isNotNull() & ~scoped
    has = lambda name: F.array_contains(said, name)
    index_conflict = both & has("index") & has("noindex")
    langs = F.transform("hreflang_tags", lambda t: F.lower(t["lang"]))
    links, all_links = c("internal_links"), F.concat(F.coalesce("internal_links", F.array()), F.coalesce("external_links", F.array()))
    anchors = lambda test: F.transform(F.filter(links, test), lambda l: l["url"])
    # Lists are joined once a finding, after the explode.
    sample = _List
    blocking = F.filter("scripts", lambda s: s["src"].isNotNull() & s["in_head"] & ~s["is_async"] & ~s["is_defer"] & ~s["is_module"])
    inline = F.aggregate(F.coalesce("scripts", F.array()), F.lit(0).cast("long"), lambda n, s: n + F.when(s["src"].isNull(), F.coalesce(s["size_bytes"], F.lit(0))).otherwise(0))
    foreign = F.size(F.filter("scripts", lambda s: s["is_third_party"]))
    errors = _n("console_errors")

    return [
        ("response_codes", "internal_server_error", c("status").between(500, 599), status_detail),
        ("response_codes", "internal_client_error", c("status").between(400, 499) & ~c("status").isin(REFUSED), status_detail),
        ("response_codes", "internal_access_restricted", c("status").isin(REFUSED), status_detail),
        ("response_codes", "internal_no_response", c("status") == 0, None),
        ("security", "http_urls", ~c("is_https"), None),
        ("security", "mixed_content", _n("mixed_content") > 0, sample(c("mixed_content"))),
        ("security", "insecure_form_action", _n("insecure_forms") > 0, sample(c("insecure_forms"))),
        ("security", "form_on_http", ~c("is_https") & (_n("insecure_forms") > 0), None),
        ("security", "unsafe_cross_origin", _n("unsafe_cross_origin_links") > 0, sample(c("unsafe_cross_origin_links"))),
        ("security", "missing_hsts", c("is_https") & ~headers["hsts"], None),
        ("security", "missing_csp", ~headers["csp"], None),
        ("security", "missing_x_content_type_options", ~headers["x_content_type_options"], None),
        ("security", "missing_x_frame_options", ~headers["x_frame_options"], None),
        ("security", "missing_referrer_policy", ~headers["referrer_policy"] | F.lower(headers["referrer_value"]).isin(UNSAFE_REFERRER), headers["referrer_value"]),
        ("url", "contains_space", url.contains("%20") | url.contains(" "), None),
        ("url", "over_115_chars", F.octet_length(url) > 115, F.concat(F.octet_length(url).cast("string"), F.lit(" bytes"))),
        ("url", "contains_uppercase", bare_path.rlike("[A-Z]"), None),
        ("url", "contains_underscores", path.contains("_"), None),
        ("url", "has_parameters", url.contains("?"), None),
        ("url", "multiple_slashes", path.contains("//"), None),
        ("url", "non_ascii", path.rlike(r"[^\x00-\x7F]|%[89A-Fa-f][0-9A-Fa-f]"), None),
        ("url", "repetitive_path", F.size(F.array_distinct(segments)) < F.size(segments), None),
        ("url", "ga_tracking_params", urls.has_utm(url), None),
        ("page_titles", "missing", html & ~F.coalesce(has_title, F.lit(False)), None),
        ("page_titles", "multiple_tags", index & (c("title_count") > 1), F.concat(c("title_count").cast("string"), F.lit(" titles"))),
        ("page_titles", "outside_head", index & c("title").isNotNull() & ~c("title_in_head"), None),
        ("page_titles", "over_60_chars", index & ~wide_title & (c("title_length") > 60), lengths("title_length")),
        ("page_titles", "below_30_chars", index & has_title & ~wide_title & (c("title_length") < 30), lengths("title_length")),
        ("page_titles", "over_561_pixels", index & (c("title_pixel_width") > 561), pixels("title_pixel_width")),
        ("page_titles", "below_200_pixels", index & has_title & (c("title_pixel_width") < 200), pixels("title_pixel_width")),
        ("meta_description", "missing", html & ~F.coalesce(has_description, F.lit(False)), None),
        ("meta_description", "multiple_tags", index & (c("meta_description_count") > 1), None),
        ("meta_description", "outside_head", index & c("meta_description").isNotNull() & ~c("meta_desc_in_head"), None),
        ("meta_description", "over_155_chars", index & ~wide_description & (c("meta_description_length") > 155), lengths("meta_description_length")),
        ("meta_description", "below_70_chars", index & has_description & ~wide_description & (c("meta_description_length") < 70), lengths("meta_description_length")),
        ("meta_description", "over_985_pixels", index & (c("meta_description_pixel_width") > 985), pixels("meta_description_pixel_width")),
        ("headings", "h1_missing", html & F.forall(F.coalesce("h1", F.array().cast("array<string>")), lambda h: F.trim(h) == ""), None),
        ("headings", "h1_multiple", index & (_n("h1") > 1), F.concat(_n("h1").cast("string"), F.lit(" h1"))),
        ("headings", "h1_same_as_title", (F.get("h1", 0) == c("title")) & has_title, None),
        ("headings", "h1_over_70_chars", index & _any("h1", lambda h: F.char_length(h) > 70), None),
        ("headings", "h2_missing", html & c("headings").isNotNull() & ~_any("headings", lambda h: h["level"] == 2), None),
        ("headings", "h2_over_70_chars", index & _any("headings", lambda h: (h["level"] == 2) & (F.char_length(h["text"]) > 70)), None),
        ("headings", "non_sequential", (F.get(levels, 0) > 1) | jumps, sample(F.transform(levels, lambda x: F.concat(F.lit("h"), x.cast("string"))))),
        ("content", "soft_404", c("is_soft_404"), None),
        ("content", "low_content", (c("word_count") < 100) & c("is_html"), F.concat(c("word_count").cast("string"), F.lit(" words"))),
        ("content", "readability_very_difficult", c("readability_score") < 10, None),
        ("content", "readability_difficult", (c("readability_score") >= 10) & (c("readability_score") < 30), None),
        ("images", "missing_alt_attribute", ok & _any("images", lambda i: i["alt"].isNull() & needs_alt(i)), sample(F.transform(F.filter("images", lambda i: i["alt"].isNull() & needs_alt(i)), lambda i: i["src"]))),
        ("images", "alt_over_100_chars", ok & _any("images", lambda i: F.char_length(i["alt"]) > 100), None),
        ("images", "missing_dimensions", ok & _any("images", lambda i: i["width"].isNull() | i["height"].isNull()), None),
        ("canonicals", "canonical_outside_head", index & c("canonical").isNotNull() & c("canonical_source").isNull(), c("canonical")),
        ("canonicals", "multiple_conflicting", c("canonical_count") > 1, None),
        ("canonicals", "canonical_relative", c("canonical_is_relative"), c("canonical")),
        ("canonicals", "canonical_mismatch", c("canonical_source") == "both", None),
        ("canonicals", "missing", html & c("canonical").isNull(), None),
        ("canonicals", "canonicalised", effective & ~c("has_self_canonical"), c("canonical")),
        ("directives", "conflicting_directives", index_conflict, sample(said)),
        ("directives", "conflicting_follow_directives", both & ~index_conflict & has("follow") & has("nofollow"), sample(said)),
        *[("directives", d, F.array_contains(heard, d), None) for d in ("noindex", "nofollow", "none", "nosnippet", "noimageindex")],
        ("directives", "noai_directive", F.arrays_overlap("directives", F.lit(["noai", "noimageai"])), sample(c("directives"))),
        ("hreflang", "incorrect_lang_codes", _any("hreflang_tags", lambda t: ~text.is_language_tag(t["lang"], languages, countries)), sample(langs)),
        ("hreflang", "multiple_entries", F.size(F.array_distinct(langs)) < F.size(langs), None),
        ("hreflang", "missing_self_reference", (_n("hreflang_tags") > 0) & ~_any("hreflang_tags", lambda t: urls.norm_url(t["url"]) == c("url_key")), None),
        ("hreflang", "missing_x_default", (_n("hreflang_tags") > 0) & ~F.array_contains(langs, "x-default"), None),
        ("links", "localhost_outlinks", F.exists(all_links, lambda l: urls.is_local_host(l["url"])), sample(F.transform(F.filter(all_links, lambda l: urls.is_local_host(l["url"])), lambda l: l["url"]))),
        ("links", "no_internal_outlinks", html & (_n("internal_links") == 0), None),
        ("links", "no_anchor_text", ok & _any("internal_links", lambda l: _blank(l["anchor"])), sample(anchors(lambda l: _blank(l["anchor"])))),
        ("links", "non_descriptive_anchor", ok & _any("internal_links", lambda l: F.lower(F.trim(l["anchor"])).isin(EMPTY_ANCHORS)), sample(anchors(lambda l: F.lower(F.trim(l["anchor"])).isin(EMPTY_ANCHORS)))),
        ("links", "internal_nofollow", ok & _any("internal_links", lambda l: l["nofollow"]), sample(anchors(lambda l: l["nofollow"]))),
        ("links", "high_crawl_depth", c("depth") > 4, F.concat(F.lit("depth "), c("depth").cast("string"))),
        ("links", "high_external_outlinks", _n("external_links") > 100, None),
        ("structured_data", "parse_errors", _any("structured_data", lambda s: s["parse_error"].isNotNull()), None),
        ("structured_data", "missing_required", _any("structured_data", lambda s: F.size(s["missing_required"]) > 0), None),
        ("structured_data", "missing", html & c("structured_data").isNotNull() & (F.size("structured_data") == 0), None),
        ("performance", "slow_server_response", html & (c("response_time_ms") >= 1500), F.concat(c("response_time_ms").cast("string"), F.lit(" ms"))),
        ("performance", "cwv_lcp_poor", c("lcp_ms") > 4000, None),
        ("performance", "cwv_lcp_needs_work", (c("lcp_ms") > 2500) & (c("lcp_ms") <= 4000), None),
        ("performance", "cwv_inp_poor", c("inp_ms") > 500, None),
        ("performance", "cwv_inp_needs_work", (c("inp_ms") > 200) & (c("inp_ms") <= 500), None),
        ("performance", "cwv_cls_poor", c("cls") > 0.25, None),
        ("performance", "cwv_cls_needs_work", (c("cls") > 0.1) & (c("cls") <= 0.25), None),
        ("performance", "cwv_fcp_slow", c("fcp_ms") > 3000, None),
        ("performance", "cwv_ttfb_slow", c("ttfb_ms") > 800, None),
        ("performance", "cwv_score_poor", c("performance_score") < 50, None),
        ("performance", "cwv_score_needs_work", (c("performance_score") >= 50) & (c("performance_score") < 90), None),
        *[("javascript", f"js_injected_{x}", c(f"js_injected_{x}"), None) for x in ("title", "description", "canonical", "h1", "structured_data")],
        ("javascript", "js_render_blocking", F.size(blocking) > 0, sample(F.transform(blocking, lambda s: s["src"]))),
        ("javascript", "js_excessive_scripts", (_n("scripts") > 20) | (inline > 102_400), None),
        ("javascript", "js_third_party_heavy", foreign > 10, None),
        ("javascript", "js_console_errors", errors.between(1, 5), sample(c("console_errors"))),
        ("javascript", "js_console_errors_critical", errors > 5, sample(c("console_errors"))),
    ]


def _redirect_checks() -> list[tuple[str, str, Column, Column, Column]]:
    """(category, check, predicate, url, detail): filed under the address that was requested first."""
    hops = _n("redirect_chain")
    first = F.get("chain_urls", 0)
    walk = F.concat(c("chain_urls"), F.array(c("url")))
    path = text.hop_path(walk)
    loop = F.size(F.array_distinct("chain_urls")) < F.size("chain_urls")
    return [
        ("response_codes", "internal_redirect_loop", loop, first, path),
        ("response_codes", "internal_redirect_chain", hops >= 2, first, F.concat(hops.cast("string"), F.lit(" hops: "), path)),
        ("response_codes", "internal_redirect", hops == 1, first, path),
    ]


def _found(spark) -> Column:
    """Array of a page's findings. The expression is built once a process: it does not depend on the pages."""
    return _built(id(spark.sparkContext._gateway), *map(tuple, text.iso_codes(spark)))


@functools.lru_cache(maxsize=4)
def _built(_gateway: int, languages: tuple[str, ...], countries: tuple[str, ...]) -> Column:
    found = []
    plain = [(a, b, p, c("url"), d) for a, b, p, d in row_checks(list(languages), list(countries))]
    for category, check, predicate, url, detail in plain + _redirect_checks():
        finding = F.struct(
            F.lit(category).alias("category"), F.lit(check).alias("check"), F.lit(SEVERITY[category, check]).alias("severity"),
            url.alias("url"), _plain(detail).alias("text"), _items(detail).alias("items"), _size(detail).alias("of"),
        )
        found.append(F.when(predicate, finding))
    return F.array_compact(F.array(*found))


def row_issues(pages: DataFrame) -> DataFrame:
    """Findings of all row-local checks, from one pass over the pages."""
    one = pages.select("crawl_id", F.explode(_found(pages.sparkSession)).alias("f"))
    detail = F.coalesce("f.text", text.detail_sample(c("f.items"), c("f.of")))
    return one.select("crawl_id", "f.category", "f.check", "f.severity", "f.url", detail.alias("detail"))


class _List:
    """Detail of several items: a bounded sample of them is shown, with how many there are."""

    def __init__(self, items: Column):
        self.items = items


def _items(detail) -> Column:
    return (F.slice(detail.items, 1, 10) if isinstance(detail, _List) else F.lit(None)).cast("array<string>")


def _plain(detail) -> Column:
    return (F.lit(None) if detail is None or isinstance(detail, _List) else detail).cast("string")


def _size(detail) -> Column:
    return F.size(detail.items) if isinstance(detail, _List) else F.lit(1)


def _issue(df: DataFrame, category: str, check: str, detail: Column | None = None, url: str | None = "url") -> DataFrame:
    return df.select(
        "crawl_id", F.lit(category).alias("category"), F.lit(check).alias("check"), F.lit(SEVERITY[category, check]).alias("severity"),
        (c(url) if url else F.lit(None)).cast("string").alias("url"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    )


def duplicate_issues(pages: DataFrame) -> DataFrame:
    """Titles, descriptions, first and second level headings and contents that several pages share.

    All kinds of values go through one count and one join: values are counted first and met in the join, so one that most pages
    share is never gathered in one place.
    """

    def value(category: str, check: str, column: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(check).alias("check"), F.lit(SEVERITY[category, check]).alias("severity"), column.alias("value"))

    own = F.when(c("redirect_chain").isNull() & c("has_body") & (c("word_count") > 0), c("content_hash"))
    single = [
        value("page_titles", "duplicate", c("title")), value("meta_description", "duplicate", c("meta_description")),
        value("headings", "h1_duplicate", F.get("h1", 0)), value("content", "exact_duplicate", own),
    ]
    h2 = F.array_distinct(F.transform(F.filter(F.coalesce("headings", F.array()), lambda h: h["level"] == 2), lambda h: h["text"]))
    every = F.filter(F.concat(F.array(*single), F.transform(h2, lambda x: value("headings", "h2_duplicate", x))), lambda v: F.length(v["value"]) > 0)
    rows = pages.where("indexable").select("crawl_id", "url", F.explode(every).alias("v")).select("crawl_id", "url", "v.*")
    key = ["crawl_id", "category", "check", "severity", "value"]
    shared = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    detail = F.when(c("check") == "h2_duplicate", c("value")).otherwise(F.concat(F.lit("shared by "), c("n").cast("string"), F.lit(" pages")))
    return rows.join(shared, key).select(*ISSUE[:-1], detail.alias("detail"))


def canonical_issues(pages: DataFrame) -> DataFrame:
    """Loops (two pages that name each other), chains (a third page is reached) and targets that cannot be indexed."""
    targets = relations.last_by_key(pages).select(
        "crawl_id", c("url_key").alias("key"), c("status").alias("t_status"), c("noindex").alias("t_noindex"),
        F.when(c("canonical_source").isNotNull(), urls.norm_url(c("canonical"))).alias("next_key"),
    )
    start = pages.where(c("canonical").isNotNull() & c("canonical_source").isNotNull()).select("crawl_id", "url", "url_key", "is_ok", urls.norm_url(c("canonical")).alias("key"))
    start = start.where("key <> url_key")
    hop = start.join(targets, ["crawl_id", "key"])
    walked = hop.where(c("next_key").isNotNull() & (c("next_key") != c("key")))
    loop = _issue(walked.where("next_key = url_key"), "canonicals", "canonical_loop", c("key"))
    chain = _issue(walked.where("next_key <> url_key"), "canonicals", "canonical_chain", F.concat_ws(" -> ", "url_key", "key", "next_key"))
    dead = hop.where(c("is_ok") & ((c("t_status") >= 400) | c("t_noindex")))
    return loop.unionByName(chain).unionByName(_issue(dead, "canonicals", "non_indexable_target", c("key")))


def hreflang_issues(pages: DataFrame) -> DataFrame:
    """Alternates that do not link back, do not answer 200, are canonicalised or noindexed, or name themselves otherwise."""
    tags = pages.select("crawl_id", "url", "url_key", F.posexplode("hreflang_tags").alias("pos", "tag")).select(
        "crawl_id", "url", "url_key", "pos", F.lower("tag.lang").alias("lang"), urls.norm_url(c("tag.url")).alias("key")
    )
    own = tags.where("key = url_key").groupBy("crawl_id", "key").agg(F.min_by("lang", "pos").alias("own_lang"))
    targets = relations.last_by_key(pages).select(
        "crawl_id", c("url_key").alias("key"), c("status").alias("t_status"), c("noindex").alias("t_noindex"),
        (c("canonical").isNotNull() & (urls.norm_url(c("canonical")) != c("url_key"))).alias("t_elsewhere"),
    ).join(own, ["crawl_id", "key"], "left")
    met = tags.join(targets, ["crawl_id", "key"])
    other = met.where("key <> url_key")
    back = tags.select("crawl_id", c("url_key").alias("key"), c("key").alias("url_key")).distinct()
    per_page = lambda df, check: _issue(df.groupBy("crawl_id", "url").agg(F.array_sort(F.collect_set("key")).alias("keys")), "hreflang", check, text.detail_sample(c("keys")))
    parts = [
        per_page(other.join(back, ["crawl_id", "key", "url_key"], "left_anti"), "missing_return_links"),
        per_page(met.where("t_status <> 200"), "non_200_urls"),
        per_page(other.where("t_elsewhere"), "non_canonical_urls"),
        per_page(other.where("t_noindex"), "noindex_urls"),
        per_page(other.where("own_lang is not null and own_lang <> lang"), "conflicting_lang_declarations"),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def link_issues(pages: DataFrame) -> DataFrame:
    """Links that end in an error, and pages that no other page links to."""
    links = relations.resolved_links(pages)
    bad = pages.where((c("status") >= 400) & ~c("status").isin(REFUSED)).groupBy("crawl_id", c("url_key").alias("target")).agg(F.max("status").alias("target_status"))
    broken = links.where("is_ok").join(bad, ["crawl_id", "target"]).groupBy("crawl_id", "url").agg(F.array_sort(F.collect_set("link")).alias("links"))
    reached = links.where("target <> url_key").select("crawl_id", c("target").alias("url_key")).distinct()
    orphans = pages.where(c("is_ok") & (c("depth") > 0)).select("crawl_id", "url", "url_key").join(reached, ["crawl_id", "url_key"], "left_anti")
    return _issue(broken, "links", "broken_internal", text.detail_sample(c("links"))).unionByName(_issue(orphans, "links", "orphan_pages"))


def sitemap_issues(pages: DataFrame, entries: DataFrame, sources: DataFrame, problems: DataFrame) -> DataFrame:
    """Sitemap checks. entries (crawl_id, url, source); sources (crawl_id, source, url_count, size_bytes);
    problems (crawl_id, kind, url), kind one of discovered, truncated, malformed, unreachable, invalid_loc."""
    crawls = problems.where("kind = 'discovered'").select("crawl_id").distinct()
    none = crawls.join(sources.select("crawl_id").distinct(), "crawl_id", "left_anti")
    keyed = entries.select("crawl_id", c("url").alias("entry"), "source", urls.norm_url(c("url")).alias("url_key"))
    target = relations.last_by_key(pages).select("crawl_id", "url_key", "status", "noindex")
    dead = keyed.select("crawl_id", "entry", "url_key").distinct().join(target, ["crawl_id", "url_key"]).where((c("status") >= 400) | c("noindex"))
    partial = problems.where("kind in ('truncated', 'malformed')").select("crawl_id").distinct()
    listed = pages.where(c("indexable") & (c("canonical").isNull() | F.coalesce("has_self_canonical", F.lit(False)))).select("crawl_id", "url", "url_key")
    absent = listed.join(entries.select("crawl_id").distinct(), "crawl_id", "left_semi").join(partial, "crawl_id", "left_anti").join(keyed.select("crawl_id", "url_key"), ["crawl_id", "url_key"], "left_anti")
    several = keyed.select("crawl_id", "entry", "source").distinct().groupBy("crawl_id", "entry").agg(F.array_sort(F.collect_list("source")).alias("sources")).where(F.size("sources") > 1)
    kinds = {"unreachable": "sitemap_unreachable", "malformed": "sitemap_parse_error", "invalid_loc": "sitemap_invalid_loc"}
    parts = [
        _issue(none, "sitemaps", "no_sitemap_found", url=None),
        *[_issue(problems.where(c("kind") == k), "sitemaps", check) for k, check in kinds.items()],
        _issue(sources.where("url_count = 0"), "sitemaps", "sitemap_empty", url="source"),
        _issue(dead, "sitemaps", "non_indexable_in_sitemap", F.when(c("status") >= 400, F.concat(F.lit("status "), c("status").cast("string"))).otherwise("noindex"), "entry"),
        _issue(sources.where("url_count > 50000"), "sitemaps", "over_50k_urls", c("url_count"), "source"),
        _issue(sources.where("size_bytes > 50000000"), "sitemaps", "over_50mb", c("size_bytes"), "source"),
        _issue(absent, "sitemaps", "urls_not_in_sitemap"),
        _issue(several, "sitemaps", "url_in_multiple_sitemaps", text.detail_sample(c("sources")), "entry"),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def robots_issues(robots: DataFrame) -> DataFrame:
    """AI crawlers that a robots.txt names and blocks at the root. robots: (crawl_id, robots_txt)."""
    from pagestrata.sources.robots import blocked_ai_crawlers

    ship(robots.sparkSession)
    blocked = F.udf(blocked_ai_crawlers, "array<string>", useArrow=True)
    named = robots.where(F.lower("robots_txt").contains("user-agent")).select("crawl_id", blocked("robots_txt").alias("blocked")).where(F.size("blocked") > 0)
    return _issue(named, "directives", "ai_crawlers_blocked", text.detail_sample(c("blocked")), url=None)


def page_issues(pages: DataFrame) -> DataFrame:
    """All findings that pages alone decide, over audit-ready pages."""
    parts = [row_issues(pages), duplicate_issues(pages), canonical_issues(pages), hreflang_issues(pages), link_issues(pages)]
    return functools.reduce(DataFrame.unionByName, parts)
