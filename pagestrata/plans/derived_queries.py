"""Queries over the derived pages, so that every check has findings, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.operators import checks, scoring, surface
from pagestrata.plans import derived
from pagestrata.plans.audit_sql import ALIASES, BASE as AUDIT_BASE, DUPLICATES, LINK_ISSUES, LINKS, NEEDS_ALT, ORACLE as AUDIT, PREDICATES, REDIRECTS, SEVERITIES, WITH_ISSUES, _length, _px, _redirect, _row, norm
from pagestrata.runtime import table, written
from pagestrata.sources import sitemaps
from pagestrata.sources.snapshots import audit_pages

c = F.col


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_pages(derived.pages(spark, sf_dir))


def row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.row_issues(pages(spark, sf_dir)).drop("detail")


def row_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of findings: samples of lists, lengths, redirect walks."""
    shown = ["unsafe_cross_origin", "js_console_errors_critical", "internal_redirect_chain", "conflicting_directives", "localhost_outlinks", "over_115_chars", "missing_referrer_policy"]
    return checks.row_issues(pages(spark, sf_dir)).where(c("check").isin(shown)).select("crawl_id", "check", "url", "detail")


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_issues(pages(spark, sf_dir)).drop("detail", "severity")


def canonical_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.canonical_issues(pages(spark, sf_dir))


def hreflang_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.hreflang_issues(pages(spark, sf_dir))


# What stands at a crawl's sitemap addresses, by the rest of its number; {b} is the site's address.
SITEMAP_FILES = {
    0: {"sitemap.xml": "<urlset><url><loc>{b}/c/chain-c</loc></url><url><loc>{b}/c/gone</loc></url><url><loc>{b}/c/hidden</loc></url><url><loc>relative/path</loc></url></urlset>", "other.xml": "<urlset><url><loc>{b}/c/chain-c</loc></url></urlset>"},
    1: {"sitemap.xml": "<sitemapindex><sitemap><loc>{b}/part.xml</loc></sitemap><sitemap><loc>{b}/lost.xml</loc></sitemap></sitemapindex>", "part.xml": "<urlset></urlset>"},
    2: {"sitemap.xml": "<urlset><url><loc>{b}/c/chain-c</loc></url><url><loc>{b}/h/en</loc>"},
    3: {"sitemap.xml": None},
}


def _sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawls = table(spark, sf_dir, "crawls").select("crawl_id", F.expr(derived._base()).alias("b"))
    some = None
    for rest, files in SITEMAP_FILES.items():
        for name, text in files.items():
            value = F.lit(None).cast("string") if text is None else F.replace(F.lit(text), F.lit("{b}"), c("b"))
            rows = crawls.where(c("crawl_id") % 5 == rest).select("crawl_id", F.concat(c("b"), F.lit(f"/{name}")).alias("source"), value.alias("text"), F.lit(200).alias("status"))
            some = rows if some is None else some.unionByName(rows)
    return some


def sitemap_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each crawl's sitemap files; two oversized sources of crawls without files are given by their figures."""
    entries, sources, problems = sitemaps.read(_sitemap_files(spark, sf_dir))
    bare = table(spark, sf_dir, "crawls").where(c("crawl_id") % 5 == 4).select("crawl_id")
    large = bare.select("crawl_id", F.lit("https://large.example/a.xml").alias("source"), F.lit(50_001).cast("long").alias("url_count"), F.lit(50_000_000).cast("long").alias("size_bytes"))
    heavy = bare.select("crawl_id", F.lit("https://large.example/b.xml").alias("source"), F.lit(50_000).cast("long").alias("url_count"), F.lit(50_000_001).cast("long").alias("size_bytes"))
    every = sources.unionByName(large).unionByName(heavy)
    return checks.sitemap_issues(pages(spark, sf_dir), entries, every, problems).drop("severity", "detail")


# Fixed value: a robots.txt by the rest of the crawl's number, and the AI crawlers it blocks.
ROBOTS = {
    0: ("User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: *\nDisallow: /private", "GPTBot, CCBot"),
    1: ("User-agent: GPTBot\nDisallow: /\nAllow: /\n", None),
    2: ("User-agent: *\nDisallow: /\n", None),
    3: ("# nothing", None),
}


def robots_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.create_map(*[x for k, (v, _) in ROBOTS.items() for x in (F.lit(k), F.lit(v))])
    crawls = table(spark, sf_dir, "crawls").select("crawl_id", text[(c("crawl_id") % 5).cast("int")].alias("robots_txt"))
    return checks.robots_issues(crawls).drop("url")


def cwv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).withColumn("cwv_status", scoring.cwv_status(c("lcp_ms"), c("inp_ms"), c("cls")))
    return scoring.cwv_summary(p).select("crawl_id", "tested", "good", "needs_improvement", "poor", *[F.round(x, 6).alias(x) for x in ("mean_lcp_ms", "mean_cls", "mean_inp_ms")], "mean_score")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.crawl_summary(pages(spark, sf_dir))


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.csv_rows(pages(spark, sf_dir))


def _static(rendered: DataFrame) -> DataFrame:
    """A static form without every third title, fifth description, seventh heading, second canonical, fourth schema and sixth word count."""
    static = rendered
    for column, of in (("title", 3), ("meta_description", 5), ("h1", 7), ("canonical", 2), ("schema_types", 4), ("word_count", 6)):
        static = static.withColumn(column, F.when(c("page_id") % of != 0, c(column)))
    return static


def render_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static and rendered form of each page side by side; both have the findings of the rendered one."""
    rendered = pages(spark, sf_dir)
    found = checks.row_issues(rendered)
    return surface.render_deltas(_static(rendered), rendered, found, found)


def rendered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as rendered against their static form."""
    rendered = pages(spark, sf_dir)
    return surface.merge_rendered(_static(rendered), rendered).select("page_id", "url", *[f"js_injected_{x}" for x in ("title", "description", "canonical", "h1", "structured_data")], "words_gained")


def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = written(pages(spark, sf_dir).drop("body_text"), "audit-pages")
    return scoring.health_score(p, written(checks.page_issues(p), "audit-issues"))


QUERIES = {f"derived_{f.__name__}": f for f in (row_checks, row_details, duplicates, canonical_checks, hreflang_checks, sitemap_checks, robots_checks, cwv_summary, summary, csv_export, rendered_merge, render_deltas, health_score)}

# The SQL: the same table, and its own account of each check.
# Robots headers: agents before a colon are dropped, valued directives stay whole.
_X = """list_filter(list_transform(string_split(lower(coalesce(x_robots_tag, '')), ','), lambda t: CASE WHEN contains(t, ':') AND trim(split_part(t, ':', 1)) NOT IN ('max-snippet', 'max-image-preview', 'max-video-preview', 'unavailable_after')
  THEN trim(substr(t, instr(t, ':') + 1)) ELSE trim(t) END), lambda t: t <> '')"""
BASE = f"""WITH {derived.duck_pages()},
p AS (SELECT *, {norm('url')} AS url_key, {norm('canonical')} AS canonical_key, coalesce(status BETWEEN 200 AND 299, false) AS is_ok, coalesce(status BETWEEN 200 AND 299 AND regexp_matches(lower(content_type), 'text/html|application/xhtml\\+xml'), false) AS is_html,
  list_filter(list_transform(string_split(lower(coalesce(meta_robots, '')), ','), lambda t: trim(t)), lambda t: t <> '') AS meta_directives, {_X} AS header_directives FROM derived),
q AS (SELECT *, list_concat(meta_directives, header_directives) AS directives, list_has_any(list_concat(meta_directives, header_directives), ['noindex', 'none']) AS noindex,
  is_html AND NOT list_has_any(list_concat(meta_directives, header_directives), ['noindex', 'none']) AS indexable,
  {_length('title')} AS title_length, {_px('title', 17, 13, 11, 6, 11, 5)} AS title_px, {_length('meta_description')} AS md_length, {_px('meta_description', 12, 9, 8, 4, 8, 4)} AS md_px,
  regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path FROM p)"""
_SAID = "list_concat(meta_directives, list_filter(regexp_split_to_array(lower(coalesce(x_robots_tag, '')), '[,\\s]+'), lambda t: t <> ''))"
_EXPANDED = f"flatten(list_transform({_SAID}, lambda t: CASE t WHEN 'none' THEN ['noindex', 'nofollow'] WHEN 'all' THEN ['index', 'follow'] ELSE [t] END))"
_IS_SCOPED = "coalesce(regexp_matches(x_robots_tag, '^\\s*[A-Za-z0-9_-]+\\s*:') AND NOT regexp_matches(lower(x_robots_tag), '^\\s*(max-snippet|max-image-preview|max-video-preview|unavailable_after)'), false)"
_BOTH = f"len(meta_directives) > 0 AND x_robots_tag IS NOT NULL AND NOT {_IS_SCOPED}"
_HEARD = f"CASE WHEN {_IS_SCOPED} THEN meta_directives ELSE directives END"
_INDEXES = f"list_contains({_EXPANDED}, 'index') AND list_contains({_EXPANDED}, 'noindex')"
_LANGS = "list_transform(hreflang_tags, lambda t: lower(t.lang))"
_TAG = "'^([a-zA-Z]{2,3})(-[a-zA-Z]{4})?(-([a-zA-Z]{2}|[0-9]{3}))?$'"
# Of the codes that the derived pages use, those that are assigned.
_KNOWN = "t.lang ILIKE 'x-default' OR (regexp_matches(t.lang, " + _TAG + ") AND lower(regexp_extract(t.lang, " + _TAG + ", 1)) IN ('en', 'de', 'fr', 'pt', 'zh', 'es') AND upper(regexp_extract(t.lang, " + _TAG + ", 4)) IN ('', 'BR', 'TW', '419'))"
MORE = {
    "security.mixed_content": "len(mixed_content) > 0", "security.insecure_form_action": "len(insecure_forms) > 0", "security.form_on_http": "len(insecure_forms) > 0 AND NOT starts_with(lower(url), 'https://')",
    "security.unsafe_cross_origin": "len(unsafe_cross_origin_links) > 0", "security.missing_hsts": "starts_with(lower(url), 'https://') AND NOT security_headers.hsts", "security.missing_csp": "NOT security_headers.csp",
    "security.missing_x_content_type_options": "NOT security_headers.x_content_type_options", "security.missing_x_frame_options": "NOT security_headers.x_frame_options",
    "security.missing_referrer_policy": "NOT security_headers.referrer_policy OR lower(security_headers.referrer_value) IN ('unsafe-url', 'no-referrer-when-downgrade')",
    "page_titles.multiple_tags": "indexable AND title_count > 1", "page_titles.outside_head": "indexable AND title IS NOT NULL AND NOT title_in_head",
    "meta_description.multiple_tags": "indexable AND meta_description_count > 1", "meta_description.outside_head": "indexable AND meta_description IS NOT NULL AND NOT meta_desc_in_head",
    "headings.h2_missing": "is_html AND headings IS NOT NULL AND len(list_filter(headings, lambda h: h.level = 2)) = 0", "headings.h2_over_70_chars": "indexable AND len(list_filter(headings, lambda h: h.level = 2 AND length(h.text) > 70)) > 0",
    "headings.non_sequential": "headings[1].level > 1 OR len(list_filter(range(2, len(headings) + 1), lambda i: headings[i].level - headings[i - 1].level > 1)) > 0",
    "canonicals.canonical_outside_head": "indexable AND canonical IS NOT NULL AND canonical_source IS NULL", "canonicals.multiple_conflicting": "canonical_count > 1", "canonicals.canonical_relative": "canonical_is_relative",
    "canonicals.canonical_mismatch": "canonical_source = 'both'", "canonicals.canonicalised": "canonical IS NOT NULL AND canonical_source IS NOT NULL AND canonical_key <> url_key",
    "directives.conflicting_directives": f"{_BOTH} AND {_INDEXES}", "directives.conflicting_follow_directives": f"{_BOTH} AND NOT ({_INDEXES}) AND list_contains({_EXPANDED}, 'follow') AND list_contains({_EXPANDED}, 'nofollow')",
    **{f"directives.{d}": f"list_contains({_HEARD}, '{d}')" for d in ("noindex", "nofollow", "none", "nosnippet", "noimageindex")},
    "hreflang.incorrect_lang_codes": f"len(list_filter(hreflang_tags, lambda t: NOT ({_KNOWN}))) > 0", "hreflang.multiple_entries": f"len(list_distinct({_LANGS})) < len({_LANGS})",
    "hreflang.missing_self_reference": f"len(hreflang_tags) > 0 AND len(list_filter(hreflang_tags, lambda t: {norm('t.url')} = url_key)) = 0", "hreflang.missing_x_default": f"len(hreflang_tags) > 0 AND NOT list_contains({_LANGS}, 'x-default')",
    "structured_data.parse_errors": "len(list_filter(structured_data, lambda s: s.parse_error IS NOT NULL)) > 0", "structured_data.missing_required": "len(list_filter(structured_data, lambda s: len(s.missing_required) > 0)) > 0",
    "structured_data.missing": "is_html AND len(structured_data) = 0",
    "performance.cwv_lcp_poor": "lcp_ms > 4000", "performance.cwv_lcp_needs_work": "lcp_ms > 2500 AND lcp_ms <= 4000", "performance.cwv_inp_poor": "inp_ms > 500", "performance.cwv_inp_needs_work": "inp_ms > 200 AND inp_ms <= 500",
    "performance.cwv_cls_poor": "cls > 0.25", "performance.cwv_cls_needs_work": "cls > 0.1 AND cls <= 0.25", "performance.cwv_fcp_slow": "fcp_ms > 3000", "performance.cwv_ttfb_slow": "ttfb_ms > 800",
    "performance.cwv_score_poor": "performance_score < 50", "performance.cwv_score_needs_work": "performance_score BETWEEN 50 AND 89",
    **{f"javascript.js_injected_{x}": f"js_injected_{x}" for x in ("title", "description", "canonical", "h1", "structured_data")},
    "javascript.js_render_blocking": "len(list_filter(scripts, lambda s: s.src IS NOT NULL AND s.in_head AND NOT s.is_async AND NOT s.is_defer AND NOT s.is_module)) > 0",
    "javascript.js_excessive_scripts": "len(scripts) > 20 OR list_sum(list_transform(list_filter(scripts, lambda s: s.src IS NULL), lambda s: s.size_bytes)) > 102400",
    "javascript.js_third_party_heavy": "len(list_filter(scripts, lambda s: s.is_third_party)) > 10", "javascript.js_console_errors": "len(console_errors) BETWEEN 1 AND 5", "javascript.js_console_errors_critical": "len(console_errors) > 5",
}
_ALL = PREDICATES | MORE | {"directives.noai_directive": "list_has_any(directives, ['noai', 'noimageai'])"}
ROW_ISSUES = "row_issues AS (" + "\nUNION ALL ".join([_row(k, v) for k, v in _ALL.items()] + [_redirect(k, v) for k, v in REDIRECTS.items()]) + ")"
H2 = """duplicates2 AS (SELECT * FROM duplicates UNION ALL SELECT crawl_id, 'headings', 'h2_duplicate', url FROM (SELECT crawl_id, url, count(*) OVER (PARTITION BY crawl_id, k) AS n
  FROM (SELECT crawl_id, url, unnest(list_distinct(list_transform(list_filter(headings, lambda h: h.level = 2 AND h.text <> ''), lambda h: h.text))) AS k FROM q WHERE indexable)) WHERE n > 1)"""
TARGETS = "targets AS (SELECT DISTINCT ON (crawl_id, url_key) crawl_id, url_key, status AS t_status, noindex AS t_noindex, canonical_source, canonical_key FROM q ORDER BY crawl_id, url_key, page_id DESC)"
CANONICAL = f"""{TARGETS},
hop AS (SELECT s.crawl_id, s.url, s.url_key, s.is_ok, s.canonical_key AS k, t.t_status, t.t_noindex, CASE WHEN t.canonical_source IS NOT NULL THEN t.canonical_key END AS next_key
  FROM q s JOIN targets t ON t.crawl_id = s.crawl_id AND t.url_key = s.canonical_key WHERE s.canonical_source IS NOT NULL AND s.canonical_key <> s.url_key),
canonical_issues AS (SELECT crawl_id, 'canonicals' AS category, 'canonical_loop' AS "check", url, k AS detail FROM hop WHERE next_key <> k AND next_key = url_key
  UNION ALL SELECT crawl_id, 'canonicals', 'canonical_chain', url, url_key || ' -> ' || k || ' -> ' || next_key FROM hop WHERE next_key <> k AND next_key <> url_key
  UNION ALL SELECT crawl_id, 'canonicals', 'non_indexable_target', url, k FROM hop WHERE is_ok AND (t_status >= 400 OR t_noindex))"""
HREFLANG = f"""tags AS (SELECT crawl_id, url, url_key, lower(t.lang) AS lang, {norm('t.url')} AS k, pos FROM (SELECT crawl_id, url, url_key, unnest(hreflang_tags) AS t, generate_subscripts(hreflang_tags, 1) AS pos FROM q)),
own_tags AS (SELECT crawl_id, k, arg_min(lang, pos) AS own_lang FROM tags WHERE k = url_key GROUP BY ALL),
met AS (SELECT g.*, t.t_status, t.t_noindex, coalesce(t.canonical_key <> t.url_key, false) AS elsewhere, o.own_lang FROM tags g JOIN targets t ON t.crawl_id = g.crawl_id AND t.url_key = g.k LEFT JOIN own_tags o ON o.crawl_id = g.crawl_id AND o.k = g.k),
told AS (SELECT crawl_id, url, 'missing_return_links' AS "check", k FROM met m WHERE k <> url_key AND NOT EXISTS (SELECT 1 FROM tags b WHERE b.crawl_id = m.crawl_id AND b.url_key = m.k AND b.k = m.url_key)
  UNION ALL SELECT crawl_id, url, 'non_200_urls', k FROM met WHERE t_status <> 200 UNION ALL SELECT crawl_id, url, 'non_canonical_urls', k FROM met WHERE k <> url_key AND elsewhere
  UNION ALL SELECT crawl_id, url, 'noindex_urls', k FROM met WHERE k <> url_key AND t_noindex UNION ALL SELECT crawl_id, url, 'conflicting_lang_declarations', k FROM met WHERE k <> url_key AND own_lang <> lang),
hreflang_issues AS (SELECT crawl_id, 'hreflang' AS category, "check", url, array_to_string(list_sort(list_distinct(list(k))), ', ') AS detail FROM told GROUP BY crawl_id, "check", url)"""
WITH_DERIVED_ISSUES = f"""{BASE.replace('WITH ', 'WITH RECURSIVE ', 1)}, {ALIASES}, {LINKS}, {ROW_ISSUES}, {DUPLICATES}, {H2}, {LINK_ISSUES}, {CANONICAL}, {HREFLANG}, {SEVERITIES},
issues AS (SELECT i.*, s.severity, s.tier FROM (SELECT crawl_id, category, "check", url FROM row_issues UNION ALL SELECT * FROM duplicates2 UNION ALL SELECT * FROM link_issues
  UNION ALL SELECT crawl_id, category, "check", url FROM canonical_issues UNION ALL SELECT crawl_id, category, "check", url FROM hreflang_issues) i JOIN severities s USING (category, "check"))"""
_B = derived._base()
_OF = lambda *rests: f"crawl_id % 5 IN ({', '.join(map(str, rests))})"
_PAGE = lambda rest, path: f"SELECT crawl_id, {_B} || '{path}' AS url FROM crawls WHERE {_OF(rest)}"
SITEMAPS = f"""found AS (SELECT crawl_id, 'no_sitemap_found' AS "check", NULL AS url FROM crawls WHERE {_OF(3)}
UNION ALL SELECT crawl_id, 'sitemap_unreachable', url FROM ({_PAGE(3, '/sitemap.xml')} UNION ALL {_PAGE(1, '/lost.xml')})
UNION ALL SELECT crawl_id, 'sitemap_parse_error', url FROM ({_PAGE(2, '/sitemap.xml')}) UNION ALL SELECT crawl_id, 'sitemap_invalid_loc', 'relative/path' FROM crawls WHERE {_OF(0)}
UNION ALL SELECT crawl_id, 'sitemap_empty', url FROM ({_PAGE(1, '/part.xml')})
UNION ALL SELECT crawl_id, 'non_indexable_in_sitemap', url FROM ({_PAGE(0, '/c/gone')} UNION ALL {_PAGE(0, '/c/hidden')})
UNION ALL SELECT crawl_id, 'over_50k_urls', 'https://large.example/a.xml' FROM crawls WHERE {_OF(4)} UNION ALL SELECT crawl_id, 'over_50mb', 'https://large.example/b.xml' FROM crawls WHERE {_OF(4)}
UNION ALL SELECT crawl_id, 'url_in_multiple_sitemaps', url FROM ({_PAGE(0, '/c/chain-c')})
UNION ALL SELECT crawl_id, 'urls_not_in_sitemap', url FROM q WHERE {_OF(0)} AND indexable AND (canonical IS NULL OR canonical_key = url_key) AND url NOT LIKE '%/c/chain-c')"""
_GUARD = lambda x: f"coalesce(CASE WHEN regexp_matches({x}, '^[=+@\\t\\r-]') THEN chr(39) || {x} ELSE {x} END, '')"
_SIZE = lambda x: f"coalesce(len({x}), 0)"
_FIXED = lambda x, n: f"coalesce(format('{{:.{n}f}}', {x}::DOUBLE), '')"
_NO_ALT = f"coalesce(len(list_filter(images, lambda i: i.alt IS NULL AND {NEEDS_ALT})), 0)"
CSV = {
    "url": _GUARD("url"), "status": "status", "title": _GUARD("title"), "title_length": "coalesce(title_length, 0)", "meta_description": _GUARD("meta_description"), "meta_description_length": "coalesce(md_length, 0)",
    "h1_count": _SIZE("h1"), "h1_text": _GUARD("array_to_string(h1, '; ')"), "word_count": "coalesce(word_count, 0)", "response_time_ms": "coalesce(response_time_ms, 0)", "depth": "coalesce(depth, 0)",
    "canonical": _GUARD("canonical"), "is_https": "starts_with(lower(url), 'https://')", "internal_links": _SIZE("internal_links"), "external_links": _SIZE("external_links"), "images": _SIZE("images"), "images_missing_alt": _NO_ALT,
    "has_schema": f"{_SIZE('schema_types')} > 0", "schema_types": _GUARD("array_to_string(schema_types, '; ')"), "meta_robots": _GUARD("meta_robots"), "x_robots_tag": _GUARD("x_robots_tag"), "is_indexable": "indexable",
    "hreflang_count": _SIZE("hreflang_tags"), "readability_score": _FIXED("readability_score", 1), "lcp_ms": _FIXED("lcp_ms", 0), "inp_ms": _FIXED("inp_ms", 0), "cls": _FIXED("cls", 3),
    "performance_score": "coalesce(performance_score::VARCHAR, '')", "script_count": _SIZE("scripts"), "render_blocking_scripts": "coalesce(len(list_filter(scripts, lambda s: NOT s.is_async AND NOT s.is_defer AND NOT s.is_module)), 0)",
    "console_error_count": _SIZE("console_errors"),
}
csv_columns = lambda made: ", ".join(f"({made.get(k, v)})::VARCHAR AS {k}" for k, v in CSV.items())
# Of fields the crawl table lacks, what the export says.
ABSENT = {"has_schema": "false", "schema_types": "''", "x_robots_tag": "''", "hreflang_count": "0", "lcp_ms": "''", "inp_ms": "''", "cls": "''", "performance_score": "''", "script_count": "0", "render_blocking_scripts": "0", "console_error_count": "0"}
_LACKED = {
    "title": "page_id % 3 = 0 AND title IS NOT NULL", "description": "page_id % 5 = 0 AND meta_description IS NOT NULL", "canonical": "page_id % 2 = 0 AND canonical IS NOT NULL",
    "h1": f"page_id % 7 = 0 AND {_SIZE('h1')} > 0", "structured_data": f"page_id % 4 = 0 AND {_SIZE('schema_types')} > 0",
}
ORACLE = {
    "csv_export": f"{AUDIT_BASE} SELECT crawl_id, {csv_columns(ABSENT)} FROM q",
    "derived_row_checks": f"{BASE}, {ROW_ISSUES} SELECT * FROM row_issues",
    "derived_row_details": f"""{BASE} SELECT crawl_id, 'unsafe_cross_origin' AS "check", url, 'https://other.example/' AS detail FROM q WHERE len(unsafe_cross_origin_links) > 0
UNION ALL SELECT crawl_id, 'js_console_errors_critical', url, 'e, e, e, e, e, e' FROM q WHERE len(console_errors) > 5
UNION ALL SELECT crawl_id, 'internal_redirect_chain', a[1], (len(a) - 1) || ' hops: ' || CASE n WHEN len(a) THEN array_to_string(a, ' -> ') ELSE array_to_string(a[:n], ' -> ') || ' -> (+' || (len(a) - n) || ' more)' END
  FROM (SELECT crawl_id, a, list_max(list_filter(range(1, len(a) + 1), lambda n: strlen(array_to_string(a[:n], ' -> ')) <= 300)) AS n FROM (SELECT crawl_id, list_append(list_transform(redirect_chain, lambda h: h.url), url) AS a FROM q WHERE len(redirect_chain) >= 2))
UNION ALL SELECT crawl_id, 'conflicting_directives', url, array_to_string({_EXPANDED}, ', ') FROM q WHERE {MORE['directives.conflicting_directives']}
UNION ALL SELECT crawl_id, 'localhost_outlinks', url, CASE page_id % 67 WHEN 2 THEN 'http://localhost/x' ELSE 'http://127.0.0.1:8080/x' END FROM q WHERE page_id % 67 IN (2, 6) AND page_id < {derived.FIRST_LINKED}
UNION ALL SELECT crawl_id, 'over_115_chars', url, strlen(url) || ' bytes' FROM q WHERE strlen(url) > 115
UNION ALL SELECT crawl_id, 'missing_referrer_policy', url, security_headers.referrer_value FROM q WHERE {MORE['security.missing_referrer_policy']}""",
    "derived_duplicates": f"{BASE}, {DUPLICATES}, {H2} SELECT * FROM duplicates2",
    "derived_canonical_checks": f'{BASE}, {CANONICAL}, {SEVERITIES} SELECT i.*, s.severity FROM canonical_issues i JOIN severities s USING (category, "check")',
    "derived_hreflang_checks": f'{BASE}, {TARGETS}, {HREFLANG}, {SEVERITIES} SELECT i.*, s.severity FROM hreflang_issues i JOIN severities s USING (category, "check")',
    "derived_sitemap_checks": f"""{BASE}, {SITEMAPS} SELECT crawl_id, 'sitemaps' AS category, "check", url FROM found""",
    "derived_robots_checks": f"""WITH {SEVERITIES} SELECT crawl_id, category, "check", severity, 'GPTBot, CCBot' AS detail FROM crawls, severities WHERE crawl_id % 5 = 0 AND "check" = 'ai_crawlers_blocked'""",
    "derived_cwv_summary": f"""{BASE}, v AS (SELECT *, CASE WHEN lcp_ms IS NULL AND cls IS NULL THEN NULL WHEN lcp_ms > 4000 OR cls > 0.25 OR inp_ms > 500 THEN 'poor' WHEN lcp_ms > 2500 OR cls > 0.1 OR inp_ms > 200 THEN 'needs_improvement' ELSE 'good' END AS s FROM q)
SELECT crawl_id, count(performance_score) AS tested, count(*) FILTER (performance_score IS NOT NULL AND s = 'good') AS good, count(*) FILTER (performance_score IS NOT NULL AND s = 'needs_improvement') AS needs_improvement,
  count(*) FILTER (performance_score IS NOT NULL AND s = 'poor') AS poor, round(avg(lcp_ms), 6) AS mean_lcp_ms, round(avg(cls), 6) AS mean_cls, round(avg(inp_ms), 6) AS mean_inp_ms, floor(avg(performance_score))::INTEGER AS mean_score FROM v GROUP BY crawl_id""",
    "derived_summary": AUDIT["crawl_summary"].replace(AUDIT_BASE, BASE).replace("0::BIGINT AS pages_with_schema", f"count(*) FILTER ({_SIZE('schema_types')} > 0) AS pages_with_schema"),
    "derived_csv_export": f"{BASE} SELECT crawl_id, {csv_columns({})} FROM q",
    "derived_rendered_merge": f"{BASE} SELECT page_id, url, {', '.join(f'coalesce({v}, false) AS js_injected_{k}' for k, v in _LACKED.items())}, CASE WHEN page_id % 6 = 0 THEN coalesce(word_count, 0) ELSE 0 END AS words_gained FROM q WHERE status BETWEEN 200 AND 399",
    "derived_render_deltas": f"""{BASE}, {ROW_ISSUES}, n AS (SELECT crawl_id, url, count(*) AS n FROM row_issues WHERE url IS NOT NULL GROUP BY ALL),
m AS (SELECT q.crawl_id, q.url, unnest([{{'m': 'title', 'r': (title IS NOT NULL)::BIGINT, 'k': 3}}, {{'m': 'meta_description', 'r': (meta_description IS NOT NULL)::BIGINT, 'k': 5}}, {{'m': 'word_count', 'r': coalesce(word_count, 0)::BIGINT, 'k': 6}},
  {{'m': 'internal_links', 'r': {_SIZE('internal_links')}, 'k': 0}}, {{'m': 'external_links', 'r': {_SIZE('external_links')}, 'k': 0}}, {{'m': 'images', 'r': {_SIZE('images')}, 'k': 0}}, {{'m': 'schema_types', 'r': {_SIZE('schema_types')}, 'k': 4}},
  {{'m': 'h1', 'r': {_SIZE('h1')}, 'k': 7}}, {{'m': 'issues', 'r': coalesce(n, 0), 'k': 0}}]) AS x, page_id FROM q LEFT JOIN n ON n.crawl_id = q.crawl_id AND n.url = q.url)
SELECT crawl_id, url, x.m AS metric, CASE WHEN x.k > 0 AND page_id % greatest(x.k, 1) = 0 THEN 0 ELSE x.r END AS static, x.r AS rendered, x.r - CASE WHEN x.k > 0 AND page_id % greatest(x.k, 1) = 0 THEN 0 ELSE x.r END AS delta FROM m""",
    "derived_health_score": AUDIT["health_score"].replace(WITH_ISSUES, WITH_DERIVED_ISSUES),
}
