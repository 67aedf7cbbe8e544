"""Checks on hand-made pages: one field is changed at a time."""

import pytest
from pyspark.sql import functions as F

from pagestrata.operators import checks, graph, relations, scoring
from pagestrata.plans import check_catalog
from pagestrata.schema import PAGE_FIELDS
from pagestrata.sources.snapshots import audit_pages
from pagestrata.sources.sitemaps import parse as parse_sitemap
from pagestrata.sources.sitemaps import read as read_sitemaps

SCHEMA = ", ".join(f"`{k}` {v}" for k, v in PAGE_FIELDS.items())
GOOD = dict.fromkeys(PAGE_FIELDS) | {
    "crawl_id": 1, "domain": "s.example", "status": 200, "content_type": "text/html", "depth": 1, "response_time_ms": 100,
    "title": "A fine title of some thirty-five letters", "meta_description": "A description that is long enough to satisfy every lower limit there is here.",
    "canonical_source": "html", "title_count": 1, "meta_description_count": 1, "title_in_head": True, "meta_desc_in_head": True, "canonical_count": 1,
    "canonical_is_relative": False, "h1": ["Heading"], "headings": [(1, "Heading"), (2, "Part")], "word_count": 500, "body_text": "Some words here. ",
    "internal_links": [("https://s.example/", "home page", False)], "external_links": [], "images": [], "structured_data": [("json_ld", "Product", "", None, [])],
    "security_headers": (True, True, True, True, True, "no-referrer"), "scripts": [], "console_errors": [], "hreflang_tags": [],
}


def page(n, **fields):
    url = fields.get("url", f"https://s.example/p{n}")
    return GOOD | {"page_id": n, "url": url, "canonical": url, "title": f"A fine title of some thirty letters {n}", "meta_description": f"{GOOD['meta_description']} {n}", "h1": [f"Heading {n}"], "headings": [(1, f"Heading {n}"), (2, f"Part {n}")], "body_text": f"Some words here {n}."} | fields


def issues(spark, *pages):
    rows = [tuple(p[k] for k in PAGE_FIELDS) for p in pages]
    prepared = audit_pages(spark.createDataFrame(rows, SCHEMA))
    found = checks.page_issues(prepared).collect()
    assert all(r.severity == check_catalog.SEVERITY[r.category, r.check] for r in found)
    return {(r.category, r.check, r.url) for r in found}, prepared


def test_catalogue():
    listed = check_catalog.rows()
    assert len(listed) == 128 and len({(c, k) for c, k, *_ in listed}) == 128
    tiers = [t for *_, t, _ in listed]
    assert {t: tiers.count(t) for t in set(tiers)} == {"broken": 6, "defective": 5, "site_high": 5, "site_medium": 37, "minor": 65, "unscored": 10}
    severities = [s for _, _, s, _, _ in listed]
    assert [severities.count(s) for s in ("critical", "warning", "info")] == [12, 65, 51]


def test_every_check_is_implemented(spark):
    import inspect

    source = inspect.getsource(checks)
    missing = [k for _, k, *_ in check_catalog.rows() if f'"{k}"' not in source and not k.startswith("js_injected_")]
    assert missing == []


def test_clean_pages_have_no_findings(spark):
    home = page(0, url="https://s.example/", depth=0, internal_links=[("https://s.example/p1", "first page", False)])
    found, _ = issues(spark, home, page(1))
    assert found == set()


CASES = [
    ("response_codes", "internal_server_error", {"status": 503}),
    ("response_codes", "internal_client_error", {"status": 404}),
    ("response_codes", "internal_access_restricted", {"status": 403}),
    ("response_codes", "internal_no_response", {"status": 0}),
    ("security", "missing_hsts", {"security_headers": (False, True, True, True, True, "x")}),
    ("security", "missing_referrer_policy", {"security_headers": (True, True, True, True, True, "Unsafe-URL")}),
    ("security", "mixed_content", {"mixed_content": ["http://a/x.png"]}),
    ("page_titles", "missing", {"title": None}),
    ("page_titles", "over_60_chars", {"title": "x" * 61}),
    ("page_titles", "below_30_chars", {"title": "short"}),
    ("page_titles", "multiple_tags", {"title_count": 2}),
    ("page_titles", "outside_head", {"title_in_head": False}),
    ("meta_description", "over_155_chars", {"meta_description": "word " * 40}),
    ("headings", "h1_missing", {"h1": [" "]}),
    ("headings", "h1_multiple", {"h1": ["a", "b"]}),
    ("headings", "h2_missing", {"headings": [(1, "a")]}),
    ("headings", "non_sequential", {"headings": [(1, "a"), (2, "c"), (4, "b")]}),
    ("content", "low_content", {"word_count": 99}),
    ("content", "readability_difficult", {"readability_score": 10.0}),
    ("content", "readability_very_difficult", {"readability_score": 9.5}),
    ("images", "missing_alt_attribute", {"images": [("https://s.example/a.png", None, 10, 10)]}),
    ("images", "missing_dimensions", {"images": [("https://s.example/a.png", "", None, 10)]}),
    ("canonicals", "missing", {"canonical": None}),
    ("canonicals", "canonical_outside_head", {"canonical_source": None}),
    ("canonicals", "multiple_conflicting", {"canonical_count": 2}),
    ("directives", "noindex", {"meta_robots": "NoIndex, follow"}),
    ("directives", "conflicting_directives", {"meta_robots": "noindex", "x_robots_tag": "index"}),
    ("directives", "noai_directive", {"meta_robots": "noai"}),
    ("hreflang", "incorrect_lang_codes", {"hreflang_tags": [("en-UK", "https://s.example/p1"), ("x-default", "https://s.example/p1")]}),
    ("hreflang", "missing_x_default", {"hreflang_tags": [("en", "https://s.example/p1")]}),
    ("hreflang", "missing_self_reference", {"hreflang_tags": [("x-default", "https://s.example/")]}),
    ("hreflang", "multiple_entries", {"hreflang_tags": [("en", "https://s.example/p1"), ("EN", "https://s.example/")]}),
    ("links", "localhost_outlinks", {"external_links": [("http://localhost:8000/", "x", False)]}),
    ("links", "no_anchor_text", {"internal_links": [("https://s.example/", " ", False)]}),
    ("links", "non_descriptive_anchor", {"internal_links": [("https://s.example/", "Click here", False)]}),
    ("links", "internal_nofollow", {"internal_links": [("https://s.example/", "x y", True)]}),
    ("links", "high_crawl_depth", {"depth": 5}),
    ("links", "no_internal_outlinks", {"internal_links": []}),
    ("structured_data", "missing", {"structured_data": []}),
    ("structured_data", "parse_errors", {"structured_data": [("json_ld", None, "", "bad", [])]}),
    ("structured_data", "missing_required", {"structured_data": [("json_ld", "Product", "", None, ["name"])]}),
    ("performance", "slow_server_response", {"response_time_ms": 1500}),
    ("performance", "cwv_lcp_poor", {"lcp_ms": 4000.1}),
    ("performance", "cwv_lcp_needs_work", {"lcp_ms": 4000.0}),
    ("performance", "cwv_score_needs_work", {"performance_score": 50}),
    ("javascript", "js_injected_h1", {"js_injected_h1": True}),
    ("javascript", "js_render_blocking", {"scripts": [("a.js", False, False, False, True, 0, False)]}),
    ("javascript", "js_excessive_scripts", {"scripts": [(None, True, False, False, False, 102_401, False)]}),
    ("javascript", "js_console_errors", {"console_errors": ["e"] * 5}),
    ("javascript", "js_console_errors_critical", {"console_errors": ["e"] * 6}),
    ("url", "repetitive_path", {"url": "https://s.example/a/b/a"}),
    ("url", "non_ascii", {"url": "https://s.example/%C3%BC"}),
    ("url", "ga_tracking_params", {"url": "https://s.example/x?UTM_source=1"}),
]


def test_each_row_check(spark):
    """Every case is a crawl of its own, so that one run decides all of them."""
    pages = []
    for n, (_, _, fields) in enumerate(CASES, 1):
        pages.append(page(n, **({"url": "https://s.example/p1"} | fields), crawl_id=n))
    rows = [tuple(p[k] for k in PAGE_FIELDS) for p in pages]
    found = {(r.crawl_id, r.category, r.check) for r in checks.row_issues(audit_pages(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert [c for n, c in enumerate(CASES, 1) if (n, *c[:2]) not in found] == []


def test_relations_between_pages(spark):
    hop = [(301, "https://s.example/old")]
    found, prepared = issues(
        spark,
        page(0, url="https://s.example/", depth=0, internal_links=[("https://s.example/old#x", "moved", False), ("https://s.example/p2/", "second", False)]),
        page(1, redirect_chain=hop, status=404),
        page(2, canonical="https://s.example/p3", title="The same title on both of these pages"),
        page(3, canonical="https://s.example/p2", title="The same title on both of these pages", hreflang_tags=[("en", "https://s.example/p3"), ("de", "https://s.example/p2"), ("x-default", "https://s.example/p3")]),
    )
    assert ("links", "broken_internal", "https://s.example/") in found
    assert ("links", "orphan_pages", "https://s.example/p3") in found and ("links", "orphan_pages", "https://s.example/p2") not in found
    assert {u for c, k, u in found if k == "canonical_loop"} == {"https://s.example/p2", "https://s.example/p3"}
    assert {u for c, k, u in found if (c, k) == ("page_titles", "duplicate")} == {"https://s.example/p2", "https://s.example/p3"}
    assert ("hreflang", "missing_return_links", "https://s.example/p3") in found and ("hreflang", "non_canonical_urls", "https://s.example/p3") in found
    assert ("response_codes", "internal_redirect", "https://s.example/old") in found
    moved = {(r.requested, r.served) for r in relations.aliases(prepared).where("requested <> served").collect()}
    assert moved == {("https://s.example/old", "https://s.example/p1")}


@pytest.mark.parametrize(("share", "check", "letter"), [(0.0, None, "A"), (0.25, "internal_client_error", "C"), (0.4, "internal_client_error", "D"), (0.3, "exact_duplicate", "B")])
def test_score_calibration(spark, share, check, letter):
    pages = spark.range(1000).select(F.lit(1).alias("crawl_id"), F.col("id"))
    category = {"internal_client_error": "response_codes", "exact_duplicate": "content"}.get(check, "content")
    found = pages.where(F.col("id") < 1000 * share).select("crawl_id", F.lit(category).alias("category"), F.lit(check or "x").alias("check"), F.lit("critical").alias("severity"), F.concat(F.lit("u"), "id").alias("url"), F.lit(None).cast("string").alias("detail"))
    row = scoring.health_score(pages, found).first()
    assert row.grade == letter and 0 <= row.score <= 100


def test_graph_paths_agree(spark):
    """The one-task and the distributed forms give the same ranks and components."""
    links = [(1, f"n{a:02}", f"n{b:02}") for a, b in [(0, 1), (1, 2), (2, 0), (3, 0), (5, 6), (6, 7), (8, 7), (9, 10), (10, 11), (11, 12), (12, 13)]]
    edges = spark.createDataFrame(links, "crawl_id long, src string, dst string")
    nodes = spark.createDataFrame([(1, f"n{k:02}", "u") for k in range(15)], "crawl_id long, node string, url string")
    small, large = (graph.pagerank(nodes, edges, rounds=5, task_edges=n) for n in (100, 0))
    a, b = ({r.node: r.pagerank for r in df.collect()} for df in (small, large))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12 and abs(sum(a.values()) - 1) < 1e-9
    groups = []
    for limit in (100, 0):
        found = {}
        for r in graph.components(nodes, edges, task_edges=limit).collect():
            found.setdefault(r.component, set()).add(r.node)
        groups.append(sorted(map(sorted, found.values())))
    assert groups[0] == groups[1] and len(groups[0]) == 5


def test_sitemaps(spark):
    good = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://s.example/p1?a=1&amp;b=2 </loc></url><url><loc>ftp://x</loc></url></urlset>'
    assert parse_sitemap(good) == {"kind": "urlset", "locs": ["https://s.example/p1?a=1&b=2"], "invalid": ["ftp://x"], "malformed": False}
    assert parse_sitemap("<urlset><url><loc>https://s.example/</loc></url>")["malformed"]
    files = spark.createDataFrame([(1, "a.xml", good, 200), (1, "b.xml", None, 404), (2, "c.xml", "<x", 200)], "crawl_id long, source string, text string, status int")
    entries, sources, problems = read_sitemaps(files)
    pages = audit_pages(spark.createDataFrame([tuple(page(1)[k] for k in PAGE_FIELDS)], SCHEMA))
    found = {(r.crawl_id, r.check, r.url) for r in checks.sitemap_issues(pages, entries, sources, problems).collect()}
    assert found == {(1, "sitemap_unreachable", "b.xml"), (1, "sitemap_invalid_loc", "ftp://x"), (2, "sitemap_unreachable", "c.xml"), (2, "no_sitemap_found", None), (1, "urls_not_in_sitemap", "https://s.example/p1")}


def test_empty_tables(spark):
    prepared = audit_pages(spark.createDataFrame([], SCHEMA))
    found = checks.page_issues(prepared)
    assert found.count() == 0 and scoring.health_score(prepared, found).count() == 0 and scoring.crawl_summary(prepared).count() == 0
