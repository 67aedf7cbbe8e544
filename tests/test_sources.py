"""HTML parsing, response headers, queries, exports and streams."""

import json

from pyspark.sql import functions as F

from pagestrata.operators import checks, surface
from pagestrata.runtime import table
from pagestrata.sources import html, results
from pagestrata.sources.snapshots import audit_pages
from pagestrata.streaming import streams

PAGE = """<!doctype html><html><head><title> A &amp;  B </title><meta name="Description" content="about  this"><meta name=robots content="NoIndex, follow">
<link rel="canonical" href="/x/"><link rel=alternate hreflang=en href="/en"><meta property="og:title" content="T">
<script type="application/ld+json">{"@type": "Product"}</script><script type="application/ld+json">{bad</script><script src="https://cdn.example/a.js"></script></head>
<body><h1>Main <b>part</b></h1><p>one<p>two<a href="b#f" rel="nofollow">read <i>on</i></a><a href="mailto:x@y">m</a><a href="http://other.example/q" target=_blank>out</a>
<img src=a.png alt=""><img src="http://other.example/b.png" width=3 height=4><form action="http://x.example/f"></form>
<svg><title>icon</title></svg><template><a href=t>t</a></template><noscript>no words</noscript><script>ignored()</script><title>late</title></body></html>"""


def test_parse_html():
    p = html.parse_html(PAGE, "https://x.example/a/")
    assert (p["title"], p["title_count"], p["title_in_head"]) == ("A & B", 2, True)
    assert (p["meta_description"], p["meta_desc_in_head"], p["meta_robots"]) == ("about this", True, "NoIndex, follow")
    assert (p["canonical"], p["canonical_source"], p["canonical_is_relative"], p["has_self_canonical"]) == ("https://x.example/x/", "html", True, False)
    assert p["h1"] == ["Main part"] and p["og_tags"] == {"og:title": "T"} and p["hreflang_tags"] == [{"lang": "en", "url": "https://x.example/en"}]
    assert p["internal_links"] == [{"url": "https://x.example/a/b#f", "anchor": "read on", "nofollow": True}]
    assert [x["url"] for x in p["external_links"]] == ["http://other.example/q"] == p["unsafe_cross_origin_links"]
    assert [(i["alt"], i["width"], i["height"]) for i in p["images"]] == [("", None, None), (None, 3, 4)]
    assert p["mixed_content"] == ["http://other.example/b.png"] and p["insecure_forms"] == ["http://x.example/f"]
    assert [(b["schema_type"], b["missing_required"], b["parse_error"] is not None) for b in p["structured_data"]] == [("Product", ["name"], False), (None, [], True)]
    assert [(s["src"], s["in_head"], s["is_third_party"]) for s in p["scripts"]] == [("https://cdn.example/a.js", True, True), (None, False, False)]
    assert "no words" not in p["body_text"] and "ignored" not in p["body_text"] and p["word_count"] == len(p["body_text"].split())


def test_head_closes_at_body_content():
    p = html.parse_html("<head><div>x</div><title>t</title><link rel=canonical href=/c></head>", "https://x.example/")
    assert not p["title_in_head"] and p["canonical_source"] is None and p["canonical"] == "https://x.example/c"


def test_header_canonical(spark):
    given = ['<https://a.example/x,y>; rel="canonical", <b>; rel=next', "<b>; rel=next, < c >; title=x; REL=canonical", '<d>; rel="next canonical"', "<a>; rel=next", "<e>; rel=canonicals", None]
    table = spark.createDataFrame([(k, v) for k, v in enumerate(given)], "k int, v string")
    got = dict(table.select("k", html.header_canonical(F.col("v"))).collect())
    assert [got[k] for k in range(6)] == ["https://a.example/x,y", "c", "d", None, None, None]


def test_parse_pages_gates_errors(spark):
    headers = [("X-Robots-Tag", "noindex"), ("Link", "<https://x.example/h>; rel=canonical"), ("Strict-Transport-Security", "1"), ("Referrer-Policy", "a"), ("referrer-policy", "unsafe-url")]
    rows = [(1, 1, "https://x.example/a/", 200, "text/html", PAGE, headers), (2, 1, "https://x.example/b", 404, "text/html", PAGE, headers), (3, 1, "https://x.example/c", 200, "text/html", None, [])]
    fetches = spark.createDataFrame(rows, "page_id long, crawl_id long, url string, status int, content_type string, html string, headers array<struct<name:string,value:string>>")
    pages = html.with_header_canonical(html.parse_pages(html.response_columns(fetches)))
    got = {r.page_id: r for r in pages.collect()}
    assert got[1].title == "A & B" and got[1].canonical_source == "both" and got[2].title is None and got[2].canonical_source == "http_header"
    assert got[1].security_headers.hsts and not got[1].security_headers.csp and got[1].security_headers.referrer_value == "unsafe-url"
    found = {(r.check, r.url) for r in checks.row_issues(audit_pages(pages)).collect()}
    assert {("noindex", "https://x.example/a/"), ("canonical_mismatch", "https://x.example/a/"), ("internal_client_error", "https://x.example/b")} <= found


def test_pagespeed(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"lighthouseResult": {"requestedUrl": "https://x.example/a", "audits": {"largest-contentful-paint": {"numericValue": 4100.5}, "cumulative-layout-shift": {"numericValue": 0.05}}, "categories": {"performance": {"score": 0.455}}}}))
    r = results.read_pagespeed(spark, str(tmp_path)).first()
    assert (r.url, r.lcp_ms, r.inp_ms, r.cwv_status) == ("https://x.example/a", 4100.5, None, "poor") and r.performance_score in (45, 46)
    joined = results.with_measurements(spark.createDataFrame([("https://x.example/a/",), ("https://x.example/b",)], "url string"), results.read_pagespeed(spark, str(tmp_path)))
    assert {x.url: x.lcp_ms for x in joined.collect()} == {"https://x.example/a/": 4100.5, "https://x.example/b": None}


def test_query_and_compare(spark):
    issue = "crawl_id long, category string, check string, severity string, url string, detail string"
    page = "crawl_id long, page_id long, url string, url_key string, redirect_chain array<struct<status:int,url:string>>, chain_urls array<string>"
    pages = spark.createDataFrame([(1, k, f"https://s.example/p{k}", f"https://s.example/p{k}", [(301, "https://s.example/old")] if k == 1 else None, ["https://s.example/old"] if k == 1 else None) for k in range(30)], page)
    rows = [(1, "links", "broken_internal", "critical", f"https://s.example/p{k}", None) for k in range(9)] + [(1, "response_codes", "internal_redirect", "info", "https://s.example/old", None), (1, "sitemaps", "no_sitemap_found", "warning", None, None)]
    found = spark.createDataFrame(rows, issue)
    one = surface.query(pages, found, surface.Query(1, url_pattern="https://s.example/p1", urls_per_issue=3)).collect()
    assert {(r.check, r.total_urls) for r in one} == {("broken_internal", 1), ("internal_redirect", 1), ("no_sitemap_found", 0)}
    capped = surface.query(pages, found, surface.Query(1, severity="critical", urls_per_issue=3)).collect()
    assert len(capped) == 3 and {r.total_urls for r in capped} == {9}
    later = found.where("url is null or url <> 'https://s.example/p3'").unionByName(spark.createDataFrame([(1, "links", "orphan_pages", "warning", "https://s.example/old", None)], issue))
    changes = {(r.check, r.url_key, r.change) for r in surface.compare(pages, found, pages, later).collect()}
    assert changes == {("broken_internal", "https://s.example/p3", "resolved"), ("orphan_pages", "https://s.example/p1", "new")}


def test_query_of_every_crawl(spark):
    at = "https://s.example/{}".format
    pages = spark.createDataFrame([(k, k, at("shop/a"), at("shop/a"), None, None) for k in (1, 2)], "crawl_id long, page_id long, url string, url_key string, redirect_chain array<struct<status:int,url:string>>, chain_urls array<string>")
    rows = [(1, "links", "one", at("shop/a")), (1, "links", "two", at("shop/a")), (2, "links", "two", at("shop/a")), (2, "links", "two", at("shop/b")), (3, "links", "one", at("blog/a"))]
    found = spark.createDataFrame([(*r[:3], "warning", r[3], None) for r in rows], "crawl_id long, category string, check string, severity string, url string, detail string")
    got = surface.query(pages, found, surface.Query(None, url_pattern="*/shop/*", per_page=1, urls_per_issue=5)).collect()
    assert {(r.crawl_id, r.check, r.total_urls, r.url_no, r.page_count) for r in got} == {(1, "one", 1, 1, 2), (2, "two", 2, 1, 1), (2, "two", 2, 2, 1)}


def test_consecutive_crawls(spark):
    """Three crawls of a site whose ids are not in the order of their dates, and a site with one crawl."""
    days = [(3, 1, "2025-01-01"), (1, 1, "2025-02-01"), (2, 1, "2025-03-01"), (9, 2, "2025-01-01")]
    crawls = spark.createDataFrame(days, "crawl_id long, site_id int, day string").select("crawl_id", "site_id", F.to_timestamp("day").alias("crawl_date"))
    at = "https://s.example/{}".format
    hop = lambda k: [at("old")] if k == 1 else None
    page = "crawl_id long, page_id long, url string, url_key string, redirect_chain array<struct<status:int,url:string>>, chain_urls array<string>"
    pages = spark.createDataFrame([(k, k, at("p"), at("p"), [(301, at("old"))] if k == 1 else None, hop(k)) for k in (1, 2, 3, 9)], page)
    # "back" is gone in the middle crawl, "mended" is only in the first; the address "old" is "p" in crawl 1 alone.
    rows = [(3, "back", at("p")), (2, "back", at("p")), (3, "mended", at("p")), (1, "moved", at("old")), (2, "moved", at("old")), (9, "back", at("p"))]
    found = spark.createDataFrame([(k, "links", check, "warning", url, None) for k, check, url in rows], "crawl_id long, category string, check string, severity string, url string, detail string")
    got = {(r.crawl_a, r.crawl_b, r.check, r.url_key.rsplit("/", 1)[1], r.change) for r in surface.compare_consecutive(pages, found, crawls).collect()}
    first = {(3, 1, "back", "p", "resolved"), (3, 1, "mended", "p", "resolved"), (3, 1, "moved", "p", "new")}
    assert got == first | {(1, 2, "back", "p", "new"), (1, 2, "moved", "p", "resolved"), (1, 2, "moved", "old", "new")}


def test_csv_guard(spark, sf_dir, tmp_path):
    pages = audit_pages(table(spark, sf_dir, "page_data")).withColumn("title", F.lit("=1+1"))
    surface.write_csv(pages, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert len(back.columns) == 32 and {r.title for r in back.select("title").distinct().collect()} == {"'=1+1"} and back.count() == pages.count()


def test_streamed_checks_equal_batch(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "in")
    table(spark, sf_dir, "page_data").repartition(3).write.parquet(folder)
    query = streams.row_issues(streams.snapshots(spark, folder)).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    batch = checks.row_issues(audit_pages(table(spark, sf_dir, "page_data")))
    key = lambda df: sorted((r.crawl_id, r.check, r.url) for r in df.collect())
    assert key(spark.table("streamed")) == key(batch) and batch.count() > 100
