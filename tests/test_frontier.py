"""Frontier replay, redirect chains, inspection and the SQL views."""

from pagestrata.operators import checks, frontier, surface
from pagestrata.plans import views
from pagestrata.runtime import table
from pagestrata.sources.snapshots import audit_pages


def test_depths_and_limit(spark):
    edges = spark.createDataFrame([(1, a, b) for a, b in ["ab", "ac", "bd", "cd", "de", "ea", "xy"]], "crawl_id long, src string, dst string")
    seeds = spark.createDataFrame([(1, "a")], "crawl_id long, node string")
    visited = frontier.depths(edges, seeds, 2)
    assert {(r.node, r.depth) for r in visited.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {r.node for r in frontier.crawl_order(visited, 2).collect()} == {"a", "b"}
    assert {r.node for r in frontier.depths(edges, seeds, 9).collect()} == set("abcde")


def test_redirect_chains(spark):
    hops = spark.createDataFrame([(1, "a", 301, "b"), (1, "b", 302, "c"), (1, "c", 200, None), (1, "x", 301, "y"), (1, "y", 301, "x")], "crawl_id long, url string, status int, location string")
    got = {r.url: (r.served, [h.url for h in r.chain]) for r in frontier.redirect_chains(hops).collect()}
    assert got["a"] == ("c", ["a", "b"]) and got["b"] == ("c", ["b"]) and got["x"] == ("x", ["x", "y"])


def test_views_and_inspect(spark, sf_dir):
    pages = audit_pages(table(spark, sf_dir, "page_data"))
    assert {"pages", "links", "issues", "edges"} <= set(views.register(spark, pages))
    assert spark.sql("SELECT count(*) AS n FROM links WHERE kind = 'internal'").first().n > 100
    assert spark.sql("SELECT norm_url('https://A.example/x/') AS u, resolve_url('https://a.example/b', 'c') AS r").first() == ("https://a.example/x", "https://a.example/c")
    assert spark.sql("SELECT title, word_count FROM parse_page('<title>t</title><p>a b', 'https://a.example/')").first() == ("t", 2)
    found = checks.row_issues(pages)
    url = found.where("url is not null").orderBy("url").first().url
    assert {r.url for r in surface.inspect(pages, found, url).collect()} >= {url}
    assert frontier.sample_pages(pages, 2).groupBy("crawl_id").count().where("count > 2").count() == 0


def test_command_line(spark, sf_dir, capsys):
    from pagestrata.__main__ import main

    pages = f"{sf_dir}/page_data.parquet"
    main(["crawls", f"{sf_dir}/crawls.parquet", "--limit", "3"])
    main(["summary", pages])
    first = table(spark, sf_dir, "page_data").where("status = 404").select("crawl_id", "url").first()
    main(["inspect", pages, "--crawl", str(first.crawl_id), "--url", first.url])
    main(["issues", pages, "--crawl", str(first.crawl_id), "--severity", "critical"])
    main(["compare", pages, "--baseline", str(first.crawl_id), "--current", str(first.crawl_id)])
    shown = capsys.readouterr().out
    assert shown.count("internal_client_error") >= 2 and "p95_response_ms" in shown and "crawl_date" in shown
