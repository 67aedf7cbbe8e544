"""URL and text functions against tables of expected values and against plain Python."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagestrata.functions import text, urls
from pagestrata.sources import robots

URLS = {
    "https://Site.Example": "https://site.example/",
    "https://site.example:443/a/": "https://site.example/a",
    "http://site.example:80/": "http://site.example/",
    "http://site.example:8080/a#x": "http://site.example:8080/a",
    "https://site.example/?b=2&a=1": "https://site.example/?a=1&b=2",
    "https://site.example/a?q=/": "https://site.example/a?q=",
    "https://site.example/%c3%bc/": "https://site.example/%C3%BC",
    "HTTPS://site.example#top": "https://site.example/",
    "not a url": "not a url",
    "/relative": "/relative",
    "": "",
}


def column(spark, values, function, schema="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}").select("i", function(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


def test_norm_url_column_and_python(spark):
    assert column(spark, list(URLS), urls.norm_url) == list(URLS.values())
    assert [urls.norm(u) for u in URLS] == list(URLS.values())
    assert column(spark, [None], urls.norm_url) == [None]


@settings(max_examples=100, deadline=None)
@given(st.from_regex(r"https?://[a-z]{1,8}\.example(:\d{2,4})?(/[a-zA-Z0-9_-]{1,6}){0,3}(\?[a-z]=[0-9](&[a-z]=[0-9])?)?(#[a-z]*)?", fullmatch=True))
def test_norm_is_idempotent(url):
    assert urls.norm(urls.norm(url)) == urls.norm(url)


def test_url_parts(spark):
    given_urls = ["https://a.example/Shop/x?utm_source=f", "http://localhost:3000/", "http://127.0.0.1/x", "https://my.localhost", "ftp://h/x", "https://a.example"]
    assert column(spark, given_urls, urls.first_path_segment) == ["Shop", "(root)", "x", "(root)", "x", "(root)"]
    assert column(spark, given_urls, urls.is_local_host) == [False, True, True, True, False, False]
    assert column(spark, given_urls, urls.has_utm)[:2] == [True, False]
    assert column(spark, given_urls, urls.is_crawlable) == [True, True, True, True, False, True]
    assert column(spark, ["/a/b", "/a", "/b/c"], lambda u: urls.glob_matches("/a", u)) == [True, True, False]
    assert column(spark, ["/a/b.html", "/a/c", "x/a/b.html"], lambda u: urls.glob_matches("/a/*.html", u)) == [True, False, False]


def test_resolve():
    assert urls.resolve("https://a.example/b/c", "../d e") == "https://a.example/d%20e"
    assert urls.resolve("https://a.example/b", "//Other.example:443/x") == "https://other.example/x"
    assert urls.resolve("https://a.example/", "für") == "https://a.example/f%C3%BCr"
    assert urls.resolve("https://a.example/", "http://[bad") is None


def test_text_measures(spark):
    texts = ["Mi W.1 ", "日本", "a​b", "", None]
    assert column(spark, texts, lambda t: text.pixel_width(t, "title")) == [17 + 6 + 5 + 17 + 6 + 6 + 5, 44, 22, 0, None]
    assert column(spark, texts, text.rendered_length) == [7, 2, 2, 0, None]
    assert column(spark, texts, text.is_full_width_text) == [False, True, False, False, False]
    assert column(spark, ["one two", "日本 x", "", " 　"], text.word_count) == [2, 3, 0, 1]


def test_reading_ease(spark):
    texts = ["The cat sat on the mat. It was a very fine day today.", "слово " * 30, "word " * 50, "", "hi."]
    got = column(spark, texts, text.reading_ease)
    assert got[0] > 90 and got[1:] == [None, None, None, None]


def test_detail_sample(spark):
    df = spark.createDataFrame([(["a", "b"],), (["x" * 400],), ([str(i) for i in range(30)],), ([],)], "v array<string>")
    got = [r[0] for r in df.select(text.detail_sample(F.col("v"))).collect()]
    assert got[0] == "a, b" and got[1] == "x" * 300 + "…" and got[2].endswith("(+20 more)") and got[3] == ""


def test_language_tags(spark):
    languages, countries = text.iso_codes(spark)
    tags = ["en", "EN-gb", "x-default", "zh-Hant-TW", "es-419", "en-UK", "us-en", "e", "en-GB-x", None]
    assert column(spark, tags, lambda t: text.is_language_tag(t, languages, countries)) == [True] * 5 + [False] * 5


@pytest.mark.parametrize(
    ("rules", "path", "allowed"),
    [
        ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b/c", True),
        ("User-agent: *\nDisallow: /a\nAllow: /a", "/a", True),
        ("User-agent: *\nDisallow: /*.pdf$", "/x/y.pdf", False),
        ("User-agent: *\nDisallow: /*.pdf$", "/x/y.pdf?z", True),
        ("User-agent: other\nDisallow: /", "/", True),
        ("User-agent: bot # note\nUser-agent: x\nDisallow: /", "/q", False),
        ("User-agent: *\nDisallow:", "/q", True),
    ],
)
def test_robots(rules, path, allowed):
    assert robots.is_allowed(rules, "bot", f"https://s.example{path}") is allowed


def test_blocked_ai_crawlers():
    assert robots.blocked_ai_crawlers("User-agent: GPTBot # no\nDisallow: /\n\nUser-agent: *\nAllow: /") == ["GPTBot"]
    assert robots.blocked_ai_crawlers("User-agent: *\nDisallow: /") == [] and robots.blocked_ai_crawlers(None) == []
