"""Queries over HTML: each page of the crawl table is written as a document and parsed again; the SQL tells what must come out from the columns
that went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.plans.audit_sql import SPACE, WORDS
from pagestrata.runtime import one_delivery, table
from pagestrata.sources import html
from pagestrata.sources.sitemaps import xml_escape

c = F.col
# What every document, or those whose number has the rest given, hold besides the page's own fields.
SCRIPTS = '<script src="/a.js"></script><script src="https://cdn.example/b.js" async></script>'
JSON_LD = {0: '{"@type": "Product"}', 1: '{"@graph": [{"@type": "Product", "name": "x"}, {"@type": ["Event"], "name": "y"}]}', 2: '{"@type": '}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, status, content_type, html, headers) of each page."""
    pages = one_delivery(table(spark, sf_dir, "page_data"), "page_id", ["url", "status", "content_type", "title", "meta_description", "meta_robots", "canonical", "h1", "body_text", "internal_links", "external_links", "images"])
    every = lambda rest, of, text: F.when(c("page_id") % of == rest, text).otherwise("")
    given = lambda column, before, after: F.coalesce(F.concat(F.lit(before), xml_escape(c(column)), F.lit(after)), F.lit(""))
    each = lambda array, make: F.coalesce(F.array_join(F.transform(array, make), ""), F.lit(""))
    attribute = lambda name, value: F.coalesce(F.concat(F.lit(f' {name}="'), xml_escape(value.cast("string")), F.lit('"')), F.lit(""))
    link = lambda x: F.concat(F.lit("<a"), attribute("href", x["url"]), F.when(x["nofollow"], ' rel="NoFollow"').otherwise(""), F.lit(">"), xml_escape(F.coalesce(x["anchor"], F.lit(""))), F.lit("</a>\n"))
    image = lambda x: F.concat(F.lit("<img"), attribute("src", x["src"]), attribute("alt", x["alt"]), attribute("width", x["width"]), attribute("height", x["height"]), F.lit(">"))
    data = F.lit("")
    for rest, text in JSON_LD.items():
        data = F.concat(data, every(rest, 5, f'<script type="application/ld+json">{text}</script>'))
    document = F.concat(
        F.lit("<!doctype html><html><head>"), given("title", "<title>", "</title>"), given("meta_description", '<meta name="Description" content="', '">'), given("meta_robots", '<meta name="robots" content="', '">'),
        given("canonical", '<link rel="canonical" href="', '">'), every(0, 3, '<link rel="alternate" hreflang="de" href="/de"><link rel="next" href="?page=2"><meta property="og:title" content="Og &amp; x">'),
        every(1, 3, '<base href="https://base.example/dir/">'), F.lit(SCRIPTS), data, F.lit("</head><body>"),
        each("h1", lambda h: F.concat(F.lit("<h1>"), xml_escape(h), F.lit("</h1>"))), F.lit("<h3>Part</h3><noscript>not this</noscript><template><p>nor this</p></template>"),
        each(F.split("body_text", "\n"), lambda x: F.concat(F.lit("<p>"), xml_escape(x), F.lit("</p>"))),
        each("internal_links", link), each("external_links", link), every(0, 4, '<a href="https://other.example/" target="_blank">away</a><a href="mailto:x@y.example">mail</a>'), each("images", image),
        every(0, 7, '<iframe src="http://insecure.example/i"></iframe>'), every(0, 6, '<form action="http://insecure.example/f"><input></form>'),
        every(4, 5, '<div itemscope itemtype="https://schema.org/Recipe"></div>'), F.lit("<script>var x = 1;</script></body></html>"),
    )
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    headers = F.array(
        header("X-Robots-Tag", F.when(c("page_id") % 3 == 0, "noarchive")), header("strict-transport-security", F.lit("max-age=1")), header("Link", F.concat(F.lit("<https://x.example/a,b>; rel=next, <"), c("url"), F.lit('>; rel="canonical"'))),
        header("REFERRER-POLICY", F.lit("no-referrer")), header("Referrer-Policy", F.lit("strict-origin")),
    )
    return pages.select("page_id", "url", "status", "content_type", document.alias("html"), F.filter(headers, lambda h: h["value"].isNotNull()).alias("headers"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.parse_pages(documents(spark, sf_dir)).where(c("title_count").isNotNull())


def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, description, robots, canonical, alternates, pagination, social tags, counts and places."""
    return parsed(spark, sf_dir).select(
        "page_id", "title", "title_count", "title_in_head", "meta_description", "meta_description_count", "meta_robots", "canonical", "canonical_count", "canonical_source", "canonical_is_relative",
        F.size("hreflang_tags").alias("alternates"), F.get("hreflang_tags", 0)["url"].alias("alternate"), c("pagination.next").alias("next"), c("og_tags")["og:title"].alias("og_title"), "is_https",
    )


def text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, visible text, its words, hash and reading ease."""
    levels = F.array_join(F.transform("headings", lambda h: h["level"].cast("string")), "")
    return parsed(spark, sf_dir).select("page_id", F.array_join("h1", "|").alias("h1"), levels.alias("levels"), F.sha2("body_text", 256).alias("text_hash"), "content_hash", "word_count", c("readability_score").isNotNull().alias("readable"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed(spark, sf_dir)
    kinds = [p.select("page_id", F.lit(kind).alias("kind"), F.posexplode(f"{kind}_links").alias("pos", "x")).select("page_id", "kind", "pos", "x.*") for kind in ("internal", "external")]
    return kinds[0].unionByName(kinds[1])


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("page_id", F.posexplode("images").alias("pos", "x")).select("page_id", "pos", "x.src", "x.alt", *[F.coalesce(c(f"x.{k}").cast("string"), F.lit("")).alias(k) for k in ("width", "height")])


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts, insecure resources and forms, unsafe links."""
    s = F.transform("scripts", lambda x: F.concat_ws(",", F.coalesce(x["src"], F.lit("inline")), *[x[k].cast("string") for k in ("is_async", "is_defer", "is_module", "in_head", "size_bytes", "is_third_party")]))
    return parsed(spark, sf_dir).select("page_id", F.array_join(s, "|").alias("scripts"), F.array_join("mixed_content", "|").alias("mixed"), F.array_join("insecure_forms", "|").alias("forms"), F.array_join("unsafe_cross_origin_links", "|").alias("unsafe"))


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed(spark, sf_dir).select("page_id", F.array_join("schema_types", "|").alias("types"), F.posexplode_outer("structured_data").alias("pos", "x"))
    return p.select("page_id", "types", F.coalesce("pos", F.lit(-1)).alias("pos"), "x.format", "x.schema_type", c("x.parse_error").isNotNull().alias("broken"), F.array_join("x.missing_required", "|").alias("missing"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots header, canonical header and security headers of every response."""
    h = html.response_columns(documents(spark, sf_dir))
    s = c("security_headers")
    return h.select("page_id", "x_robots_tag", "header_canonical", s["hsts"].alias("hsts"), s["csp"].alias("csp"), s["referrer_policy"].alias("referrer_policy"), s["referrer_value"].alias("referrer_value"))


QUERIES = {f"html_{f.__name__}": f for f in (head, text, links, images, resources, structured, headers)}

_FLAT = lambda x: f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"
# An absolute address as a parser gives it: scheme and host in lower case, no default port, a path.
_HEAD = lambda u: f"regexp_replace(lower(regexp_extract({u}, '^[^:/?#]+://[^/?#]*')), CASE WHEN {u} ILIKE 'https:%' THEN ':443$' ELSE ':80$' END, '')"
_REST = lambda u: f"regexp_replace({u}, '^[^:/?#]+://[^/?#]*', '')"
_ABSOLUTE = lambda u: f"({_HEAD(u)} || CASE WHEN starts_with({_REST(u)}, '/') THEN '' ELSE '/' END || {_REST(u)})"
_HOST = lambda u: f"lower(regexp_extract({u}, '^[^:/?#]+://([^/?#:]*)', 1))"
PAGES = "p AS (SELECT * FROM (SELECT DISTINCT ON (page_id) * FROM page_data WHERE page_id IS NOT NULL ORDER BY page_id) WHERE status BETWEEN 200 AND 399 AND coalesce(regexp_matches(lower(content_type), 'text/html|application/xhtml\\+xml'), true))"
_FROM = lambda part, at: f"CASE WHEN page_id % 3 = 1 THEN 'https://base.example' || '{at}' ELSE {part} END"
_TEXTS = f"""list_concat(coalesce(h1, []), ['Part'], string_split(coalesce(body_text, ''), chr(10)), list_transform(list_concat(coalesce(internal_links, []), coalesce(external_links, [])), lambda l: coalesce(l.anchor, '')), CASE WHEN page_id % 4 = 0 THEN ['away', 'mail'] ELSE [] END)"""
_SCRIPT_ROWS = "'/a.js,false,false,false,true,0,false|https://cdn.example/b.js,true,false,false,true,0,true|inline,false,false,false,false,10,false'"
ORACLE = {
    "html_head": f"""WITH {PAGES} SELECT page_id, {_FLAT('title')} AS title, CASE WHEN title IS NULL THEN 0 ELSE 1 END AS title_count, title IS NOT NULL AS title_in_head, {_FLAT('meta_description')} AS meta_description,
  CASE WHEN meta_description IS NULL THEN 0 ELSE 1 END AS meta_description_count, meta_robots, {_ABSOLUTE('canonical')} AS canonical, CASE WHEN canonical IS NULL THEN 0 ELSE 1 END AS canonical_count, CASE WHEN canonical IS NOT NULL THEN 'html' END AS canonical_source,
  false AS canonical_is_relative, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS alternates, CASE WHEN page_id % 3 = 0 THEN {_HEAD('url')} || '/de' END AS alternate,
  CASE WHEN page_id % 3 = 0 THEN regexp_replace({_ABSOLUTE('url')}, '[?#].*$', '') || '?page=2' END AS next, CASE WHEN page_id % 3 = 0 THEN 'Og & x' END AS og_title, starts_with(lower(url), 'https://') AS is_https FROM p""",
    "html_text": f"""WITH {PAGES}, t AS (SELECT page_id, h1, array_to_string(list_filter(list_transform({_TEXTS}, lambda x: {_FLAT('x')}), lambda x: x <> ''), ' ') AS body_text FROM p),
r AS (SELECT *, list_filter(regexp_split_to_array(body_text, '{SPACE}+'), lambda w: w <> '') AS w, greatest(1, len(regexp_extract_all(body_text, '[.!?]+'))) AS s, length(regexp_replace(body_text, '[^\\p{{L}}\\p{{Nl}}]', '', 'g')) AS letters,
  length(regexp_replace(regexp_replace(body_text, '[^\\p{{L}}\\p{{Nl}}]', '', 'g'), '[^A-Za-z\\x{{00C0}}-\\x{{024F}}]', '', 'g')) AS latin FROM t)
SELECT page_id, coalesce(array_to_string(list_transform(h1, lambda h: {_FLAT('h')}), '|'), '') AS h1, repeat('1', coalesce(len(h1), 0)) || '3' AS levels, sha256(body_text) AS text_hash, sha256(body_text) AS content_hash, {WORDS}::INTEGER AS word_count,
  len(w) > 0 AND letters >= 10 AND latin * 2 >= letters AND len(w) // s <= 40 AS readable FROM r""",
    "html_links": f"""WITH {PAGES}, e AS (SELECT page_id, url AS page_url, unnest(list_concat(coalesce(internal_links, []), coalesce(external_links, []), CASE WHEN page_id % 4 = 0 THEN [{{'url': 'https://other.example/', 'anchor': 'away', 'nofollow': false}}] ELSE [] END)) AS l,
  generate_subscripts(list_concat(coalesce(internal_links, []), coalesce(external_links, []), CASE WHEN page_id % 4 = 0 THEN [{{'url': 'https://other.example/', 'anchor': 'away', 'nofollow': false}}] ELSE [] END), 1) AS i FROM p),
k AS (SELECT page_id, i, {_ABSOLUTE('l.url')} AS url, {_FLAT("coalesce(l.anchor, '')")} AS anchor, coalesce(l.nofollow, false) AS nofollow, CASE WHEN {_HOST('l.url')} = {_HOST('page_url')} THEN 'internal' ELSE 'external' END AS kind FROM e WHERE l.url IS NOT NULL)
SELECT page_id, kind, (row_number() OVER (PARTITION BY page_id, kind ORDER BY i) - 1)::INTEGER AS pos, url, anchor, nofollow FROM k""",
    "html_images": f"""WITH {PAGES}, e AS (SELECT page_id, url AS page_url, unnest(images) AS x, generate_subscripts(images, 1) AS i FROM p)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS pos, CASE WHEN x.src LIKE '%://%' THEN {_ABSOLUTE('x.src')} WHEN starts_with(x.src, 'data:') THEN x.src ELSE {_FROM(_HEAD('page_url'), '')} || x.src END AS src, x.alt AS alt, coalesce(x.width::VARCHAR, '') AS width, coalesce(x.height::VARCHAR, '') AS height FROM e WHERE x.src IS NOT NULL""",
    "html_resources": f"""WITH {PAGES} SELECT page_id, {_SCRIPT_ROWS} AS scripts, CASE WHEN page_id % 7 = 0 AND starts_with(lower(url), 'https://') THEN 'http://insecure.example/i' ELSE '' END AS mixed,
  CASE WHEN page_id % 6 = 0 THEN 'http://insecure.example/f' ELSE '' END AS forms, CASE WHEN page_id % 4 = 0 THEN 'https://other.example/' ELSE '' END AS unsafe FROM p""",
    "html_structured": f"""WITH {PAGES} SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Product' WHEN 1 THEN 'Product|Event' ELSE '' END AS types, coalesce(v.pos, -1) AS pos, v.format, v.schema_type, coalesce(v.broken, false) AS broken, v.missing FROM p LEFT JOIN (VALUES
  (0, 0, 'json_ld', 'Product', false, 'name'), (1, 0, 'json_ld', 'Product', false, ''), (1, 1, 'json_ld', 'Event', false, 'startDate|location'), (2, 0, 'json_ld', NULL, true, ''), (4, 0, 'microdata', 'Recipe', false, '')) v(rest, pos, format, schema_type, broken, missing) ON v.rest = page_id % 5""",
    "html_headers": """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'noarchive' END AS x_robots_tag, trim(url) AS header_canonical, true AS hsts, false AS csp, true AS referrer_policy, 'strict-origin' AS referrer_value
FROM (SELECT DISTINCT ON (page_id) * FROM page_data WHERE page_id IS NOT NULL ORDER BY page_id)""",
}
