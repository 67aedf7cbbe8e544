"""Pages that show every check: the crawl table with fields it lacks filled by rule, and a few linked pages for each crawl.

The rules take the number of the page only, so any engine can build the same table from the given ones. They are written once, in
a small notation for the two dialects that differ in lists and structs; what is found in the table is not shared with the SQL that checks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.runtime import one_delivery, table
from pagestrata.schema import PAGE_FIELDS

FIRST_LINKED = 1_000_000_000_000


class Spark:
    """Notation of Spark SQL."""

    @staticmethod
    def struct(**fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    @staticmethod
    def array(*items: str) -> str:
        return f"array({', '.join(items)})"

    @staticmethod
    def times(n: int, item: str) -> str:
        return f"transform(sequence(1, {n}), i -> {item})"

    @staticmethod
    def emptied(array: str) -> str:
        return f"filter({array}, x -> false)"

    @staticmethod
    def cast(value: str, kind: str) -> str:
        return f"cast({value} as {kind})"


class Duck:
    """Notation of the checking database."""

    @staticmethod
    def struct(**fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    @staticmethod
    def array(*items: str) -> str:
        return f"[{', '.join(items)}]"

    @staticmethod
    def times(n: int, item: str) -> str:
        return f"list_transform(range(1, {n + 1}), lambda i: {item})"

    @staticmethod
    def emptied(array: str) -> str:
        return f"list_filter({array}, lambda x: false)"

    @staticmethod
    def cast(value: str, kind: str) -> str:
        names = {"array<string>": "VARCHAR[]", "boolean": "BOOLEAN", "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER"}
        return f"cast({value} as {names[kind]})"


def fields(d) -> dict[str, str]:
    """Field by expression over a page's own columns; m(k) are the rests of its number."""
    m = lambda k: f"page_id % {k}"
    null = lambda kind: d.cast("NULL", kind)
    link = lambda url, anchor, nofollow="false": d.struct(url=url, anchor=anchor, nofollow=nofollow)
    hop = lambda status, url: d.struct(status=status, url=url)
    image = lambda src, alt, w, h: d.struct(src=src, alt=d.cast(alt, "string"), width=d.cast(w, "int"), height=d.cast(h, "int"))
    head = lambda level, text: d.struct(level=level, text=text)
    script = lambda src, a="false", e="false", mod="false", h="true", size="0", third="false": d.struct(
        src=d.cast(src, "string"), is_async=a, is_defer=e, is_module=mod, in_head=h, size_bytes=size, is_third_party=third
    )
    block = lambda error, missing: d.struct(format="'json_ld'", schema_type="'Product'", raw="'{}'", parse_error=d.cast(error, "string"), missing_required=d.cast(missing, "array<string>"))

    def case(of: int, rules: dict[int, str], otherwise: str) -> str:
        return f"CASE {m(of)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in rules.items()) + f" ELSE {otherwise} END"

    ladder = lambda *values: case(len(values) + 1, {k: v for k, v in enumerate(values)}, null("double"))
    urls = {
        0: "replace(url, 'https://', 'http://')", 1: "url || '/a%20b'", 2: "url || '/' || repeat('x', 120)", 3: "url || '/Upper'", 4: "url || '/under_score'",
        5: "url || '?a=1&utm_source=x'", 6: "url || '//double'", 7: "url || '/café'", 8: "url || '/same/same'",
    }
    return {
        "url": case(40, urls, "url"),
        "status": case(41, {5: "0", 6: "0"}, "status"),
        "redirect_chain": case(43, {
            1: d.array(hop("301", "url || '/r1'"), hop("302", "url || '/r2'"), hop("301", "url || '/r1'")),
            2: d.array(hop("301", "url || '/r1'"), hop("302", "url || '/r2'")),
            3: d.array(hop("301", "url || '/r1'")),
        }, "redirect_chain"),
        "title_count": case(17, {1: "2"}, "1"), "title_in_head": case(17, {2: "false"}, "true"),
        "meta_description_count": case(17, {3: "2"}, "1"), "meta_desc_in_head": case(17, {4: "false"}, "true"),
        "h1": case(19, {1: d.array("coalesce(title, 'One')", "'Second'"), 2: d.array("repeat('Long heading ', 8)"), 3: d.array("repeat('x', 70)")}, "h1"),
        "headings": case(23, {
            1: d.array(head("1", "'A'"), head("3", "'C'")), 2: d.array(head("1", "'A'"), head("2", "'Shared subtitle'"), head("2", "'Shared subtitle'")),
            3: d.array(head("1", "'A'"), head("2", "repeat('Subtitle ', 10)")), 4: d.array(head("2", "'Starts low'")),
        }, d.array(head("1", "'A'"), head("2", "'Own ' || " + d.cast("page_id", "string")), head("3", "'C'"), head("1", "'D'"))),
        "images": case(29, {
            1: d.array(image("'a.png'", "repeat('word ', 30)", "10", "10")), 2: d.array(image("'x.png'", "NULL", "1", "NULL")), 3: d.array(image("'  DATA:image/png'", "NULL", "9", "9")),
            4: d.array(image("'dot.gif'", "NULL", "1", "1")), 5: d.array(image("'b.png'", "NULL", "2", "2")), 6: d.array(image("'c.png'", "''", "NULL", "NULL")),
        }, "images"),
        "canonical": case(31, {1: "url", 2: "url", 3: "url", 4: "url", 5: "url || '/other'"}, "canonical"),
        "canonical_is_relative": case(31, {1: "true"}, "false"), "canonical_count": case(31, {2: "2"}, "1"),
        "canonical_source": case(31, {3: "'both'", 4: null("string")}, "CASE WHEN canonical IS NOT NULL OR page_id % 31 IN (1, 2, 5) THEN 'html' END"),
        "x_robots_tag": case(37, {
            1: "'noindex, nofollow'", 2: "'googlebot: noindex'", 3: "'index'", 4: "'nofollow'", 5: "'none'", 6: "'nosnippet, max-snippet: 5'", 7: "'noimageindex'", 8: "'NoAI'", 9: "'all'",
        }, null("string")),
        "meta_robots": case(37, {3: "'noindex'", 4: "'index, follow'", 9: "'none'", 10: "'noimageai'"}, "meta_robots"),
        "security_headers": d.struct(
            hsts="page_id % 2 = 0", csp="page_id % 3 > 0", x_content_type_options="page_id % 5 > 0", x_frame_options="page_id % 7 > 0", referrer_policy="page_id % 11 > 0",
            referrer_value=case(11, {0: null("string"), 1: "'unsafe-url'", 2: "'No-Referrer-When-Downgrade'"}, "'strict-origin'"),
        ),
        "mixed_content": case(13, {1: d.array("'http://x.example/a.js'")}, d.cast(d.array(), "array<string>")),
        "insecure_forms": case(40, {0: d.array("'http://x.example/f'"), 11: d.array("'http://x.example/f'")}, d.cast(d.array(), "array<string>")),
        "unsafe_cross_origin_links": case(13, {3: d.array("'https://other.example/'")}, d.cast(d.array(), "array<string>")),
        "lcp_ms": ladder("2500.0", "2500.5", "4000.0", "4000.5"), "inp_ms": ladder("200.0", "200.5", "500.0", "500.5", "20.0"), "cls": ladder("0.1", "0.11", "0.25", "0.26", "0.0", "0.01"),
        "fcp_ms": ladder("3000.0", "3000.5"), "ttfb_ms": ladder("800.0", "800.5"),
        "performance_score": case(9, {1: "49", 2: "50", 3: "89", 4: "90", 5: "100"}, null("int")),
        **{f"js_injected_{x}": case(47, {k: "true"}, "false") for k, x in enumerate(("title", "description", "canonical", "h1", "structured_data"), 1)},
        "console_errors": case(53, {1: d.array("'e'"), 2: d.times(5, "'e'"), 3: d.times(6, "'e'")}, d.cast(d.array(), "array<string>")),
        "scripts": case(59, {
            1: d.array(script("'/a.js'")), 2: d.times(21, script("'/a.js'", a="true")), 3: d.array(script("NULL", size="102401")), 4: d.array(script("NULL", size="102400")),
            5: d.times(11, script("'https://cdn.example/a.js'", e="true", third="true")), 6: d.times(10, script("'https://cdn.example/a.js'", mod="true", third="true")),
            7: d.array(script("'/b.js'", h="false")),
        }, d.array(script("'/c.js'", a="true"))),
        "structured_data": case(61, {1: d.array(block("'bad'", d.array())), 2: d.array(block("NULL", d.array("'name'"))), 3: d.array(block("NULL", d.array())), 4: d.emptied(d.array(block("NULL", d.array())))}, f"CASE WHEN page_id % 3 = 0 THEN {d.array(block('NULL', d.array()))} END"),
        "schema_types": case(61, {2: d.array("'Product'"), 3: d.array("'Product'", "'Offer'")}, d.cast(d.array(), "array<string>")),
        "external_links": case(67, {1: d.times(101, link("'https://far.example/'", "'far'")), 2: d.times(100, link("'https://far.example/'", "'far'")), 6: d.array(link("'http://127.0.0.1:8080/x'", "'x'"))}, "external_links"),
        "internal_links": case(67, {
            2: d.array(link("'http://localhost/x'", "'x'")), 3: d.array(link("url", "' Click Here '")), 4: d.array(link("url", "'click'")), 5: d.array(link("url", "'go'")), 7: d.array(link("url", "'  '", "true")),
        }, "internal_links"),
    }


# (number, path, status, meta robots, path of the canonical or none, alternates as (language, path)): pages each crawl gets besides.
LINKED = [
    (1, "/c/loop-a", 200, None, "/c/loop-b", []), (2, "/c/loop-b", 200, None, "/c/loop-a", []),
    (3, "/c/chain-a", 200, None, "/c/chain-b", []), (4, "/c/chain-b", 200, None, "/c/chain-c", []), (5, "/c/chain-c", 200, None, "/c/chain-c", []),
    (6, "/c/to-gone", 200, None, "/c/gone", []), (7, "/c/gone", 410, None, None, []),
    (8, "/c/to-hidden", 200, None, "/c/hidden", []), (9, "/c/hidden", 200, "noindex", None, []),
    (10, "/h/en", 200, None, None, [("en", "/h/en"), ("de", "/h/de"), ("x-default", "/h/en")]), (11, "/h/de", 200, None, None, [("de", "/h/de"), ("en", "/h/en"), ("x-default", "/h/en")]),
    (12, "/h/fr", 200, None, None, [("fr", "/h/fr"), ("en", "/h/en")]), (13, "/h/code", 200, None, None, [("english", "/h/code"), ("en-UK", "/h/en"), ("pt-BR", "/h/en"), ("zh-Hant-TW", "/h/en"), ("es-419", "/h/en")]),
    (14, "/h/to-gone", 200, None, None, [("en", "/h/to-gone"), ("de", "/c/gone")]), (15, "/h/moved", 200, None, "/h/en", []), (16, "/h/to-moved", 200, None, None, [("en", "/h/to-moved"), ("de", "/h/moved")]),
    (17, "/h/to-hidden", 200, None, None, [("en", "/h/to-hidden"), ("de", "/c/hidden")]), (18, "/h/twice", 200, None, None, [("en", "/h/twice"), ("EN", "/h/en")]),
    (21, "/t/a", 200, None, None, []), (22, "/t/b", 200, None, None, []),
    (19, "/h/other", 200, None, None, [("en", "/h/en"), ("x-default", "/h/en")]), (20, "/h/disputed", 200, None, None, [("en", "/h/disputed"), ("fr", "/h/en")]),
]


# Numbers of the linked pages that share title, description and body.
ALIKE = (21, 22)


def _linked_rows(d, base: str = "base") -> str:
    """The list of the linked pages of one crawl; base is its address without a trailing slash."""
    rows = []
    for number, path, status, robots, canonical, tags in LINKED:
        text = lambda v: "NULL" if v is None else f"'{v}'"
        alternates = d.array(*[d.struct(lang=f"'{a}'", url=f"{base} || '{b}'") for a, b in tags])
        if not tags:
            alternates = "NULL"
        rows.append(d.struct(
            n=str(number), url=f"{base} || '{path}'", status=str(status), meta_robots=d.cast(text(robots), "string"),
            title=d.cast("'A shared title'" if number in ALIKE else "NULL", "string"), meta_description=d.cast("repeat('Wide words. ', 20)" if number in ALIKE else "NULL", "string"),
            body_text=d.cast("'Sorry, page not found.'" if number in ALIKE else "NULL", "string"), word_count="4" if number in ALIKE else "0",
            canonical=d.cast("NULL" if canonical is None else f"{base} || '{canonical}'", "string"), hreflang_tags=alternates,
        ))
    return d.array(*rows)


def _base(crawls_url: str = "seed_url") -> str:
    return f"regexp_replace({crawls_url}, '/+$', '')"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots with every field, each page once; not audited yet."""
    names = [c for c in table(spark, sf_dir, "page_data").columns if c in PAGE_FIELDS]
    given = one_delivery(table(spark, sf_dir, "page_data"), "page_id", names)
    made = {k: F.expr(v) for k, v in fields(Spark).items()}
    own = given.select(*[c for c in given.columns if c not in made], *[v.alias(k) for k, v in made.items()])
    crawls = table(spark, sf_dir, "crawls").select("crawl_id", "domain", F.expr(_base()).alias("base"))
    linked = crawls.select("crawl_id", "domain", F.explode(F.expr(_linked_rows(Spark))).alias("p"))
    linked = linked.select(
        (F.lit(FIRST_LINKED) + F.col("crawl_id") * 100 + F.col("p.n")).alias("page_id"), "crawl_id", "domain", "p.url", "p.status", "p.meta_robots", "p.canonical", "p.hreflang_tags", "p.title", "p.meta_description", "p.body_text", "p.word_count",
        F.when(F.col("p.canonical").isNotNull(), "html").alias("canonical_source"), F.lit("text/html").alias("content_type"), F.lit(1).alias("depth"),
    )
    both = own.unionByName(linked, allowMissingColumns=True)
    return both.select(*[F.col(n).cast(t).alias(n) for n, t in PAGE_FIELDS.items() if n in both.columns])


def duck_pages() -> str:
    """The same table as a common table expression named derived."""
    made = ", ".join(f"{v} AS {k}" for k, v in fields(Duck).items())
    dropped = ", ".join(fields(Duck))
    return f"""derived AS (SELECT * FROM (SELECT * EXCLUDE ({', '.join(c for c in dropped.split(', ') if c in GIVEN)}), {made} FROM (SELECT DISTINCT ON (page_id) * FROM page_data WHERE page_id IS NOT NULL ORDER BY page_id))
UNION ALL BY NAME SELECT {FIRST_LINKED} + crawl_id * 100 + p.n AS page_id, crawl_id, domain, p.url AS url, p.status AS status, p.meta_robots AS meta_robots, p.canonical AS canonical, p.hreflang_tags AS hreflang_tags, p.title AS title, p.meta_description AS meta_description, p.body_text AS body_text, p.word_count AS word_count,
  CASE WHEN p.canonical IS NOT NULL THEN 'html' END AS canonical_source, 'text/html' AS content_type, 1 AS depth
  FROM (SELECT crawl_id, domain, unnest({_linked_rows(Duck, _base())}) AS p FROM crawls))"""


# Fixed value: made fields that the crawl table has already.
GIVEN = frozenset("url status redirect_chain h1 images canonical meta_robots external_links internal_links".split())
