"""HTML responses to page records: one pass of a tokenizer with the insertion modes that decide what is head and what is body."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagestrata.functions.text import reading_ease
from pagestrata.functions.urls import norm, resolve
from pagestrata.runtime import ship
from pagestrata.schema import PAGE_FIELDS

# Fixed values of the HTML standard and of structured-data guidelines.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes script style template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound".split())
NO_TEXT = frozenset("script style noscript template".split())
SCRIPT_TYPES = frozenset(["", "module", "text/javascript", "application/javascript", "text/ecmascript", "application/ecmascript", "text/jscript"])
NO_LINK = ("#", "mailto:", "tel:", "javascript:", "data:", "sms:", "callto:")
REQUIRED = {
    "Product": ["name"], "LocalBusiness": ["name", "address"], "BreadcrumbList": ["itemListElement"], "FAQPage": ["mainEntity"],
    "Recipe": ["name", "image"], "Event": ["name", "startDate", "location"], "VideoObject": ["name", "uploadDate", "thumbnailUrl"],
}
SUBRESOURCES = frozenset("img script iframe video audio source".split())

_WIDE = re.compile("[ᄀ-ᅟ⺀-〾ぁ-䶿一-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦\U00020000-\U0002fa1f฀-໿ក-៿က-႟]")


def _flat(text: str) -> str:
    return " ".join(text.split())


def count_words(text: str) -> int:
    return len(_WIDE.findall(text)) + sum(1 for w in text.split() if not _WIDE.search(w))


class _Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.base = url, None
        self.host = (urlsplit(url).hostname or "").lower()
        self.stack: list[str] = []
        self.mode = "head"  # head, after_head or body
        self.titles: list[tuple[str, bool]] = []
        self.metas: list[tuple[dict, bool]] = []
        self.links: list[tuple[dict, bool]] = []
        self.headings: list[tuple[int, str]] = []
        self.anchors: list[tuple[dict, str]] = []
        self.images: list[dict] = []
        self.scripts: list[tuple[dict, bool, str]] = []
        self.json_ld: list[str] = []
        self.micro: list[str] = []
        self.resources: list[str] = []
        self.forms: list[str] = []
        self.texts: list[str] = []
        self.taking: list[tuple[str, list[str], dict, bool]] = []

    def _live(self) -> bool:
        return "template" not in self.stack

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and "svg" in self.stack:
            self.handle_endtag(tag)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a: dict[str, str] = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag in ("html", "head"):
            return
        if tag == "body":
            self.mode = "body"
            return
        if self.mode != "body" and tag not in IN_HEAD and not {"template", "noscript"} & set(self.stack):
            self.mode = "body"
        in_head = self.mode != "body"
        if tag in ("p", "li") and tag in self.stack:
            self._close(tag)
        if tag not in VOID:
            self.stack.append(tag)
        if not self._live() and tag != "template":
            return
        if tag == "base" and self.base is None and "href" in a:
            self.base = resolve(self.url, a["href"])
        elif tag == "meta":
            self.metas.append((a, in_head))
        elif tag == "link":
            self.links.append((a, in_head))
        elif tag == "img" and "src" in a:
            self.images.append(a)
        elif tag == "form" and a.get("action", "").strip().lower().startswith("http://"):
            self.forms.append(a["action"].strip())
        if tag in SUBRESOURCES and a.get("src", "").startswith("http://"):
            self.resources.append(a["src"])
        if "itemscope" in a and a.get("itemtype"):
            self.micro.append(a["itemtype"])
        if (tag == "title" and "svg" not in self.stack) or tag in ("a", "script") or re.fullmatch("h[1-6]", tag):
            self.taking.append((tag, [], a, in_head))

    def _close(self, tag: str) -> None:
        while self.stack:
            last = self.stack.pop()
            for k in range(len(self.taking) - 1, -1, -1):
                if self.taking[k][0] == last:
                    self._taken(*self.taking.pop(k))
                    break
            if last == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "head" and self.mode == "head":
            self.mode = "after_head"
        elif tag in self.stack:
            self._close(tag)

    def _taken(self, tag: str, pieces: list[str], a: dict, in_head: bool) -> None:
        text = "".join(pieces)
        if tag == "title":
            self.titles.append((_flat(text), in_head))
        elif tag == "a":
            self.anchors.append((a, _flat(text)))
        elif tag == "script":
            kind = a.get("type", "").split(";")[0].strip().lower()
            if kind == "application/ld+json":
                self.json_ld.append(text)
            elif kind in SCRIPT_TYPES:
                self.scripts.append((a, in_head, text))
        else:
            self.headings.append((int(tag[1]), _flat(text)))

    def handle_data(self, data: str) -> None:
        if not self._live():
            return
        if self.mode != "body" and data.strip() and not self.stack:
            self.mode = "body"
        hidden = NO_TEXT & set(self.stack)
        for tag, pieces, _, _ in self.taking:
            if tag == "script" or not hidden:
                pieces.append(data)
        if self.mode == "body" and not hidden and data.strip():
            self.texts.append(_flat(data))

    def close(self) -> None:
        super().close()
        while self.stack:
            self._close(self.stack[-1])


def _entities(value: object) -> list[dict]:
    if isinstance(value, list):
        return [e for x in value for e in _entities(x)]
    if isinstance(value, dict):
        return _entities(value["@graph"]) if "@graph" in value else [value] if "@type" in value else []
    return []


def _types(value: object) -> list[str]:
    out: list[str] = []
    stack = [value]
    while stack:
        v = stack.pop(0)
        if isinstance(v, list):
            stack = v + stack
        elif isinstance(v, dict):
            t = v.get("@type")
            out += [t] if isinstance(t, str) else [x for x in t or [] if isinstance(x, str)] if isinstance(t, list) else []
            stack = list(v.values()) + stack
    return out


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"\d{1,9}", text.strip()) else None


def parse_html(html: str, url: str) -> dict:
    """The page fields an HTML document decides, by name."""
    page = _Page(url)
    page.feed(html)
    page.close()
    base = page.base or url
    rels = lambda a: a.get("rel", "").lower().split()
    named = lambda name: [(a, h) for a, h in page.metas if a.get("name", "").strip().lower() == name]
    descriptions = named("description")
    robots: list[str] = []
    for a, _ in page.metas:
        name = a.get("name", "").strip().lower()
        if name in ("robots", "googlebot"):
            robots.append(a.get("content", ""))
        elif name == "googlebot-news":
            robots += [f"googlebot-news: {t.strip()}" for t in a.get("content", "").split(",") if t.strip()]
    canonicals = [(a["href"], h) for a, h in page.links if "canonical" in rels(a) and "href" in a]
    canonical = resolve(base, canonicals[0][0]) if canonicals else None
    internal, external, unsafe = [], [], []
    for a, text in page.anchors:
        href = a.get("href", "").strip()
        if "href" not in a or href.lower().startswith(NO_LINK):
            continue
        target = resolve(base, href)
        if target is None:
            continue
        host = (urlsplit(target).hostname or "").lower()
        link = {"url": target, "anchor": text, "nofollow": "nofollow" in a.get("rel", "").lower()}
        (internal if not host or host == page.host else external).append(link)
        if a.get("target", "").lower() == "_blank" and host and host != page.host and not {"noopener", "noreferrer"} & set(rels(a)):
            unsafe.append(target)
    images = []
    for a in page.images:
        src = resolve(base, a["src"])
        if src is not None:
            images.append({"src": src, "alt": a.get("alt"), "width": _number(a.get("width")), "height": _number(a.get("height"))})
    blocks, types = [], []
    for raw in page.json_ld:
        try:
            value = json.loads(raw)
        except ValueError as error:
            blocks.append({"format": "json_ld", "schema_type": None, "raw": raw, "parse_error": str(error), "missing_required": []})
            continue
        types += _types(value)
        found = _entities(value)
        for entity in found or [None]:
            kind = None
            if entity is not None:
                t = entity["@type"]
                kind = t if isinstance(t, str) else next((x for x in t if isinstance(x, str)), None) if isinstance(t, list) else None
            missing = [f for f in REQUIRED.get(kind, []) if entity.get(f) is None] if entity is not None else []
            text = raw if len(found) < 2 else json.dumps(entity, ensure_ascii=False)
            blocks.append({"format": "json_ld", "schema_type": kind, "raw": text, "parse_error": None, "missing_required": missing})
    blocks += [{"format": "microdata", "schema_type": m.rsplit("/", 1)[-1], "raw": m, "parse_error": None, "missing_required": []} for m in page.micro]
    scripts = []
    for a, in_head, text in page.scripts:
        src = a.get("src")
        host = (urlsplit(src).hostname or "") if src and re.match(r"(?i)^[a-z]+://", src) else ""
        scripts.append({"src": src, "is_async": "async" in a, "is_defer": "defer" in a, "is_module": a.get("type", "").strip().lower() == "module", "in_head": in_head,
                        "size_bytes": 0 if src is not None else len(text.encode()), "is_third_party": bool(host) and host.lower() != page.host})
    secure = url.lower().startswith("https://")
    sheets = [a["href"] for a, _ in page.links if "stylesheet" in rels(a) and a.get("href", "").startswith("http://")]
    paging = {k: next((resolve(base, a["href"]) for a, _ in page.links if k in rels(a) and "href" in a), None) for k in ("prev", "next")}
    body = " ".join(page.texts)
    title = page.titles[0][0] if page.titles else None
    return {
        "title": title, "title_count": len(page.titles), "title_in_head": bool(page.titles and page.titles[0][1]),
        "meta_description": _flat(descriptions[0][0].get("content", "")) if descriptions else None,
        "meta_description_count": len(descriptions), "meta_desc_in_head": any(h for _, h in descriptions),
        "meta_robots": ", ".join(robots) if robots else None,
        "canonical": canonical, "canonical_count": len(canonicals), "canonical_source": "html" if canonical and any(h for _, h in canonicals) else None,
        "canonical_is_relative": bool(canonicals) and not re.match(r"(?i)^https?://", canonicals[0][0].strip()),
        "has_self_canonical": canonical is not None and norm(canonical) == norm(url),
        "h1": [t for level, t in page.headings if level == 1], "headings": [{"level": level, "text": t} for level, t in page.headings],
        "body_text": body, "word_count": count_words(body), "content_hash": hashlib.sha256(_flat(body).encode()).hexdigest(),
        "internal_links": internal, "external_links": external, "unsafe_cross_origin_links": unsafe, "images": images,
        "schema_types": types, "structured_data": blocks,
        "og_tags": {a["property"]: a.get("content", "") for a, _ in page.metas if a.get("property", "").startswith("og:")},
        "hreflang_tags": [{"lang": a["hreflang"], "url": resolve(base, a.get("href", "")) or a.get("href", "")} for a, h in page.links if h and "alternate" in rels(a) and "hreflang" in a],
        "pagination": paging if any(paging.values()) else None,
        "mixed_content": page.resources + sheets if secure else [], "insecure_forms": page.forms, "scripts": scripts, "is_https": secure,
    }


PARSED = [n for n in PAGE_FIELDS if n in parse_html("", "https://x.example/")]


def header_canonical(value: Column) -> Column:
    """The target of a Link header with rel=canonical; commas inside <> do not separate links."""
    target = F.trim(F.regexp_extract(value, r"(?i)<([^>]*)>[^,<]*;\s*rel\s*=\s*\"?(?:[^\";,<]*\s)?canonical(?:[\s\",;]|$)", 1))
    return F.when(target != "", target)


def parse_pages(fetches: DataFrame) -> DataFrame:
    """Fetched responses to pages. fetches has url, html and any page fields known from the response
    (status, headers ARRAY<STRUCT<name,value>>, ...). Bodies are parsed for 2xx and 3xx HTML responses only;
    the raw body does not travel further."""
    ship(fetches.sparkSession)
    present = [f for f in fetches.columns if f not in ("html", "headers", "readability_score") and f not in PARSED]
    schema = T._parse_datatype_string(", ".join(f"`{n}` {PAGE_FIELDS[n]}" for n in PARSED))
    kept = [fetches.schema[f] for f in present]
    arrow = to_arrow_schema(T.StructType([*kept, *schema.fields]))
    html_type = F.coalesce(F.lower("content_type").rlike(r"text/html|application/xhtml\+xml"), F.lit(True)) if "content_type" in fetches.columns else F.lit(True)
    fine = F.coalesce(F.col("status").between(200, 399), F.lit(True)) if "status" in fetches.columns else F.lit(True)
    read = fetches.select(*present, F.when(fine & html_type, F.col("html")).alias("__html"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.to_pydict()
            parsed = [parse_html(h, u) if h is not None else {} for h, u in zip(columns["__html"], columns["url"])]
            arrays = [pa.array(columns[f.name] if f.name in present else [p.get(f.name) for p in parsed], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    pages = read.mapInArrow(over, T.StructType([*kept, *schema.fields]))
    return pages.withColumn("readability_score", reading_ease(F.col("body_text")).cast("float"))


def response_columns(fetches: DataFrame) -> DataFrame:
    """Header-derived columns added: x_robots_tag, header_canonical and security_headers. Names match in any case; the first of a name wins."""

    def header(name: str):
        return F.get(F.filter("headers", lambda h: F.lower(h["name"]) == name), 0)["value"]

    has = lambda name: F.exists("headers", lambda h: F.lower(h["name"]) == name)
    referrer = F.element_at(F.filter("headers", lambda h: F.lower(h["name"]) == "referrer-policy"), -1)
    security = F.struct(
        has("strict-transport-security").alias("hsts"), has("content-security-policy").alias("csp"), has("x-content-type-options").alias("x_content_type_options"),
        has("x-frame-options").alias("x_frame_options"), has("referrer-policy").alias("referrer_policy"), F.when(has("referrer-policy"), referrer["value"]).alias("referrer_value"),
    )
    return fetches.withColumns({"x_robots_tag": header("x-robots-tag"), "header_canonical": header_canonical(header("link")), "security_headers": security})


def with_header_canonical(pages: DataFrame) -> DataFrame:
    """A canonical from the response header fills in for a missing one, and is noted beside one from the markup."""
    both, only = F.col("canonical").isNotNull() & F.col("header_canonical").isNotNull(), F.col("canonical").isNull() & F.col("header_canonical").isNotNull()
    return pages.withColumns(
        {
            "canonical_source": F.when(both, "both").when(only, "http_header").otherwise(F.col("canonical_source")),
            "canonical": F.coalesce("canonical", "header_canonical"),
        }
    ).drop("header_canonical")
