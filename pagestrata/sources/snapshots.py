"""Page snapshots to audit-ready pages: derived columns, each page once."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions import text, urls
from pagestrata.schema import complete

# Robots directives that carry a value after a colon, so that the part before it is no user agent.
VALUED_DIRECTIVES = ["max-snippet", "max-image-preview", "max-video-preview", "unavailable_after"]


def _tokens(value: Column, separators: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(F.lower(value), F.lit("")), separators), lambda t: F.trim(t)), lambda t: t != "")


def header_directives(header: Column) -> Column:
    """Directives of an X-Robots-Tag header, without the user agents they are scoped to."""

    def bare(token: Column) -> Column:
        name = F.trim(F.substring_index(token, ":", 1))
        scoped = token.contains(":") & ~F.array_contains(F.lit(VALUED_DIRECTIVES), name)
        return F.when(scoped, F.trim(F.substring(token, F.instr(token, ":") + 1, F.lit(1 << 30)))).otherwise(token)

    return F.filter(F.transform(_tokens(header, ","), bare), lambda t: t != "")


def audit_pages(snapshots: DataFrame) -> DataFrame:
    """audit_columns of every page once; null page_ids are dropped."""
    return audit_columns(snapshots).where(F.col("page_id").isNotNull()).dropDuplicates(["page_id"])


def audit_columns(snapshots: DataFrame) -> DataFrame:
    """Every page field and what the checks need beside them.

    Fields a source lacks are nulls, except those that follow from others: lengths and widths of title and
    description, directives, soft-404 and content hash from the body. Added:
    url_key, is_html (2xx and HTML), is_ok (2xx), noindex, indexable, directives, chain_urls.
    """
    p = complete(snapshots)
    fill = lambda name, value: F.coalesce(F.col(name), value).alias(name)
    derived, added = _expressions(id(snapshots.sparkSession.sparkContext._gateway), "canonical_source" in snapshots.columns)
    p = p.select(*[fill(n, derived[n]) if n in derived else F.col(n) for n in p.columns]).withColumns(added)
    p = p.withColumn("is_html", F.col("is_ok") & F.col("html_type")).withColumn("noindex", F.arrays_overlap("directives", F.lit(["noindex", "none"])))
    return p.withColumn("indexable", F.col("is_html") & ~F.col("noindex"))


@functools.lru_cache(maxsize=4)
def _expressions(_gateway: int, sourced: bool) -> tuple[dict[str, Column], dict[str, Column]]:
    """Expressions of the fields that follow from others, and of the added columns; built once a process."""
    derived = {
        "title_length": text.rendered_length(F.col("title")), "title_pixel_width": text.pixel_width(F.col("title"), "title"),
        "meta_description_length": text.rendered_length(F.col("meta_description")),
        "meta_description_pixel_width": text.pixel_width(F.col("meta_description"), "description"),
        "meta_robots_directives": _tokens(F.col("meta_robots"), ","),
        "is_https": F.lower(F.col("url")).startswith("https://"),
        "has_self_canonical": urls.norm_url(F.col("canonical")) == urls.norm_url(F.col("url")),
        "canonical_source": F.when(F.col("canonical").isNotNull() & F.lit(not sourced), "html"),
    }
    added = {
        "content_hash": F.when(F.length("body_text") > 0, text.content_hash(F.col("body_text"))).otherwise(""),
        "is_soft_404": text.is_soft_404(F.coalesce("body_text", F.lit("")), F.col("title")) & F.col("status").between(200, 299),
        "url_key": urls.norm_url(F.col("url")),
        "is_ok": F.coalesce(F.col("status").between(200, 299), F.lit(False)),
        "html_type": F.coalesce(F.lower("content_type").rlike(r"text/html|application/xhtml\+xml"), F.lit(False)),
        "directives": F.concat(F.coalesce("meta_robots_directives", F.array().cast("array<string>")), header_directives(F.col("x_robots_tag"))),
        "chain_urls": F.transform("redirect_chain", lambda h: h["url"]),
        "has_body": F.length("body_text") > 0,
    }
    return derived, added
