"""XML sitemaps: reading into entries, sources and problems, and writing."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.runtime import ship, written

# Limits of the sitemap protocol.
URLS_A_FILE = 50_000
URLS_IN_ALL = 50_000
INDEX_DEPTH = 2
LOC_BYTES = 2048
NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"


def parse(text: str | None) -> dict | None:
    """kind (index, urlset or none), locs, invalid locs, and whether the XML is malformed. What stands before an error counts."""
    if text is None:
        return None
    locs, kind, malformed = [], "none", False
    parser = ET.XMLPullParser(["start", "end"])
    stack: list[str] = []
    try:
        parser.feed(text.lstrip("﻿ \t\r\n"))
        parser.close()
    except ET.ParseError:
        malformed = True
    try:
        for event, element in parser.read_events():
            name = element.tag.rsplit("}", 1)[-1].lower()
            if event == "start":
                stack.append(name)
                if len(stack) == 1:
                    kind = {"sitemapindex": "index", "urlset": "urlset"}.get(name, "none")
            else:
                stack.pop()
                if name == "loc" and stack[-1:] in (["url"], ["sitemap"]):
                    locs.append((element.text or "").strip())
    except ET.ParseError:
        malformed = True
    good, invalid = [], []
    for x in locs:
        (good if re.match(r"(?i)^https?://[^/\s]", x) and len(x.encode()) <= LOC_BYTES else invalid).append(x)
    return {"kind": kind, "locs": good, "invalid": invalid, "malformed": malformed and kind != "none"}


def read(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, sources, problems) of fetched sitemap files (crawl_id, source, text, status); unreachable ones have a null text.

    Files that no index names are the roots; the children of an index are followed INDEX_DEPTH levels down, each file once. A file that an
    index names but that is missing, and one that is neither an index nor a url set, is unreachable. At most URLS_IN_ALL urls a crawl are
    entries, in the order of the indexes; a crawl with more is reported as truncated.
    """
    ship(files.sparkSession)
    schema = "struct<kind:string,locs:array<string>,invalid:array<string>,malformed:boolean>"
    parsed = files.select("crawl_id", "source", F.octet_length("text").cast("long").alias("size_bytes"), F.when(F.col("text").isNotNull(), F.udf(parse, schema, useArrow=True)("text")).alias("p"))
    parsed = written(parsed.dropDuplicates(["crawl_id", "source"]), "sitemap-files")
    child = parsed.where("p.kind = 'index'").select("crawl_id", F.col("source").alias("parent"), F.posexplode("p.locs").alias("nth", "source"))
    named = child.select("crawl_id", "source").distinct()
    level = parsed.join(named, ["crawl_id", "source"], "left_anti").select("crawl_id", "source", F.array("source").alias("place"))
    seen = level
    for _ in range(INDEX_DEPTH):
        level = child.join(level.withColumnRenamed("source", "parent"), ["crawl_id", "parent"]).select("crawl_id", "source", F.concat("place", F.array(F.lpad(F.col("nth").cast("string"), 9, "0"))).alias("place"))
        seen = seen.unionByName(level)
    seen = seen.groupBy("crawl_id", "source").agg(F.min("place").alias("place")).join(parsed, ["crawl_id", "source"], "left")
    seen = written(seen, "sitemap-order")
    sets = seen.where("p.kind = 'urlset'")
    # One row a file: the order of a crawl's files, not of its urls.
    before = Window.partitionBy("crawl_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.size("p.locs")).over(before), F.lit(0)).alias("offset")
    entries = sets.select("crawl_id", "source", "p", offset).select("crawl_id", "source", "offset", F.posexplode("p.locs").alias("nth", "url")).where(F.col("offset") + F.col("nth") < URLS_IN_ALL)
    over = sets.groupBy("crawl_id").agg(F.sum(F.size("p.locs")).alias("n")).where(F.col("n") > URLS_IN_ALL)
    sources = seen.where("p.kind in ('index', 'urlset')").select("crawl_id", "source", (F.size("p.locs") + F.size("p.invalid")).cast("long").alias("url_count"), "size_bytes")
    kinds = [
        files.select("crawl_id", F.lit("discovered").alias("kind"), F.lit(None).cast("string").alias("url")).distinct(),
        over.select("crawl_id", F.lit("truncated").alias("kind"), F.lit(None).cast("string").alias("url")),
        seen.where("p is null or p.kind = 'none'").select("crawl_id", F.lit("unreachable").alias("kind"), F.col("source").alias("url")),
        seen.where("p.malformed").select("crawl_id", F.lit("malformed").alias("kind"), F.col("source").alias("url")),
        seen.select("crawl_id", F.lit("invalid_loc").alias("kind"), F.explode("p.invalid").alias("url")),
    ]
    return entries.select("crawl_id", "url", "source"), sources, kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3]).unionByName(kinds[4])


def listed_urls(pages: DataFrame) -> DataFrame:
    """(crawl_id, file_no, position, url): what a crawl's own sitemap lists, in order, 50,000 a file.

    Urls are placed in ranges of (crawl_id, url), however alike they begin; the order within a crawl comes from the counts of
    these ranges and an order within each of them, so no window holds a whole crawl.
    """
    fit = F.col("indexable") & (F.col("canonical").isNull() | F.coalesce("has_self_canonical", F.lit(False)) | (F.col("canonical") == F.col("url")))
    urls = pages.where(fit & (F.octet_length("url") <= LOC_BYTES)).select("crawl_id", "url").distinct()
    placed = written(urls.repartitionByRange("crawl_id", "url").withColumn("part", F.spark_partition_id()), "sitemap-ranges")
    counts = placed.groupBy("crawl_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("crawl_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("crawl_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("crawl_id", "part").orderBy("url")
    position = F.col("offset") + F.row_number().over(inner) - 1
    return placed.join(offsets, ["crawl_id", "part"]).select("crawl_id", F.floor(position / URLS_A_FILE).cast("int").alias("file_no"), position.cast("long").alias("position"), "url")


def xml_escape(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def write(pages: DataFrame, folder: str) -> None:
    """One XML file a (crawl, file number), and an index beside them where a crawl has several; nothing for an empty crawl."""
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="{NAMESPACE}">\n'
    listed = listed_urls(pages)
    body = F.concat(F.lit("  <url><loc>"), xml_escape(F.col("url")), F.lit("</loc></url>"))
    # A file is bounded by the protocol's 50,000 urls, so one row may hold it.
    files = listed.groupBy("crawl_id", "file_no").agg(F.array_sort(F.collect_list(F.struct("position", body.alias("x")))).alias("rows"))
    text = F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["x"]), "\n"), F.lit("\n</urlset>\n"))
    files.select("crawl_id", "file_no", text.alias("value")).write.partitionBy("crawl_id", "file_no").mode("overwrite").text(f"{folder}/urlsets")
    several = files.groupBy("crawl_id").agg(F.max("file_no").alias("last")).where("last > 0")
    names = F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.concat(F.lit("  <sitemap><loc>sitemap-"), (k + 1).cast("string"), F.lit(".xml</loc></sitemap>")))
    index = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="{NAMESPACE}">\n'), F.array_join(names, "\n"), F.lit("\n</sitemapindex>\n"))
    several.select("crawl_id", index.alias("value")).write.partitionBy("crawl_id").mode("overwrite").text(f"{folder}/indexes")
