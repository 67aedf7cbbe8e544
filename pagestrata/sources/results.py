"""Stored crawl results and page-speed measurements as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.functions.urls import norm_url
from pagestrata.operators.scoring import cwv_status
from pagestrata.schema import PAGE_FIELDS


def read_crawls(spark: SparkSession, path: str) -> DataFrame:
    """Pages of stored crawl results (one JSON document a file), with a crawl_id from the file's name and a page_id a position.

    The schema is given, so no pass over the data infers it.
    """
    fields = ", ".join(f"`{n}`: {t}" for n, t in PAGE_FIELDS.items() if n not in ("page_id", "crawl_id"))
    documents = spark.read.schema(f"pages array<struct<{fields}>>, file string").json(path, multiLine=True)
    named = documents.select(F.xxhash64(F.input_file_name()).alias("crawl_id"), F.posexplode("pages").alias("page_id", "p"))
    return named.select(F.col("page_id").cast("long").alias("page_id"), "crawl_id", "p.*")


def read_pagespeed(spark: SparkSession, path: str) -> DataFrame:
    """(url, lcp_ms, inp_ms, cls, fcp_ms, ttfb_ms, performance_score, cwv_status) from page-speed JSON files.

    INP comes from field data only; the score is the rounded percentage.
    """
    text = spark.read.text(path, wholetext=True)
    audit = lambda name: F.get_json_object("value", f"$.lighthouseResult.audits.{name}.numericValue").cast("double")
    inp = F.get_json_object("value", "$.loadingExperience.metrics.INTERACTION_TO_NEXT_PAINT.percentile").cast("double")
    measured = text.select(
        F.coalesce(F.get_json_object("value", "$.lighthouseResult.requestedUrl"), F.get_json_object("value", "$.id")).alias("url"),
        audit("largest-contentful-paint").alias("lcp_ms"), inp.alias("inp_ms"), audit("cumulative-layout-shift").alias("cls"),
        audit("first-contentful-paint").alias("fcp_ms"), audit("server-response-time").alias("ttfb_ms"),
        F.round(F.get_json_object("value", "$.lighthouseResult.categories.performance.score").cast("double") * 100).cast("int").alias("performance_score"),
    )
    return measured.withColumn("cwv_status", cwv_status(F.col("lcp_ms"), F.col("inp_ms"), F.col("cls")))


def with_measurements(pages: DataFrame, measured: DataFrame) -> DataFrame:
    """Pages with page-speed columns, joined by normalised address; a page without a measurement keeps nulls."""
    columns = [x for x in measured.columns if x != "url"]
    keyed = measured.select(norm_url(F.col("url")).alias("__key"), *columns).dropDuplicates(["__key"])
    bare = pages.drop(*columns).withColumn("__key", norm_url(F.col("url")))
    return bare.join(keyed, "__key", "left").drop("__key")
