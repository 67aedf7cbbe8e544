"""Streams of page snapshots and events.

Row-local checks are streaming-safe as they are: the same Column pipeline runs on a stream of snapshots.
Checks that compare pages run per micro-batch against what has accumulated. Aggregates over event time
carry a watermark; the batch forms below give the same rows over a finished table.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.operators import checks
from pagestrata.sources.snapshots import audit_columns, audit_pages

LATE = "2 days"
SESSION_GAP = "30 minutes"


def snapshots(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """New snapshot files of a folder as a stream; the schema is that of the files present."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(stream: DataFrame, key: str = "page_id", at: str = "ingested_at", late: str = LATE) -> DataFrame:
    """Each key once within the watermark, however often it is delivered."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def row_issues(stream: DataFrame) -> DataFrame:
    """Findings of the row-local checks of new pages, appended as they arrive."""
    return checks.row_issues(audit_columns(once(stream)))


def accumulate(stream: DataFrame, store: str, report: str, checkpoint: str):
    """Keep new pages in a table and renew the relational findings of the crawls they touch, per micro-batch.

    Each batch owns one folder of the store and one of the report, named by its number, and replaces what it finds there: a batch that is
    played again after a failure changes nothing. current_report() gives the findings that hold.
    """

    def renew(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        touched = batch.select("crawl_id").distinct()
        known = spark.read.parquet(store).where(F.col("batch") <= number).drop("batch").join(touched, "crawl_id", "left_semi")
        pages = audit_pages(known)
        found = [f(pages) for f in (checks.duplicate_issues, checks.canonical_issues, checks.hreflang_issues, checks.link_issues)]
        marks = touched.select("crawl_id", *[F.lit(None).cast("string").alias(x) for x in checks.ISSUE if x != "crawl_id"])
        functools.reduce(DataFrame.unionByName, [marks, *found]).write.mode("overwrite").parquet(f"{report}/batch={number}")

    return stream.writeStream.foreachBatch(renew).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_report(spark: SparkSession, report: str) -> DataFrame:
    """The findings of each crawl from the last batch that touched it (which leaves a row without a check even where it found nothing)."""
    every = spark.read.parquet(report)
    last = every.groupBy("crawl_id").agg(F.max("batch").alias("batch"))
    return every.join(last, ["crawl_id", "batch"], "left_semi").where(F.col("check").isNotNull()).drop("batch")


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """(hour, event_type, events, users, value) in tumbling hours. With late the input is a stream.

    Users are distinct in both forms: events are added up by user first, then users are counted, so a stream carries two aggregations.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if late else timed
    by_user = timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type", "user_id").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    hour = F.window(F.window_time("w"), "1 hour").alias("h")
    counted = by_user.groupBy(hour, "event_type").agg(F.sum("events").alias("events"), F.count("user_id").alias("users"), F.round(F.sum("value"), 4).alias("value"))
    return counted.select(F.col("h.start").cast("timestamp_ntz").alias("hour"), "event_type", "events", "users", "value")


def sessions(events: DataFrame, gap: str = SESSION_GAP, late: str | None = None) -> DataFrame:
    """(user_id, session_start, session_end, events): runs of a user's events without a longer gap; the end is the last event's time."""
    timed = events.where(F.col("user_id").isNotNull()).withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if late else timed
    grouped = timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events"), F.max("at").alias("last"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("last").cast("timestamp_ntz").alias("session_end"), "events")


def progress(events: DataFrame, late: str = LATE) -> DataFrame:
    """Latest state of each job from its progress events (job_id, at, crawled, discovered)."""
    return events.withWatermark("at", late).groupBy("job_id").agg(F.max("crawled").alias("crawled"), F.max("discovered").alias("discovered"), F.max("at").alias("at"))
