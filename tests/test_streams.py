"""Streams against their batch forms, and a batch that is played again."""

import datetime as dt

from pyspark.sql import functions as F

from pagestrata.operators import checks
from pagestrata.sources.snapshots import audit_pages
from pagestrata.streaming import streams


def drained(stream, name, mode="append"):
    """All rows that a stream over finished files gives."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def events(spark, folder):
    at = dt.datetime(2024, 5, 1, 10)
    rows = [(u, at + dt.timedelta(minutes=m), k, 1.5) for u, m, k in ((1, 0, "view"), (1, 5, "view"), (2, 7, "view"), (1, 59, "buy"), (1, 61, "view"), (2, 200, "buy"), (None, 201, "buy"))]
    # A last event far ahead closes every window before it.
    rows.append((9, at + dt.timedelta(days=9), "end", 0.0))
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_type string, value double").repartition(3).write.mode("overwrite").parquet(folder)
    table = spark.read.parquet(folder)
    return table, spark.readStream.schema(table.schema).parquet(folder)


def test_hourly_and_sessions_stream_as_in_batch(spark, tmp_path):
    table, stream = events(spark, str(tmp_path / "events"))
    for name, of in (("hourly", streams.hourly), ("sessions", streams.sessions)):
        batch = {tuple(r) for r in of(table.where("event_type <> 'end'")).collect()}
        got = {tuple(r) for r in drained(of(stream, late="1 hour"), f"{name}_rows").collect()}
        assert got - {r for r in got if "end" in r or 9 in r} == batch
    hours = {(r.hour.hour, r.event_type): (r.events, r.users) for r in streams.hourly(table).collect()}
    assert hours[10, "view"] == (3, 2) and hours[13, "buy"] == (2, 1)


def test_progress(spark, tmp_path):
    at = dt.datetime(2024, 5, 1, 10)
    rows = [(1, at, 5, 10), (1, at + dt.timedelta(minutes=1), 9, 12), (2, at, 0, 1)]
    folder = str(tmp_path / "progress")
    spark.createDataFrame(rows, "job_id long, at timestamp, crawled long, discovered long").write.parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    assert {(r.job_id, r.crawled, r.discovered) for r in drained(streams.progress(stream), "progress_rows", "complete").collect()} == {(1, 9, 12), (2, 0, 1)}


def test_accumulated_findings_are_renewed(spark, tmp_path, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/page_data.parquet")
    source, store, report = (str(tmp_path / n) for n in ("in", "store", "report"))
    for rest in (0, 1):
        pages.where(F.col("page_id") % 2 == rest).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):
            # The second run finds nothing new; a checkpoint that is lost plays all files again as one batch.
            streams.accumulate(streams.snapshots(spark, source), store, report, str(tmp_path / "checkpoint")).awaitTermination()
    audited = audit_pages(pages)
    expected = checks.duplicate_issues(audited).unionByName(checks.canonical_issues(audited)).unionByName(checks.hreflang_issues(audited)).unionByName(checks.link_issues(audited))
    key = lambda df: sorted((r.crawl_id, r.check, str(r.url)) for r in df.collect())
    assert key(streams.current_report(spark, report)) == key(expected)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "store").iterdir() if p.name.startswith("batch="))
    before = spark.read.parquet(store).count()
    spark.read.parquet(f"{store}/batch={last}").write.mode("overwrite").parquet(str(tmp_path / "again"))
    spark.read.parquet(str(tmp_path / "again")).write.mode("overwrite").parquet(f"{store}/batch={last}")
    assert spark.read.parquet(store).count() == before
