"""Streams in several micro-batches give the batch result."""

import datetime as dt

from pyspark.sql import functions as F

from markloom.operators.usage import hours_table, usage_by_hour
from markloom.session import scratch_path
from markloom.streaming import jobs


def write_parts(df, path, parts):
    for i in range(parts):
        df.filter(F.col("n") % parts == i).coalesce(1).write.mode("append").parquet(path)


def test_hours_over_many_batches(spark):
    path = scratch_path(spark, "in")
    base = dt.datetime(2026, 8, 9)
    rows = [(i, base + dt.timedelta(minutes=37 * i)) for i in range(200)]
    df = spark.createDataFrame(rows, "n long, created_at timestamp")
    write_parts(df, path, 5)  # every file spans all days, nothing may be dropped
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = jobs.stream_usage_by_hour(spark, stream, hours_table(spark)).collect()
    want = usage_by_hour(df, hours_table(spark)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_first_reference_wins_across_batches(spark):
    path = scratch_path(spark, "in")
    df = spark.createDataFrame([(0, "a", "first"), (1, "a", "second"), (2, "b", "third")], "n long, fingerprint string, v string")
    write_parts(df, path, 3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.fingerprint for r in jobs.stream_first_ref_wins(spark, stream).collect()}
    assert got == {"a", "b"}


def test_cancelled_absorbs_results_until_queued_again(spark):
    path = scratch_path(spark, "in")
    log = [(1, "queued"), (1, "running"), (1, "cancelled"), (1, "graded"), (2, "queued"), (2, "cancelled"), (2, "queued"), (2, "graded"), (3, "failed")]
    rows = [(i, s, st, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i), i) for i, (s, st) in enumerate(log)]
    df = spark.createDataFrame(rows, "n long, sheet_id int, status string, changed_at timestamp, change_id int")
    write_parts(df, path, 4)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.status: (r.sheets, r.changes) for r in jobs.stream_latest_status(spark, stream).collect()}
    assert got == {"cancelled": (1, 4), "graded": (1, 4), "failed": (1, 1)}


def test_watermark_drops_only_what_is_too_late(spark):
    path = scratch_path(spark, "in")
    days = [(0, 9, 5), (0, 9, 6), (1, 9, 7), (2, 9, 1)]  # the last one is six days late
    df = spark.createDataFrame([(n, dt.datetime(2026, 8, d, h)) for n, h, d in days], "n long, created_at timestamp")
    write_parts(df, path, 3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    total = lambda late: sum(r.total for r in jobs.stream_usage_by_hour(spark, stream, hours_table(spark), late=late).collect())
    assert (total("1 day"), total(None)) == (3, 4)
