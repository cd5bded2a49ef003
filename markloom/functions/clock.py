"""Time helpers: reports use UTC+9, stored timestamps are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markloom import constants as K


def kst(ts: Column) -> Column:
    return ts + F.expr(f"INTERVAL {K.KST_HOURS} HOURS")


def kst_day(ts: Column) -> Column:
    """0 = Sunday."""
    return (F.dayofweek(kst(ts)) - 1).cast("int")


def kst_hour(ts: Column) -> Column:
    return F.hour(kst(ts)).cast("int")


def day_column(moment: str) -> str:
    """Name of the partition column of a table stored by the day of ``moment``."""
    return f"{moment}_day"


def on_day(ts: Column, day: str, until: str | None = None) -> Column:
    """Half-open day range, so that the filter reaches the scan as a plain range."""
    start = F.lit(day).cast("date").cast("timestamp_ntz")
    end = F.date_add(F.lit(until or day).cast("date"), 1).cast("timestamp_ntz")
    return (ts >= start) & (ts < end)


def retest_cutoff(now: Column) -> Column:
    """Two calendar months back, day clamped to the month, time of day kept."""
    return F.expr("INTERVAL '0' SECOND") + now - F.make_ym_interval(F.lit(0), F.lit(K.RETEST_MONTHS))


def key_days_left(updated: Column, now: Column) -> Column:
    """Whole days (rounded up) until a key expires; zero or less when it already should be gone."""
    gone = updated + F.expr(f"INTERVAL {K.KEY_RETENTION_DAYS} DAYS")
    micros = F.timestamp_diff("MICROSECOND", now, gone)
    return F.ceil(micros / F.lit(86400000000)).cast("bigint")
