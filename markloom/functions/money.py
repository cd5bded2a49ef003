"""Ratios, currency and waiting-time wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markloom import constants as K


def krw(usd: Column) -> Column:
    """Rounded half up, also below zero."""
    return F.floor(usd * K.KRW_PER_USD + 0.5).cast("bigint")


def pct(num: Column, den: Column) -> Column:
    shown = F.format_string("%.1f%%", (num / F.nullif(den, F.lit(0))).cast("double") * 100)
    return F.when(F.coalesce(den, F.lit(0)) != 0, shown).otherwise(F.lit("—"))


def describe_wait(seconds: Column) -> Column:
    minutes = F.concat(F.lit("약 "), F.ceil(seconds / 60).cast("string"), F.lit("분"))
    return F.when(seconds <= 0, F.lit("")).when(seconds < 90, F.lit("1분 안")).otherwise(minutes)


def round2(c: Column) -> Column:
    """Two digits, ties toward plus infinity."""
    return F.floor(c * 100 + 0.5).cast("double") / 100


def edge_factor(src: Column, dst: Column) -> Column:
    return (dst / src) * (dst / src)


def token_factor(src: Column, dst: Column) -> Column:
    return F.when(dst >= src, F.lit(1.0)).otherwise(edge_factor(src, dst))


def fit_side(side: Column, other: Column, max_edge: Column) -> Column:
    """Length of one side after scaling the longer one down to max_edge."""
    long_side = F.greatest(side, other)
    scaled = F.floor(side * (max_edge / long_side) + 0.5).cast("bigint")
    return F.when(long_side <= max_edge, side.cast("bigint")).otherwise(scaled)
