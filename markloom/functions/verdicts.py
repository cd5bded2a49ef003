"""Cut line parsing and the PASS/FAIL rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markloom import constants as K

_CUT = f"-[{K.WHITESPACE}]*([0-9]+(?:\\.[0-9]+)?)[{K.WHITESPACE}]*(%|퍼센트)?"


def parse_cut(text: Column, n_items: Column) -> Column:
    """Allowed wrong answers from the first '-<number>' of the printed cut line, else NULL."""
    value = F.nullif(F.regexp_extract(text, _CUT, 1), F.lit("")).try_cast("double")
    percent = F.regexp_extract(text, _CUT, 2) != ""
    allowed = F.when(percent, F.floor(n_items * value / 100)).otherwise(F.floor(value))
    return F.when(n_items > 0, allowed)


def verdict(n_wrong: Column, cut: Column) -> Column:
    return F.when(cut.isNotNull(), F.when(n_wrong <= cut, F.lit("pass")).otherwise(F.lit("fail")))


def final_correct(teacher: Column, system: Column) -> Column:
    return F.coalesce(teacher, system)


def overturned(teacher: Column, system: Column) -> Column:
    return teacher.isNotNull() & ~teacher.eqNullSafe(system)


def is_unjudged(note: Column) -> Column:
    return F.coalesce(F.contains(note, F.lit(K.UNJUDGED_MARK)), F.lit(False))


def is_open(note: Column, final: Column) -> Column:
    """Never judged by the model and not yet judged by a person."""
    return is_unjudged(note) & final.isNull()


def missing_count(printed: Column, read: Column) -> Column:
    total = F.coalesce(printed, F.lit(0))
    return F.when(total > 0, F.greatest(F.lit(0), total - read)).otherwise(F.lit(0)).cast("bigint")


def has_level(warnings: Column, level: str) -> Column:
    return F.coalesce(F.exists(warnings, lambda w: w["level"] == level), F.lit(False))


def needs_review(status: Column, near: Column, verdict_: Column, drift: Column) -> Column:
    flagged = F.coalesce(near, F.lit(False)) | verdict_.isNull() | drift
    return F.coalesce((status == "graded") & flagged, F.lit(False))


def keep_name(existing: Column, transcribed: Column) -> Column:
    from markloom.functions.text import filled, trimmed

    return F.coalesce(filled(existing), trimmed(transcribed))


def wilson_lower(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """95 % lower confidence bound of k successes in n."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p, zz = k / n, z * z
    centre = p + zz / (2 * n)
    spread = z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n)
    return (centre - spread) / (1 + zz / n)
