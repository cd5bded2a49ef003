"""Table maintenance: merges, replacement, retention, work list, rule checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions.clock import day_column, key_days_left, on_day
from markloom.operators import sequences as S


def during(df: DataFrame, moment: str, start: str, until: str | None = None) -> DataFrame:
    """Rows of a day, or of a range of days.

    Of a table stored by ``write_by_day`` only the folders of these days are listed and read; its day column
    is left out of the rows.
    """
    rows = df.filter(F.col(moment).isNotNull() & on_day(F.col(moment), start, until))
    day = day_column(moment)
    if day not in df.columns:
        return rows
    return rows.filter(F.col(day).between(F.lit(start).cast("date"), F.lit(until or start).cast("date"))).drop(day)


def scan_day(df: DataFrame, day: str, until: str | None = None) -> DataFrame:
    """Rows created on a day (or day range), newest first."""
    return during(df, "created_at", day, until).orderBy(F.col("created_at").desc(), F.col("sheet_id").desc())


def scan_graded_between(sheets: DataFrame, start: str, end: str) -> DataFrame:
    return during(sheets, "graded_at", start, end)


def scan_usage_between(events: DataFrame, start: str, end: str) -> DataFrame:
    return during(events, "created_at", start, end)


def items_for_sheets(items: DataFrame, sheets: DataFrame) -> DataFrame:
    return items.join(sheets.select("sheet_id"), "sheet_id", "left_semi")


def merge_first_wins(stored: DataFrame, incoming: DataFrame, key: str, arrival: list[str]) -> DataFrame:
    """Rows to append: the earliest arrival of every key that is not stored yet."""
    fresh = incoming.join(stored.select(key), key, "left_anti")
    return S.first_rows(fresh, [key], [F.col(c) for c in arrival])


def merge_last_wins(stored: DataFrame, incoming: DataFrame, key: str, updated: str = "updated_at") -> DataFrame:
    """The table after an upsert: per key the newest row, every column replaced, also by NULL.

    An incoming row beats a stored one with the same time.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return S.first_rows(both, [key], [F.col(updated).desc_nulls_last(), F.col("_new").desc()]).drop("_new")


def replace_children(stored: DataFrame, incoming: DataFrame, sheets: DataFrame, parent: str = "sheet_id") -> DataFrame:
    """Items after re-grading: a regraded sheet's old items go, the new set comes; cancelled sheets keep theirs."""
    cancelled = sheets.filter("status = 'cancelled'").select(parent)
    accepted = incoming.join(cancelled, parent, "left_anti")
    kept = stored.join(accepted.select(parent).distinct(), parent, "left_anti")
    return kept.unionByName(accepted)


def retained_pages(photos: DataFrame) -> DataFrame:
    return photos.filter("purged_at is null").orderBy("sheet_id", "idx")


def expired_pages(photos: DataFrame, now: Column) -> DataFrame:
    limit = now - F.expr(f"INTERVAL {K.PAGE_RETENTION_DAYS} DAYS")
    return photos.filter(F.col("purged_at").isNull() & (F.col("created_at") < limit))


def retention_status(photos: DataFrame, now: Column) -> DataFrame:
    kept = F.col("purged_at").isNull()
    old = F.col("created_at") < now - F.expr(f"INTERVAL {K.PAGE_RETENTION_DAYS} DAYS")
    return photos.agg(
        F.count_if(kept).alias("kept"), F.count_if(kept & old).alias("expired"), F.count_if(~kept).alias("purged"),
        F.min(F.when(kept, F.col("created_at"))).alias("oldest"),
    )


def expired_keys(keys: DataFrame, now: Column) -> DataFrame:
    return keys.filter(F.col("updated_at") < now - F.expr(f"INTERVAL {K.KEY_RETENTION_DAYS} DAYS"))


def with_days_left(keys: DataFrame, now: Column) -> DataFrame:
    return keys.withColumn("days_left", key_days_left(F.col("updated_at"), now))


def work_backlog(sheets: DataFrame, now: Column, n: int) -> DataFrame:
    """What may be picked up next: queued, or running without a sign of life; oldest first."""
    stale = F.col("claimed_at") < now - F.expr(f"INTERVAL {K.STALE_CLAIM_MINUTES} MINUTES")
    ready = (F.col("status") == "queued") | ((F.col("status") == "running") & stale)
    return sheets.filter(ready & (F.col("attempts") < K.MAX_ATTEMPTS)).orderBy("created_at", "sheet_id").limit(max(0, n))


def confirm_stamp(sheets: DataFrame, now: Column) -> DataFrame:
    """A sheet with a final verdict keeps or gets its stamp; without one the stamp is cleared."""
    stamp = F.when(F.col("final_verdict").isNotNull(), F.coalesce("confirmed_at", now))
    return sheets.withColumn("confirmed_at", stamp)


def status_violations(log: DataFrame) -> DataFrame:
    """Changes the rules forbid. ``log``: (sheet_id, changed_at, change_id, status).

    Cancelling is allowed from uploading, queued or running only; a cancelled sheet never turns
    into failed or graded. The previous status is found per day and carried over days, so a sheet
    with a very long history is not pulled into one task.
    """
    lagged = S.lag_within(log, ["sheet_id"], ["changed_at", "change_id"], F.to_date("changed_at"), "status", "previous")
    was, now = F.col("previous"), F.col("status")
    bad = ((now == "cancelled") & ~was.isin(*K.CANCELLABLE)) | ((was == "cancelled") & now.isin("failed", "graded"))
    return lagged.filter(F.coalesce(bad, F.lit(False))).select("sheet_id", "change_id", "previous", "status")


Rules = dict[str, Column]


def sheet_rules() -> Rules:
    return {
        "sheets.status": ~F.col("status").isin(*K.STATUSES),
        "sheets.verdict": ~F.col("verdict").isin(*K.VERDICTS),
        "sheets.final_verdict": ~F.col("final_verdict").isin(*K.VERDICTS),
    }


def page_rules() -> Rules:
    return {"pages.rotation": ~F.col("rotation").isin(*K.ROTATIONS)}


def item_rules() -> Rules:
    return {"items.direction": ~F.col("direction").isin(*K.DIRECTIONS)}


def usage_rules() -> Rules:
    return {"usage.kind": ~F.col("kind").isin(*K.USAGE_KINDS)}


def trial_rules() -> Rules:
    return {
        "trials.variant": ~F.col("variant").isin(*K.VARIANTS),
        "trials.edge": ~F.col("edge").isin(*K.EDGES),
        "trials.verdict": ~F.col("verdict").isin(*K.VERDICTS),
    }


def setting_rules() -> Rules:
    return {
        "settings.grading_model": ~F.col("grading_model").like("claude-%"),
        "settings.grading_effort": ~F.col("grading_effort").isin(*K.EFFORTS),
        "settings.work_hours": F.coalesce(F.json_array_length("work_hours"), F.lit(-1)) != 7,
    }


def staff_rules() -> Rules:
    return {"staff.role": ~F.col("role").isin(*K.ROLES)}


def dq_violations(checks: list[tuple[DataFrame, Rules]]) -> DataFrame:
    """(rule, violations) with one pass per table; NULL passes a rule."""
    parts = []
    for df, rules in checks:
        counted = df.agg(*[F.count_if(bad).alias(f"r{i}") for i, bad in enumerate(rules.values())])
        rows = [F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, name in enumerate(rules)]
        parts.append(counted.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def grading_setting_valid(settings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Known model of the grading provider with a known effort; anything else gives NULL model and effort.

    The catalog has one row per model; Spark broadcasts it when its measured size allows.
    """
    allowed = catalog.filter(F.col("provider") == K.GRADING_PROVIDER).select("model", F.lit(True).alias("_known"))
    joined = settings.join(allowed, "model", "left")
    ok = F.col("_known").isNotNull() & F.coalesce(F.col("effort").isin(*K.EFFORTS), F.lit(False))
    rest = [c for c in settings.columns if c not in ("model", "effort")]
    return joined.select(*rest, F.when(ok, F.col("model")).alias("model"), F.when(ok, F.col("effort")).alias("effort"))
