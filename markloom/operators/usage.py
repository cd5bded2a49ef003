"""Who used the service, when, and what it cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions.clock import kst_day, kst_hour
from markloom.operators.sequences import first_rows

HOURS_SCHEMA = "array<struct<start:double,end:double>>"


def hours_table(spark: SparkSession, rows=K.DEFAULT_HOURS) -> DataFrame:
    """(dow, start, end), at most seven rows; a weekday without a row is a day off."""
    return spark.createDataFrame([(d, float(a), float(b)) for d, a, b in rows], "dow int, start double, end double")


def normalize_hours(df: DataFrame, column: str = "work_hours") -> DataFrame:
    """Parse the seven-slot JSON array; anything malformed gives NULL, never a default."""
    slots = F.from_json(column, HOURS_SCHEMA)
    # the raw text tells an empty slot (null) from one whose numbers could not be read
    raw = F.from_json(column, "array<string>")
    wide = df.withColumn("_slots", slots).withColumn("_raw", raw)
    pairs = F.arrays_zip("_slots", "_raw")

    def ok(p: Column) -> Column:
        s, e = p["_slots"]["start"], p["_slots"]["end"]
        return p["_raw"].isNull() | F.coalesce((s >= 0) & (e <= 24) & (s < e), F.lit(False))

    good = (F.size("_raw") == 7) & (F.size("_slots") == 7) & F.forall(pairs, ok)
    return wide.withColumn("hours", F.when(good, F.col("_slots"))).drop("_slots", "_raw")


def hours_rows(normalized: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dow, start, end) from the normalised array; days off give no row."""
    exploded = normalized.select(*keys, F.posexplode("hours").alias("dow", "slot"))
    return exploded.filter("slot is not null").select(*keys, "dow", F.col("slot.start").alias("start"), F.col("slot.end").alias("end"))


def with_off_hours(events: DataFrame, hours: DataFrame) -> DataFrame:
    """Add KST dow, hour and off_hours. The hours table has at most seven rows, so it is broadcast."""
    week = hours.groupBy("dow").agg(F.min("start").alias("_start"), F.max("end").alias("_end"))
    timed = events.withColumn("dow", kst_day(F.col("created_at"))).withColumn("hour", kst_hour(F.col("created_at")))
    joined = timed.join(F.broadcast(week), "dow", "left")
    off = F.col("_start").isNull() | (F.col("hour") < F.col("_start")) | (F.col("hour") >= F.col("_end"))
    return joined.withColumn("off_hours", off).drop("_start", "_end")


def usage_by_staff(events: DataFrame, hours: DataFrame) -> DataFrame:
    """One row per person, unknown people kept as NULL."""
    off, cost, kind = F.col("off_hours"), F.coalesce(F.col("cost_usd"), F.lit(0)), F.col("kind")
    return with_off_hours(events, hours).groupBy("staff_id").agg(
        F.count("*").alias("events"),
        F.sum("pages").alias("pages"),
        F.sum(cost).alias("cost_usd"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(off).alias("off_hours"),
        F.coalesce(F.sum(F.when(off, cost)), F.lit(0)).alias("off_hours_cost"),
        *[F.count_if(kind == k).alias(f"n_{k}") for k in K.USAGE_KINDS],
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
    )


def usage_totals(by_staff: DataFrame) -> DataFrame:
    cols = ("events", "pages", "cost_usd", "off_hours", "off_hours_cost")
    return by_staff.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols])


def usage_by_hour(events: DataFrame, hours: DataFrame) -> DataFrame:
    """24 KST bins, empty ones included."""
    bins = with_off_hours(events, hours).groupBy("hour").agg(F.count("*").alias("total"), F.count_if("off_hours").alias("off"))
    day = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return day.join(bins, "hour", "left").na.fill(0, ["total", "off"])


def off_hours_events(events: DataFrame, hours: DataFrame) -> DataFrame:
    return with_off_hours(events, hours).filter("off_hours")


def recent_off_hours(events: DataFrame, hours: DataFrame, n: int = 20) -> DataFrame:
    return off_hours_events(events, hours).orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(n)


def describe_hours(hours: DataFrame, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """Weekdays with equal hours on one line, groups in order of their first day.

    Keys of ``known`` without any working day get a fixed text.
    """
    names = F.array(*[F.lit(d) for d in K.DAY_NAMES])
    same = hours.groupBy(*keys, "start", "end").agg(F.sort_array(F.collect_set("dow")).alias("_days"))
    days = F.array_join(F.transform("_days", lambda d: F.get(names, d)), "·")
    whole = lambda c: F.when(F.col(c) == F.floor(c), F.lpad(F.floor(c).cast("string"), 2, "0")).otherwise(F.col(c).cast("string"))
    clock = lambda c: F.concat(whole(c), F.lit(":00"))
    line = F.concat(days, F.lit(" "), clock("start"), F.lit("~"), clock("end"))
    lines = same.select(*keys, F.struct(F.get("_days", F.lit(0)).alias("first"), line.alias("line")).alias("_g"))
    # at most seven groups per key: one per weekday
    folded = lines.groupBy(*keys).agg(F.sort_array(F.collect_list("_g")).alias("_all"))
    told = folded.select(*keys, F.array_join(F.transform("_all", lambda g: g["line"]), " · ").alias("_told"))
    if known is None:
        return told.withColumnRenamed("_told", "text")
    return known.select(*keys).join(told, keys, "left").select(*keys, F.coalesce("_told", F.lit(K.NO_WORKDAYS)).alias("text"))


def staff_names(events: DataFrame, staff: DataFrame, unknown: str = "(지워진 직원)") -> DataFrame:
    """Label usage rows; rows of deleted or unknown people stay."""
    named = staff.select("staff_id", F.col("name").alias("staff_name"))
    return events.join(named, "staff_id", "left").withColumn("staff_name", F.coalesce("staff_name", F.lit(unknown)))


def staff_order(staff: DataFrame) -> DataFrame:
    return staff.orderBy(F.col("active").desc(), "name", "staff_id")


def recent_values(entries: DataFrame, k: int = K.RECENT_VALUES) -> DataFrame:
    """Newest k distinct values per user, compared without case and outer space. ``entries``: (user_id, value, used_at, entry_id)."""
    from markloom.functions.text import trimmed

    clean = entries.withColumn("value", trimmed(F.col("value"))).filter("value <> ''")
    order = F.struct("used_at", "entry_id")
    latest = clean.groupBy("user_id", F.lower("value").alias("_key")).agg(
        F.max_by("value", order).alias("value"), F.max(order).alias("_at")
    )
    return first_rows(latest, ["user_id"], [F.col("_at").desc()], k, rank="place").select("user_id", "place", "value")
