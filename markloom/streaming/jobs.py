"""Streaming reports.

Every job keeps its state and results under the shared folder of the session, writes each
micro-batch to its own sub-folder (a retried batch overwrites itself) and hands back what was
written, so that a lost executor or a restarted driver leaves results whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions.clock import kst_hour
from markloom.operators.sequences import first_rows
from markloom.operators.usage import with_off_hours
from markloom.session import scratch_path


def _drain(stream: DataFrame, out: str, state: str, mode: str) -> None:
    """Process everything available now; each micro-batch replaces its own folder only."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()


def _latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest version of every updated group."""
    return first_rows(spark.read.parquet(out), keys, [F.col("batch").desc()]).drop("batch")


def hourly_usage(events: DataFrame, hours: DataFrame, late: str | None = None) -> DataFrame:
    """Streaming counts per clock hour: (window, total, off). ``events`` needs a TIMESTAMP created_at.

    State is one row per clock hour, so by default nothing is ever too late; ``late`` sets a
    watermark that frees old hours and drops what arrives after it.
    """
    flagged = with_off_hours(events.withWatermark("created_at", late) if late else events, hours)
    return flagged.groupBy(F.window("created_at", "1 hour")).agg(F.count("*").alias("total"), F.count_if("off_hours").alias("off"))


def stream_usage_by_hour(
    spark: SparkSession, events: DataFrame, hours: DataFrame, out: str | None = None, late: str | None = None
) -> DataFrame:
    """Drain the stream and fold the clock hours into 24 KST bins."""
    out = out or scratch_path(spark, "usage-hours")
    _drain(hourly_usage(events, hours, late), f"{out}/data", f"{out}/state", "update")
    slots = _latest(spark, f"{out}/data", ["window"]).withColumn("hour", kst_hour(F.col("window.start")))
    bins = slots.groupBy("hour").agg(F.sum("total").alias("total"), F.sum("off").alias("off"))
    day = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return day.join(bins, "hour", "left").na.fill(0, ["total", "off"])


def first_refs(refs: DataFrame, late: str | None = None) -> DataFrame:
    """The first arrival of every fingerprint.

    The state holds one row per fingerprint for ever; ``late`` (needs a TIMESTAMP created_at) frees a
    fingerprint so long after its first arrival, from when on a repeat counts as new.
    """
    if late is None:
        return refs.dropDuplicates(["fingerprint"])
    return refs.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["fingerprint"])


def stream_first_ref_wins(spark: SparkSession, refs: DataFrame, out: str | None = None, late: str | None = None) -> DataFrame:
    """Append the first arrival of every fingerprint; later ones are dropped by the stream's state."""
    out = out or scratch_path(spark, "refs")
    _drain(first_refs(refs, late), f"{out}/data", f"{out}/state", "append")
    return spark.read.parquet(f"{out}/data").drop("batch")


CONTROL = ("uploading", "queued", "running", "cancelled")


def latest_status(changes: DataFrame) -> DataFrame:
    """Per sheet: the state a screen shows, and how many changes arrived.

    A cancelled sheet ignores results until it is queued again, yet every change is counted. Both
    facts are plain aggregates over (changed_at, change_id), so state is one row per sheet.
    """
    order = F.struct("changed_at", "change_id")
    control = F.col("status").isin(*CONTROL)
    grouped = changes.groupBy("sheet_id").agg(
        F.max_by("status", order).alias("_last"),
        F.max_by(F.when(control, F.col("status")), F.when(control, order)).alias("_control"),
        F.count("*").alias("changes"),
    )
    shown = F.when(F.col("_control") == "cancelled", F.lit("cancelled")).otherwise(F.col("_last"))
    return grouped.select("sheet_id", shown.alias("status"), "changes")


def stream_latest_status(spark: SparkSession, changes: DataFrame, out: str | None = None) -> DataFrame:
    """Drain the change log and count sheets per shown status."""
    out = out or scratch_path(spark, "status")
    _drain(latest_status(changes), f"{out}/data", f"{out}/state", "update")
    sheets = _latest(spark, f"{out}/data", ["sheet_id"])
    return sheets.filter(F.col("status").isin(*K.STATUSES)).groupBy("status").agg(
        F.count("*").alias("sheets"), F.sum("changes").alias("changes")
    )
