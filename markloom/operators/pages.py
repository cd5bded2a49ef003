"""Several page transcripts of one sheet become one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions.text import filled, num_key, text_or_empty, trimmed
from markloom.operators import sequences as S


def natural_order(df: DataFrame, keys: list[str], no: str = "no", out: str = "ord") -> DataFrame:
    """One-based place of each number: numerically first, then by its text."""
    keyed = df.withColumn("num_key", num_key(F.col(no)))
    placed = S.ranked_position(keyed, keys, ["num_key", no], out)
    return placed.withColumn(out, F.col(out) + 1)


def reading_score() -> Column:
    """How completely a cell was read: written in, legible, not empty."""
    blank = F.coalesce(F.col("blank"), F.lit(False))
    legible = F.coalesce(F.col("legible"), F.lit(False))
    return (~blank).cast("int") + legible.cast("int") + (trimmed(F.col("written")) != "").cast("int")


def merge_items(items: DataFrame, parts: DataFrame) -> DataFrame:
    """Best reading of every number over a sheet's pages.

    ``items``: (sheet_id, page, pos, no, written, blank, legible, confidence, ...);
    ``parts``: (sheet_id, page). A sheet with a single page keeps its items untouched.
    """
    counts = parts.groupBy("sheet_id").agg(F.count("*").alias("_parts"))
    sized = items.join(counts, "sheet_id")
    single = sized.filter("_parts = 1")
    rank = [reading_score().desc(), F.coalesce("confidence", F.lit(0.0)).desc(), F.col("page"), F.col("pos")]
    best = S.first_rows(sized.filter("_parts > 1"), ["sheet_id", "no"], rank)
    merged = single.unionByName(best).withColumn("n_parts", F.col("_parts")).drop("_parts")
    return merged.withColumn("num_key", num_key(F.col("no")))


def merge_headers(parts: DataFrame) -> DataFrame:
    """First filled value of each header field by page; the largest printed total."""
    fields = [c for c in ("title", "teacher", "student", "cut_line") if c in parts.columns]
    multi = F.count("*") > 1

    def first_filled(name: str) -> Column:
        value = filled(F.col(name))
        merged = text_or_empty(F.min_by(value, F.when(value.isNotNull(), F.col("page"))))
        return F.when(multi, merged).otherwise(F.first(name)).alias(name)

    return parts.groupBy("sheet_id").agg(
        *[first_filled(c) for c in fields],
        F.greatest(F.max(F.coalesce("printed_total", F.lit(0))), F.lit(0)).alias("printed_total"),
        F.count("*").alias("n_parts"),
    )


def merge_bands(items: DataFrame) -> DataFrame:
    """Overlapping bands of one page: the more confident reading per number, earlier band on ties, in number order (``ord``)."""
    rank = [F.col("confidence").desc(), F.col("band"), F.col("pos")]
    best = S.first_rows(items, ["sheet_id", "no"], rank)
    # numbers without digits share one order bucket a sheet, the others are split by their number
    return natural_order(best, ["sheet_id"]).drop("num_key")


def band_headers(headers: DataFrame) -> DataFrame:
    """The header of the first band speaks for its sheet. ``headers``: (sheet_id, band, ...)."""
    return S.first_rows(headers, ["sheet_id"], [F.col("band")]).drop("band")


def last_number(items: DataFrame) -> DataFrame:
    key = num_key(F.col("no"))
    return items.groupBy("sheet_id").agg(F.coalesce(F.max(F.when(key < K.NO_NUMBER, key)), F.lit(0)).alias("last_no"))
