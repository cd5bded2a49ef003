"""From page transcripts and judgements to verdicts, for every sheet at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.operators import drift, pages, reference, verdict
from markloom.session import written


@dataclass(frozen=True)
class Graded:
    """Everything one grading pass leaves behind."""

    items: DataFrame
    verdicts: DataFrame
    sheets: DataFrame

    @cached_property
    def warnings(self) -> DataFrame:
        """Checked when asked for: the checks store their numbering."""
        return drift.drift_warnings(self.items, self.sheets)


def explode_transcripts(transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page headers, item rows with page and pos) of a nested transcripts table."""
    headers = transcripts.drop("items")
    rows = transcripts.select("sheet_id", "page", F.posexplode("items").alias("pos", "_i")).select("sheet_id", "page", "pos", "_i.*")
    return headers, rows


def grade(headers: DataFrame, page_items: DataFrame, judgements: DataFrame) -> Graded:
    """Merge pages, attach judgements, check for drift and decide.

    ``headers``: (sheet_id, page, title, teacher, student, cut_line, printed_total);
    ``page_items``: (sheet_id, page, pos, no, prompt, direction, prefix, written, blank, legible, confidence);
    ``judgements``: (sheet_id, no, pos, correct, expected, note).
    """
    sheets = pages.merge_headers(headers).withColumnRenamed("n_parts", "page_count")
    merged = pages.merge_items(page_items, headers.select("sheet_id", "page"))
    merged = place_items(merged)
    items = written(reference.items_from_transcript(merged, judgements), "graded-items")
    return Graded(items, verdict.sheet_verdict(items, sheets), sheets)


def place_items(merged: DataFrame) -> DataFrame:
    """Give merged items their seq: number order over several pages, the given order on a single one.

    The order is the same columns for both, so one ordered pass serves all sheets.
    """
    from markloom.operators import sequences as S

    many = F.col("n_parts") > 1
    first = F.when(many, F.col("num_key")).otherwise(F.col("pos").cast("bigint"))
    keyed = merged.withColumn("_first", first).withColumn("_second", F.when(many, F.col("no")).otherwise(F.lit("")))
    return S.ranked_position(keyed, ["sheet_id"], ["_first", "_second"], "seq").drop("_first", "_second", "num_key", "n_parts", "page", "pos")
