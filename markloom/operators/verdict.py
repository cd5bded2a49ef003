"""Sheet verdicts: one PASS/FAIL per answer sheet, held back when unread items could flip it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions import verdicts as V


def with_final(items: DataFrame) -> DataFrame:
    """Teacher override wins; overturned when it differs from the system."""
    t, s = F.col("teacher_correct"), F.col("correct")
    return items.withColumn("final_correct", V.final_correct(t, s)).withColumn("overturned", V.overturned(t, s))


def judge_results(items: DataFrame) -> DataFrame:
    """Stored items seen as results: final, else system, else wrong."""
    final = F.coalesce(V.final_correct(F.col("teacher_correct"), F.col("correct")), F.lit(False))
    return items.select("sheet_id", "no", final.alias("correct"), "expected", "note")


def item_tallies(items: DataFrame, wrong: Column, held_out: Column, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Per sheet: distinct judged numbers, distinct wrong numbers, rows read and rows held out.

    A number counts once; it is wrong when any of its rows is wrong. Both levels combine map-side,
    and the first one spreads a hot sheet over its numbers.
    """
    per_no = (
        items.groupBy(*keys, "no")
        .agg(
            F.count("*").alias("rows"),
            F.count_if(held_out).alias("held"),
            F.count_if(~held_out & wrong).alias("wrong_rows"),
        )
    )
    return per_no.groupBy(*keys).agg(
        F.count_if(F.col("rows") > F.col("held")).alias("n"),
        F.count_if(F.col("wrong_rows") > 0).alias("n_wrong"),
        F.sum("rows").alias("n_rows"),
        F.sum("held").alias("held_out"),
    )


def decide(df: DataFrame, boundary: int = K.BOUNDARY) -> DataFrame:
    """Add cut, verdicts, robustness, boundary flag and margin to n, n_wrong, missing, cut_text."""
    n, wrong, missing, cut = (F.col(c) for c in ("n", "n_wrong", "missing", "cut"))
    plain, worst = V.verdict(wrong, cut), V.verdict(wrong + missing, cut)
    robust = (missing == 0) | F.coalesce(plain == worst, F.lit(False))
    return (
        df.withColumn("cut", V.parse_cut(F.col("cut_text"), n + missing))
        .withColumn("worst_verdict", worst)
        .withColumn("robust", robust)
        .withColumn("verdict", F.when(robust, plain))
        .withColumn("near_boundary", robust & cut.isNotNull() & F.coalesce(F.abs(wrong - cut) <= boundary, F.lit(False)))
        .withColumn("margin", wrong - cut)
    )


def sheet_verdict(items: DataFrame, sheets: DataFrame, exclude_unjudged: bool = True, boundary: int = K.BOUNDARY) -> DataFrame:
    """Grading-time verdict from the system's own judgements.

    With ``exclude_unjudged`` items nobody could judge leave the wrong count and join the missing
    cells; quick grading, trials and model comparison keep them in.
    """
    held = V.is_unjudged(F.col("note")) if exclude_unjudged else F.lit(False)
    wrong = ~F.coalesce(F.col("correct"), F.lit(False))
    tallies = item_tallies(items, wrong, held)
    joined = tallies.join(sheets.select("sheet_id", "printed_total", F.col("cut_line").alias("cut_text")), "sheet_id")
    unread = V.missing_count(F.col("printed_total"), F.col("n_rows"))
    return decide(joined.withColumn("missing", unread + F.col("held_out")), boundary).select(
        "sheet_id", "n", "n_wrong", "missing", "cut", "verdict", "worst_verdict", "robust", "near_boundary", "margin"
    )


def recount_verdict(
    items: DataFrame, sheets: DataFrame, given_cut: str | None = None, boundary: int = K.BOUNDARY
) -> DataFrame:
    """Verdict after review: overrides counted, still-open items moved to missing.

    Cut text precedence: given, then stored on the sheet, then transcribed.
    """
    final = V.final_correct(F.col("teacher_correct"), F.col("correct"))
    tallies = item_tallies(items, ~F.coalesce(final, F.lit(False)), V.is_open(F.col("note"), final))
    cut_text = F.coalesce(F.lit(given_cut).cast("string"), F.col("cut_line"), F.col("transcript_cut"))
    joined = tallies.join(sheets.select("sheet_id", F.col("missing").alias("stored_missing"), cut_text.alias("cut_text")), "sheet_id")
    ready = joined.withColumn("missing", F.coalesce(F.col("stored_missing"), F.lit(0)) + F.col("held_out"))
    return decide(ready, boundary).select("sheet_id", "n", "n_wrong", "missing", "cut", "verdict", "robust", "near_boundary", "margin")


def split_unjudged(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(judged rows, unjudged rows per sheet)."""
    flag = V.is_unjudged(F.col("note"))
    counts = items.groupBy("sheet_id").agg(F.count_if(flag).alias("unjudged"), F.count_if(~flag).alias("judged"))
    return items.filter(~flag), counts


def review_stats(items: DataFrame) -> DataFrame:
    """Per sheet: wrong (open ones left out), open, overturned, reviewed."""
    rows = with_final(items)
    open_ = V.is_open(F.col("note"), F.col("final_correct"))
    return rows.groupBy("sheet_id").agg(
        F.count_if(~open_ & ~F.coalesce(F.col("final_correct"), F.lit(True))).alias("wrong"),
        F.count_if(open_).alias("open"),
        F.count_if("overturned").alias("overturned"),
        F.count("teacher_correct").alias("reviewed"),
    )


def overturn_rate(items: DataFrame, dims: list[str]) -> DataFrame:
    """How often teachers overturn the system, for every combination and total of the dimensions."""
    rows = with_final(items)
    agg = rows.cube(*dims).agg(F.count("teacher_correct").alias("reviewed"), F.count_if("overturned").alias("overturned"))
    return agg.withColumn("rate", F.try_divide(F.col("overturned").cast("double"), F.col("reviewed")))


def progress_summary(sheets: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per state, sheets that need a person, and cost."""
    status = F.col("status")
    review = V.needs_review(status, F.col("near_boundary"), F.col("verdict"), V.has_level(F.col("warnings"), "drift"))
    return sheets.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(status.isin("queued", "running")).alias("pending"),
        F.count_if(status == "graded").alias("graded"),
        F.count_if(status == "confirmed").alias("confirmed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(review).alias("needs_review"),
        F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("cost_usd"),
    )


def sheets_needing_review(sheets: DataFrame) -> DataFrame:
    drift = V.has_level(F.col("warnings"), "drift")
    return sheets.filter(V.needs_review(F.col("status"), F.col("near_boundary"), F.col("verdict"), drift))


def wrong_items(items: DataFrame, sheets: DataFrame, confirmed_only: bool = False) -> DataFrame:
    """Items whose final verdict is wrong, with the sheet they belong to."""
    rows = with_final(items).filter(~F.col("final_correct"))
    heads = sheets.filter(F.col("status") == "confirmed") if confirmed_only else sheets
    heads = heads.select("sheet_id", F.to_date("created_at").alias("received_on"), "class_name", "student_name", "title")
    return rows.join(heads, "sheet_id").select(
        "sheet_id", "received_on", "class_name", "student_name", "title", "seq", "no", "prompt", "written", "expected", "note", "overturned"
    )


def short_answer_suspects(items: DataFrame) -> DataFrame:
    from markloom.functions.text import too_short

    rows = with_final(items)
    return rows.filter(F.coalesce(F.col("final_correct"), F.lit(False)) & too_short(F.col("written"), F.col("expected")))
