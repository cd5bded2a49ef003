"""Our wrong answers against the teacher's pen marks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions import verdicts as V
from markloom.functions.text import filled
from markloom.operators import sequences as S
from markloom.operators.verdict import decide


def mark_items(results: DataFrame, marks: DataFrame) -> DataFrame:
    """Per number: on the sheet, wrong for us, marked by the teacher. Marks naming no item stay apart."""
    no = F.lit(False)
    wrong = ~F.coalesce(F.col("correct"), no)
    ours = results.select("sheet_id", "no", F.lit(True).alias("known"), wrong.alias("ours"), no.alias("theirs"))
    theirs = marks.select("sheet_id", filled(F.col("mark_no")).alias("no"), no.alias("known"), no.alias("ours"), F.lit(True).alias("theirs")).filter("no is not null")
    # rows without a sheet never match
    both = S.spread(ours.unionByName(theirs), "sheet_id", "no").withColumn("_side", F.when(F.col("sheet_id").isNull(), F.col("known")))
    return both.groupBy("sheet_id", "no", "_side").agg(*[F.bool_or(c).alias(c) for c in ("known", "ours", "theirs")]).drop("_side")


def unmatched_marks(results: DataFrame, marks: DataFrame) -> DataFrame:
    named = marks.select("sheet_id", filled(F.col("mark_no")).alias("no")).filter("no is not null").distinct()
    return named.join(results.select("sheet_id", "no").distinct(), ["sheet_id", "no"], "left_anti")


def symmetric_difference(results: DataFrame, marks: DataFrame) -> DataFrame:
    """Numbers wrong for exactly one side."""
    pairs = mark_items(results, marks)
    side = F.when(F.col("ours"), "ours").otherwise("theirs")
    return pairs.filter(F.col("known") & (F.col("ours") != F.col("theirs"))).select("sheet_id", "no", side.alias("side"))


def teacher_mark_compare(results: DataFrame, marks: DataFrame, sheets: DataFrame) -> DataFrame:
    """Per sheet: agreement counts and both verdicts.

    ``sheets``: (sheet_id, cut_text, missing, pass_fail). A PASS/FAIL written by the teacher beats
    the one counted from marks; neither is given while unread cells could flip ours.
    """
    known, ours, theirs = F.col("known"), F.col("ours"), F.col("theirs")
    tallies = mark_items(results, marks).groupBy("sheet_id").agg(
        F.count_if(known).alias("n"),
        F.count_if(ours).alias("n_wrong"),
        F.count_if(known & theirs).alias("n_marked"),
        F.count_if(ours & ~theirs).alias("ours_only"),
        F.count_if(known & theirs & ~ours).alias("theirs_only"),
        F.count_if(~known).alias("unmatched"),
    )
    judged = decide(tallies.join(sheets, "sheet_id"))
    written = F.when(F.col("pass_fail").isin(*K.VERDICTS), F.col("pass_fail"))
    teacher = F.when(F.col("robust"), F.coalesce(written, V.verdict(F.col("n_marked"), F.col("cut"))))
    return (
        judged.withColumn("teacher_verdict", teacher)
        .withColumn("verdict_match", F.col("verdict") == F.col("teacher_verdict"))
        .withColumn("agree", F.col("n") - F.col("ours_only") - F.col("theirs_only"))
        .select("sheet_id", "n", "n_wrong", "n_marked", "ours_only", "theirs_only", "unmatched", "agree", "missing", "cut",
                "verdict", "teacher_verdict", "verdict_match", "near_boundary", "margin")
    )


def agreement_totals(compared: DataFrame) -> DataFrame:
    """One row. ``compared``: teacher_mark_compare plus has_drift, cost_usd and error.

    Sheets with unmatched marks leave every total, failed runs too; ``runs`` counts all of them.
    """
    ran = F.col("error").isNull()
    used = ran & (F.coalesce(F.col("unmatched"), F.lit(0)) == 0)
    total = lambda c: F.coalesce(F.sum(F.when(used, F.col(c))), F.lit(0)).alias(c)
    return compared.agg(
        F.count("*").alias("runs"),
        F.count_if(ran & (F.col("unmatched") > 0)).alias("excluded"),
        total("n"), total("agree"), total("theirs_only"), total("ours_only"),
        F.count_if(used & F.col("has_drift")).alias("drifted"),
        F.count_if(used & F.col("verdict_match").isNotNull()).alias("verdicts"),
        F.count_if(used & F.col("verdict_match")).alias("verdicts_matched"),
        F.count_if(used & F.col("near_boundary")).alias("near"),
        F.coalesce(F.sum(F.when(ran, F.col("cost_usd"))), F.lit(0)).alias("cost_usd"),
    )


def phase_gate(totals: DataFrame) -> DataFrame:
    """The four acceptance thresholds as rows (criterion, value, ok)."""
    d = lambda c: F.col(c).cast("double")
    rate = F.try_divide(d("verdicts_matched"), d("verdicts"))
    near, missed = F.try_divide(d("near"), d("runs")), F.try_divide(d("theirs_only"), d("n"))
    rows = [
        ("verdict_match", rate, F.coalesce(rate >= K.GATE_VERDICT, F.lit(False))),
        ("review_rate", near, d("near") <= d("runs") * K.GATE_REVIEW),
        ("missed_wrong", missed, F.coalesce(missed <= K.GATE_MISSED, F.lit(False))),
        ("drift_sheets", d("drifted"), d("drifted") == 0),
    ]
    listed = F.array(*[F.struct(F.lit(c).alias("criterion"), v.alias("value"), ok.alias("ok")) for c, v, ok in rows])
    return totals.filter(F.col("n") > 0).select(F.inline(listed))


def small_sheet_note(compared: DataFrame) -> DataFrame:
    """Sheets so short that one miss moves the rate by ``points``."""
    small = compared.filter((F.col("n") < K.SMALL_SHEET_ITEMS) & (F.col("unmatched") == 0) & (F.col("n") > 0))
    return small.select("sheet_id", "n", (F.lit(100.0) / F.col("n")).alias("points"))


def rubric_regression(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Expected against actual verdict per case and mode; a case without expectation always passes.

    ``cases``: (case_no, want_lax, want_strict); ``results``: (case_no, strict, correct).
    """
    modes = [
        cases.select("case_no", F.lit(strict).alias("strict"), F.col(col).alias("want"))
        for strict, col in ((False, "want_lax"), (True, "want_strict"))
    ]
    wanted = reduce(DataFrame.unionByName, modes)
    joined = wanted.join(results, ["case_no", "strict"], "left")
    ok = F.col("want").isNull() | F.coalesce(F.col("want") == F.col("correct"), F.lit(False))
    return joined.select("case_no", "strict", "want", F.col("correct").alias("actual"), ok.alias("ok"))


def reading_preservation(truth: DataFrame, readings: DataFrame) -> DataFrame:
    """Kept and total per reading strategy; a number missing from a run counts as not kept.

    ``truth``: (sheet_id, no, truth); ``readings``: (sheet_id, strategy, run, no, written).
    """
    from markloom.functions.text import norm

    runs = readings.select("sheet_id", "strategy", "run").distinct()
    wanted = runs.join(truth.select("sheet_id", "no", norm(F.col("truth")).alias("_want")), "sheet_id")
    got = readings.groupBy("sheet_id", "strategy", "run", "no").agg(F.max_by("written", "seq").alias("_raw"))
    got = got.withColumn("_got", norm(F.col("_raw")))
    joined = wanted.join(got, ["sheet_id", "strategy", "run", "no"], "left")
    kept = F.coalesce(F.col("_got") == F.col("_want"), F.lit(False))
    return joined.groupBy("strategy").agg(F.count_if(kept).alias("kept"), F.count("*").alias("total"))
