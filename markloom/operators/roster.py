"""Retest rosters, wrong-answer lists and the report of items nobody could judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions import verdicts as V
from markloom.functions.text import filled, text_or_empty, told
from markloom.operators import sequences as S
from markloom.operators.verdict import with_final


def bucket_of(status: Column, final: Column) -> Column:
    """retest / passed / pending; cancelled sheets belong to none."""
    return F.when(
        status != "cancelled",
        F.when((status == "confirmed") & final.isin(*K.VERDICTS), F.when(final == "fail", "retest").otherwise("passed")).otherwise("pending"),
    )


def split_roster(sheets: DataFrame) -> DataFrame:
    return sheets.withColumn("bucket", bucket_of(F.col("status"), F.col("final_verdict"))).filter("bucket is not null")


def class_label(c: Column) -> Column:
    return F.coalesce(filled(c), F.lit(K.NO_CLASS))


def class_order(sheets: DataFrame) -> DataFrame:
    """Distinct class labels with their sheet count in Korean collation order."""
    return sheets.groupBy(class_label(F.col("class_name")).alias("class_name")).agg(F.count("*").alias("sheets")).orderBy(
        F.collate(F.col("class_name"), "ko")
    )


def retest_roster(sheets: DataFrame) -> DataFrame:
    """Confirmed fails by class and name."""
    failed = sheets.filter((F.col("status") == "confirmed") & (F.col("final_verdict") == "fail"))
    return failed.select("sheet_id", F.to_date("created_at").alias("received_on"), "class_name", "student_name", "title", "confirmed_at").orderBy(
        "class_name", "student_name", "sheet_id"
    )


def render_retest_text(sheets: DataFrame, heading: str = "") -> DataFrame:
    """The pasteable retest list of every day as ordered lines (received_on, block, class_name, part, text).

    Blocks: 0 heading, 1 the names of a class, 2 'none', 3 footer. Names beyond one line's width go on in
    further parts.
    """
    days = split_roster(sheets).withColumn("received_on", F.to_date("created_at"))
    counts = days.groupBy("received_on").agg(
        F.count_if(F.col("bucket") == "retest").alias("retest"), F.count_if(F.col("bucket") == "pending").alias("pending")
    )
    title = told(K.ROSTER_HEAD, F.lit(heading), F.date_format("received_on", "yyyy-MM-dd"), F.col("retest"))
    footer = told(K.ROSTER_FOOT, F.col("pending"))
    rows = days.filter("bucket = 'retest'").select(
        "received_on", class_label(F.col("class_name")).alias("class_name"), "sheet_id",
        F.coalesce(filled(F.col("student_name")), F.lit(K.NO_NAME)).alias("name"),
    )
    names = S.fold_text(rows, ["received_on", "class_name"], F.col("name"), ["name", "sheet_id"], "text", hot=True)

    def line(df: DataFrame, block: int, text: Column) -> DataFrame:
        return df.select("received_on", F.lit(block).alias("block"), F.lit("").alias("class_name"), F.lit(0).cast("bigint").alias("part"), text.alias("text"))

    return (
        line(counts, 0, title)
        .unionByName(names.select("received_on", F.lit(1).alias("block"), "class_name", "part", "text"))
        .unionByName(line(counts.filter("retest = 0"), 2, F.lit(K.NONE_TEXT)))
        .unionByName(line(counts.filter("pending > 0"), 3, footer))
    )


def render_wrong_text(wrong: DataFrame, sheets: DataFrame, heading: str = "") -> DataFrame:
    """Wrong-answer list of every day as lines (received_on, sheet_id, seq, text).

    The day's heading has sheet_id NULL and seq -2, a sheet's heading has seq -1; item lines follow by seq.
    A day of ``sheets`` without wrong items says so (sheet_id NULL, seq 0).
    """
    name = F.when(text_or_empty(F.col("student_name")) == "", F.lit(K.NO_NAME)).otherwise(F.col("student_name"))
    heads = wrong.groupBy("received_on", "sheet_id").agg(
        F.first("student_name").alias("student_name"), F.first("title").alias("title"), F.count("*").alias("n")
    )
    titled = F.when(text_or_empty(F.col("title")) != "", F.concat(F.lit(" — "), "title")).otherwise("")
    head_text = F.concat(name, titled, F.lit(" ("), F.col("n").cast("string"), F.lit("개)"))
    written = F.coalesce(filled(F.col("written")), F.lit(f"({K.NOTE_BLANK})"))
    answer = F.when(text_or_empty(F.col("expected")) != "", F.concat(F.lit(" (정답: "), "expected", F.lit(")"))).otherwise("")
    item_text = F.concat(F.lit("  "), "no", F.lit(". "), "prompt", F.lit(" → "), written, answer)
    days = sheets.select(F.to_date("created_at").alias("received_on")).distinct()
    calm = days.join(wrong.select("received_on").distinct(), "received_on", "left_anti")
    day_text = told(K.WRONG_HEAD, F.lit(heading), F.date_format("received_on", "yyyy-MM-dd"))
    none = F.lit(None).cast("bigint")
    return (
        days.select("received_on", none.alias("sheet_id"), F.lit(-2).cast("bigint").alias("seq"), day_text.alias("text"))
        .unionByName(calm.select("received_on", none.alias("sheet_id"), F.lit(0).cast("bigint").alias("seq"), F.lit(K.NONE_TEXT).alias("text")))
        .unionByName(heads.select("received_on", "sheet_id", F.lit(-1).cast("bigint").alias("seq"), head_text.alias("text")))
        .unionByName(wrong.select("received_on", "sheet_id", F.col("seq").cast("bigint").alias("seq"), item_text.alias("text")))
    )


def exam_label(title: Column) -> Column:
    return F.coalesce(filled(title), F.lit(K.NO_TITLE))


def unjudged_by_exam(items: DataFrame, sheets: DataFrame) -> DataFrame:
    """Titles with unjudged items: sheets, items, open-unjudged and rate. Rolled up per sheet first, so titles may be skewed."""
    rows = with_final(items)
    open_ = V.is_open(F.col("note"), F.col("final_correct"))
    per_sheet = rows.groupBy("sheet_id").agg(F.count("*").alias("items"), F.count_if(open_).alias("unjudged"))
    titled = per_sheet.join(sheets.select("sheet_id", exam_label(F.col("title")).alias("title")), "sheet_id")
    per_title = titled.groupBy("title").agg(
        F.count("*").alias("sheets"), F.sum("items").alias("items"), F.sum("unjudged").alias("unjudged")
    )
    return per_title.filter("unjudged > 0").withColumn("rate", F.col("unjudged").cast("double") / F.col("items"))


def unjudged_totals(items: DataFrame, sheets: DataFrame) -> DataFrame:
    """Grand total over every item of the given sheets."""
    rows = with_final(items).join(sheets.select("sheet_id"), "sheet_id", "left_semi")
    agg = rows.agg(F.count("*").alias("items"), F.count_if(V.is_open(F.col("note"), F.col("final_correct"))).alias("unjudged"))
    return agg.withColumn("rate", F.coalesce(F.try_divide(F.col("unjudged").cast("double"), F.col("items")), F.lit(0.0)))


def unjudged_samples(items: DataFrame, sheets: DataFrame, k: int = K.SAMPLES_PER_EXAM) -> DataFrame:
    """First k open items of every title by sheet and position."""
    open_rows = with_final(items).filter(V.is_open(F.col("note"), F.col("final_correct")))
    titled = open_rows.join(sheets.select("sheet_id", exam_label(F.col("title")).alias("title")), "sheet_id")
    top = S.first_rows(titled, ["title"], [F.col("sheet_id"), F.col("seq")], k, rank="place")
    return top.select("title", "place", "no", "prompt", "written")


def sample_rows(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return S.first_rows(df, keys, order, k, rank="place")


def student_sheets(sheets: DataFrame, name: str) -> DataFrame:
    """Every sheet of exactly this student, newest first; a blank name finds nothing."""
    wanted = name.strip()
    found = sheets.filter(F.col("student_name") == wanted) if wanted else sheets.limit(0)
    return found.orderBy(F.col("created_at").desc(), F.col("sheet_id").desc())


def withdraw_student(name: str, sheets: DataFrame, photos: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without one student's sheets, photos and items."""
    wanted = name.strip()
    gone = sheets.filter((F.col("student_name") == wanted) & F.lit(bool(wanted))).select("sheet_id")
    return tuple(df.join(gone, "sheet_id", "left_anti") for df in (sheets, photos, items))  # type: ignore[return-value]
