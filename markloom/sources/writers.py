"""Writers: tables, redacted summaries and exam templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.functions import files as FF
from markloom.functions.clock import day_column

DAY_FILES = 8  # tasks that may share a day
PRIVATE = ("student", "student_name", "path", "before", "after", "crop", "received_by")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet; with partitions only the partitions present in ``df`` are replaced."""
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_by_day(df: DataFrame, path: str, moment: str = "created_at") -> None:
    """Parquet in one folder per day of ``moment``; days that ``df`` has are replaced, others stay.

    Rows are dealt by day and by a salt, so a busy day is several files and a quiet one is few.
    """
    salted = df.withColumn(day_column(moment), F.to_date(moment)).repartition(day_column(moment), F.pmod(F.xxhash64(moment), F.lit(DAY_FILES)))
    write_table(salted, path, [day_column(moment)])


def write_bucketed(df: DataFrame, table: str, key: str = "sheet_id", buckets: int = 200) -> None:
    """Managed table bucketed and sorted by key, so that joins and groupings on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def redacted(df: DataFrame) -> DataFrame:
    """Without names and file paths."""
    return df.drop(*[c for c in df.columns if c in PRIVATE])


def write_summary_report(df: DataFrame, path: str) -> None:
    """Markdown table rows of the redacted columns, one text line per row."""
    safe = redacted(df)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("–")) for c in safe.columns]
    safe.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.mode("overwrite").text(path)


def exam_templates(answers: DataFrame, exams: DataFrame, pages: DataFrame) -> DataFrame:
    """One nested document per exam.

    ``answers``: (exam_id, number, page, answer, x, y, w, h); ``exams``: (exam_id, level, chapter, file, method);
    ``pages``: (exam_id, page, width, height).
    """
    box = F.struct("x", "y", "w", "h").alias("bbox")
    region = F.array(F.struct(F.lit("blank").alias("label"), F.lit("handwriting").alias("kind"), box)).alias("regions")
    empty = F.array().cast("array<string>").alias("accepted")
    match = F.struct(F.lit(True).alias("ignore_space"), F.lit(0).alias("allow_typo_distance")).alias("match_options")
    key = F.struct(F.col("answer").alias("canonical"), empty, match).alias("key")
    question = F.struct(
        F.col("number").alias("_n"), F.col("number").cast("string").alias("number"), F.lit("short_answer").alias("type"),
        F.lit(1).alias("points"), F.col("page").alias("page_no"), F.lit("question").alias("grading_unit"), region, key,
    )
    listed = answers.select("exam_id", question.alias("_q")).groupBy("exam_id").agg(F.sort_array(F.collect_list("_q")).alias("_qs"))
    questions = F.transform("_qs", lambda q: q.dropFields("_n")).alias("questions")
    size = F.struct(F.col("page").alias("page_no"), F.col("width").alias("width_pt"), F.col("height").alias("height_pt"))
    sizes = pages.groupBy("exam_id").agg(F.sort_array(F.collect_list(size)).alias("pages"))
    head = exams.select(
        "exam_id", FF.chapter_code(F.col("level"), F.col("chapter")).alias("code"), FF.chapter_title(F.col("file")).alias("name"),
        F.lit(1).alias("version"), F.lit("fixed_set").alias("class"), F.col("file").alias("source_pdf"), F.struct("method").alias("extraction"),
    )
    return head.join(listed, "exam_id").join(sizes, "exam_id", "left").select(*head.columns, "pages", questions)


def write_exam_templates(templates: DataFrame, path: str) -> None:
    """One JSON document per line."""
    templates.write.mode("overwrite").json(path)
