"""Readers for tables, run files, label manifests and compact model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom import schemas


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A whole table; there is no row limit and no paging."""
    return spark.read.parquet(path)


def read_run_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(finished runs, failed runs) from JSON files as they are written: indented, one run or a list each.

    A run without its number takes it from the file's name; a file that can't be read is a failed run.
    """
    schema = f"{schemas.RUN}, unread STRING"
    runs = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "unread").json(path)
    file = F.input_file_name()
    number = F.nullif(F.regexp_extract(file, r"([0-9]+)[^/0-9]*$", 1), F.lit("")).try_cast("bigint")
    broken = F.when(F.col("unread").isNotNull(), F.concat(F.lit("unreadable: "), F.substring_index(file, "/", -1)))
    named = runs.withColumn("pair_no", F.coalesce("pair_no", number)).withColumn("error", F.coalesce("error", broken)).drop("unread")
    return named.filter("error is null").drop("error"), named.filter("error is not null").select("pair_no", "error")


def read_label_manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as text; a byte-order mark and missing label columns are tolerated."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    for name in ("truth", "grade", "truth_source"):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(""))
    return raw


def expand_short_items(compact: Column) -> Column:
    """Compact item JSON to full field names; absent fields stay absent (NULL), confidence is not carried."""
    rows = F.from_json(compact, schemas.SHORT_ITEMS)
    names = {"no": "n", "prompt": "p", "direction": "d", "prefix": "x", "written": "w", "blank": "b", "legible": "l", "erased": "e"}
    return F.transform(rows, lambda r: F.struct(*[r[short].alias(full) for full, short in names.items()]))



def pick_items(items: DataFrame, numbers: list[str] | None = None, with_prefix: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """Items of runs by number, by printed first letters, or by disagreement; names never come along."""
    picked = items.drop("student", "student_name")
    if numbers is not None:
        picked = picked.filter(F.trim("no").isin([n.strip() for n in numbers if n.strip()]))
    if with_prefix:
        picked = picked.filter(F.trim(F.coalesce("prefix", F.lit(""))) != "")
    if pairs is not None:
        picked = picked.join(pairs.select("sheet_id", "no").distinct(), ["sheet_id", "no"], "left_semi")
    return picked
