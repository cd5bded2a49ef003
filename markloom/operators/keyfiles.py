"""Answer key files: which are keys, which are registered, which changed since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions.files import is_answer_key, is_readable, is_retest_file
from markloom.functions.text import composed, text_or_empty, trimmed
from markloom.operators import sequences as S


def answer_key_files(files: DataFrame) -> DataFrame:
    return files.filter(is_answer_key(F.col("name")))


def retest_files(files: DataFrame, cutoff: Column, limit: int = K.MAX_RETEST_FILES) -> DataFrame:
    """Documents changed after the cutoff, newest first, at most ``limit``, with a flag when more exist."""
    wanted = files.filter(is_retest_file(F.col("name"), F.col("mime")) & (F.col("modified") > cutoff))
    total = wanted.agg((F.count("*") > limit).alias("truncated")).withColumn("_one", F.lit(1))
    top = wanted.orderBy(F.col("modified").desc(), "file_id").limit(limit)
    tagged = top.withColumn("readable", is_readable(F.col("name"), F.col("mime"))).withColumn("_one", F.lit(1))
    return tagged.join(F.broadcast(total), "_one").drop("_one")  # total is one row


def search_files(files: DataFrame, needle: str) -> DataFrame:
    """Substring of folder and name, ignoring case and character width; an empty needle keeps all."""
    wanted = F.lower(trimmed(composed(F.lit(needle))))
    text = F.lower(composed(F.concat_ws(" ", text_or_empty(F.col("folder")), text_or_empty(F.col("name")))))
    return files.filter((wanted == "") | F.contains(text, wanted))


def latest_key_per_file(keys: DataFrame) -> DataFrame:
    """Newest registration per file; of equal times the first one stays. Keys without a file hide nothing."""
    sourced = keys.withColumn("source_file_id", trimmed(F.col("source_file_id"))).filter("source_file_id <> ''")
    return S.first_rows(sourced, ["source_file_id"], [F.col("updated_at").desc_nulls_last(), F.col("reg_no")])


def split_registered_files(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Files with state todo / changed / done and the title they are registered under.

    Changed needs the stored time of the file; without it a registered file counts as done.
    """
    latest = latest_key_per_file(keys).select(
        F.col("source_file_id").alias("_id"), F.col("title").alias("registered_title"), F.col("source_modified").alias("_mod"), F.col("updated_at").alias("registered_at")
    )
    joined = files.join(latest, F.col("file_id").cast("string") == F.col("_id"), "left")
    newer = F.coalesce(F.col("modified") > F.col("_mod"), F.lit(False))
    state = F.when(F.col("_id").isNull(), "todo").when(newer, "changed").otherwise("done")
    return joined.withColumn("state", state).drop("_id", "_mod")


def open_files_union(split: DataFrame) -> DataFrame:
    """Changed files first, then those to do."""
    changed = split.filter("state = 'changed'").withColumn("group_rank", F.lit(1))
    todo = split.filter("state = 'todo'").withColumn("group_rank", F.lit(2))
    return changed.unionByName(todo).orderBy("group_rank", F.col("modified").desc(), "file_id")


def pair_consecutive(files: DataFrame) -> DataFrame:
    """Files of a folder in name order, two by two; the redder one of a pair is 'after'.

    ``files``: (folder, name, red). An odd last file comes out with state 'leftover'.
    """
    placed = S.ranked_position(files, ["folder"], ["name"], "_pos")
    grouped = placed.withColumn("pair_no", F.floor(F.col("_pos") / 2))
    # each pair has at most two files; the first one wins the 'before' role on equal red
    pair = grouped.groupBy("folder", "pair_no").agg(
        F.count("*").alias("_n"),
        F.min_by("name", F.struct("red", "_pos")).alias("before"),
        F.max_by("name", F.struct("red", "_pos")).alias("after"),
        F.min("red").alias("red_before"),
        F.max("red").alias("red_after"),
    )
    full = F.col("_n") == 2
    return pair.select(
        "folder", "pair_no", F.when(full, "pair").otherwise("leftover").alias("state"), "before",
        F.when(full, F.col("after")).alias("after"), F.round("red_before", 4).alias("red_before"),
        F.when(full, F.round("red_after", 4)).alias("red_after"),
    )
