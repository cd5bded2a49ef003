"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

A text without white space is cut into chunks at places its own content decides (sentence marks beyond a
least length).  Distinct chunks get verified identifiers: their 64-bit hash, and where two different
chunks share a hash, also their rank among those.  Two texts are equal when their ordered identifier
lists are, so a long text travels once at most, as chunks that map tasks have already made distinct, and
the comparison moves eight bytes a chunk.

Defined cases: a null text equals an empty one (one chunk-less recipe); equal rows (same id, same text)
form a group of which one row stays; a null id sorts last; an empty table gives no rows; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.llm.common import SPACE, body, free_name, numbered, written

LEAST, MOST = 256, 4096
#: From LEAST characters on, a chunk ends behind the next sentence mark, at the latest after MOST characters.
CHUNK = rf"(?s).{{{LEAST},{MOST - 1}}}?[.!?;:。！？؟।]|.{{1,{MOST}}}"


def chunked(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, n_chars, bare, chunks)`` of ``row, doc_id, text``: the text without white space and its chunks in order."""
    bare = F.regexp_replace(body(), SPACE, "")
    return docs.select("row", "doc_id", F.length(body()).alias("n_chars"), bare.alias("bare")).withColumn("chunks", F.regexp_extract_all("bare", F.lit(CHUNK), F.lit(0)))


def clashes(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """``(hash, chunk, variant)`` of the chunks that share their hash with another chunk."""
    chunks = chunked(docs).select(F.explode("chunks").alias("chunk"))
    store = chunks.select(digest(F.col("chunk")).alias("hash"), "chunk").distinct()
    shared = store.groupBy("hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("hash")
    return store.join(shared, "hash").withColumn("variant", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")))


def recipes(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``(row, doc_id, n_chars, text_sha256, recipe)``: the ordered chunk identifiers of every row."""
    plain = chunked(docs).select(
        "row", "doc_id", "n_chars", F.sha2("bare", 256).alias("text_sha256"),
        F.transform("chunks", lambda c: F.struct(digest(c).alias("hash"), F.lit(0).alias("variant"))).alias("recipe"),
    )
    clash = written(clashes(docs, digest), "clashes")
    if clash.isEmpty():
        return plain
    parts = chunked(docs).select("row", F.posexplode("chunks").alias("pos", "chunk")).withColumn("hash", digest(F.col("chunk")))
    touched = parts.join(clash.select("hash").distinct(), "hash", "left_semi").select("row").distinct()
    named = parts.join(touched, "row", "left_semi").join(clash, ["hash", "chunk"], "left")
    item = F.struct("pos", "hash", F.coalesce("variant", F.lit(0)).alias("variant"))
    lists = named.groupBy("row").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    exact = F.transform("_items", lambda x: F.struct(x["hash"].alias("hash"), x["variant"].alias("variant")))
    return plain.join(lists, "row", "left").withColumn("recipe", F.coalesce(exact, "recipe")).drop("_items")


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts (white space ``[\\x20\\x09-\\x0D]`` aside) the row with the most code points stays, then the
    one with the smallest id, then the first.  Groups are counted with partial sums and joined back, a
    join that Spark can split when one group holds much of the table.
    """
    return _grouped(numbered(docs, "row", "doc_id", "text"), digest)


def _grouped(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``exact_groups`` of rows that have their number, ``row, doc_id, text``."""
    rows = written(recipes(docs, digest).withColumn("code", F.xxhash64("recipe")), "recipes")
    first = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row")))
    groups = rows.groupBy("code", "recipe").agg(first.alias("first"), F.count("*").alias("group_size"))
    return rows.join(groups, ["code", "recipe"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", "row"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the input's columns."""
    name = free_name(docs, "row")
    docs = numbered(docs, name)
    kept = _grouped(docs.select(F.col(name).alias("row"), "doc_id", "text")).filter("kept").select(F.col("row").alias(name))
    return docs.join(kept, name, "left_semi").drop(name)
