"""What the operators of this folder share: row keys, tables in the shared folder, graph components."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markloom.session import written

__all__ = ["SPACE", "body", "components", "free_name", "numbered", "ranked", "read", "written"]

SPACE = r"[\x20\x09-\x0D]+"
#: Bits of a row's number that count the rows of a file.
FILE_ROWS = 40


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def body(text: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't use, whatever the case of letters."""
    used = {c.lower() for c in df.columns}
    while stem.lower() in used:
        stem = f"_{stem}"
    return stem


def numbered(docs: DataFrame, name: str, *columns: str | Column) -> DataFrame:
    """``columns`` (or all) and a number of every row that each later read finds again.

    A row of a Parquet table is numbered by its file's rank among the paths and its place in the file, which
    do not depend on how a read is split.  Rows of any other input have no such place: they are stored with
    their number once.
    """
    scan = docs._jdf.queryExecution().analyzed()
    if scan.getClass().getSimpleName() == "LogicalRelation" and len(paths := list(docs._jdf.inputFiles())) > 0:
        listed = list(scan.relation().location().inputFiles())
        try:
            place = docs.metadataColumn("_metadata")
            path, index, number = (free_name(docs, x) for x in ("path", "index", "number"))
            placed = docs.select(*(columns or "*"), place["file_path"].alias(path), place["row_index"].alias(index))
        except AnalysisException:
            placed = None
        if placed is not None and len(listed) == len(paths):
            order = F.row_number().over(Window.orderBy(path)).cast("long")
            files = written(docs.select(place["file_path"].alias(path)).distinct().select(path, order.alias(number)), "files")
            # Never null, and known to be: so no join filters it first and all joins can share one exchange.
            found = F.coalesce(F.shiftleft(number, FILE_ROWS) + F.col(index), F.lit(0).cast("long"))
            return placed.join(F.broadcast(files), path).withColumn(name, found).drop(path, index, number)
    return written(docs.select(*(columns or "*"), F.monotonically_increasing_id().alias(name)), "numbered")


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str, buckets: int = 64) -> DataFrame:
    """Add the position (from 0) of every row within ``keys``, in an order that depends on ``order`` alone.

    Rows of a key are dealt into buckets by hash; the buckets are counted with partial sums, the running
    total of at most ``buckets`` counts a key gives each bucket its first position, and rows are numbered
    inside a bucket.  A key that holds most of the rows is so spread over ``buckets`` tasks.
    """
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_at", F.row_number().over(inside) - 1)
    match = [numbered[k].eqNullSafe(firsts[k]) for k in [*keys, "_bucket"]]
    both = match[0]
    for m in match[1:]:
        both = both & m
    return numbered.join(firsts, both).select(*[numbered[c] for c in rows.columns], (F.col("_first") + F.col("_at")).alias(name))


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every node of ``edges (a, b)``; a component is named by its smallest node.

    Every round hooks each label to its smallest neighbour, follows the hooks a few steps and relabels
    the edges, until none joins two labels.  Each round is a table in the shared folder, so a lost
    executor repeats one round at most; labels and edges never leave the executors.
    """
    both = edges.select("a", "b").filter("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("a <> b"))
    pending = written(both.distinct(), "edges")
    labels = written(pending.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    step = labels
    while True:
        for _ in range(2):
            up = step.select(F.col("id").alias("component"), F.col("component").alias("_up"))
            step = step.join(up, "component", "left").select("id", F.coalesce("_up", "component").alias("component"))
        step = written(step, "hooks")
        if step is not labels:
            up = step.select(F.col("id").alias("component"), F.col("component").alias("_up"))
            labels = written(labels.join(up, "component", "left").select("id", F.coalesce("_up", "component").alias("component")), "labels")
        ends = step.select(F.col("id").alias("a"), F.col("component").alias("_a"))
        moved = pending.join(ends, "a").join(ends.select(F.col("a").alias("b"), F.col("_a").alias("_b")), "b")
        pending = written(moved.filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "edges")
        if pending.isEmpty():
            return labels
        step = pending.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component"))
