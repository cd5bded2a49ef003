"""Ordered operators that stay distributed when one key holds a large share of the rows.

A plain ``lag`` or running sum partitions by the key alone, so a hot key lands in one task.  Here
the key is cut into order-preserving buckets: the window runs inside (key, bucket), and one summary row
per bucket carries what the next bucket needs and is read in front of that bucket's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.session import written

_BUCKET = "_bucket"
SEQ_BUCKET = 4096  # rows of one key per window task when the order column is a dense position
LARGE_KEY = 1 << 20  # rows of one key that one window task takes as they are
HASHES = 4096  # hash classes of keys that are counted before the keys themselves
LIST_WIDTH = 10000  # values of one part of a folded list


def seq_bucket(seq: str, size: int = SEQ_BUCKET) -> Column:
    return F.floor(F.col(seq) / size)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """The rows over all shuffle partitions.

    Positions and ids compress so well that Spark, which judges shuffled data by its bytes, would put millions of them into one
    task; a read of a stored table does so too.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal-or-both-null keys, keeping the left key columns."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    joined = left.join(renamed, cond, how)
    if how in ("left_anti", "left_semi"):
        return joined
    return joined.drop(*[f"_r_{k}" for k in keys])


def _with_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows behind the one mark of their bucket (``_row`` 0), which brings what the buckets before it leave.

    A mark travels with the rows in the shuffle of their window, so nothing is joined back.
    """
    return rows.withColumn("_row", F.lit(1)).unionByName(marks.withColumn("_row", F.lit(0)), allowMissingColumns=True)


def lag_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, out: str) -> DataFrame:
    """Previous value of ``value`` inside each key, in ``order``."""
    wide = df.withColumn(_BUCKET, bucket)
    part = [*keys, _BUCKET]
    last = wide.groupBy(*part).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(_BUCKET))).filter("_carry is not null")
    marked = _with_marks(wide, carried.select(*part, F.col("_carry.v").alias(value)))
    window = Window.partitionBy(*part).orderBy("_row", *order)
    return marked.withColumn(out, F.lag(value).over(window)).filter("_row = 1").drop("_row", _BUCKET)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, out: str, uncut: bool = False
) -> DataFrame:
    """Inclusive running total of ``value`` inside each key. ``order`` must have no ties.

    ``uncut``: a row without bucket has its whole key with it (see ``cut_large``).
    """
    wide = df.withColumn(_BUCKET, bucket).withColumn("_v", value.cast("bigint"))
    part = [*keys, _BUCKET]
    totals = (wide.filter(F.col(_BUCKET).isNotNull()) if uncut else wide).groupBy(*part).agg(F.sum("_v").alias("_total"))
    before = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_v", F.sum("_total").over(before)).drop("_total").filter("_v is not null")
    window = Window.partitionBy(*part).orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, 0)
    return _with_marks(wide, offsets).withColumn(out, F.sum("_v").over(window)).filter("_row = 1").drop("_v", "_row", _BUCKET)


def large_keys(df: DataFrame, keys: Sequence[str], large: int = LARGE_KEY) -> DataFrame:
    """Keys with more than ``large`` rows.

    Hash classes of keys are counted first, which combines map-side to a few thousand rows a task, then the keys
    of classes that have so many rows: none in most tables, so their keys are not shuffled for it.
    """
    named = df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(HASHES)).alias("_class"))
    full = named.groupBy("_class").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > large)
    suspects = named.join(F.broadcast(full.select("_class")), "_class", "left_semi")
    return suspects.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > large).select(*keys)


def cut_large(df: DataFrame, keys: Sequence[str], bucket: Column, large: int = LARGE_KEY, out: str = "_cut") -> DataFrame:
    """Add the bucket of every row whose key has more than ``large`` rows; other keys stay in one piece (NULL).

    At most one row in ``large`` gives a large key, so their list is broadcast.
    """
    marked = df.join(F.broadcast(large_keys(df, keys, large).withColumn("_large", F.lit(True))), list(keys), "left")
    return marked.withColumn(out, F.when(F.col("_large"), bucket)).drop("_large")


def position(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str = "seq", large: int | None = None) -> DataFrame:
    """Zero-based position of every row inside its key; with ``large``, only keys of more rows are cut into buckets."""
    if large is None:
        return running_sum(df, keys, order, bucket, F.lit(1), out).withColumn(out, F.col(out) - 1)
    cut = cut_large(df, keys, bucket, large)
    placed = running_sum(cut, keys, order, F.col("_cut"), F.lit(1), out, uncut=True)
    return placed.withColumn(out, F.col(out) - 1).drop("_cut")


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "_range") -> DataFrame:
    """The rows, stored, with the number of their stretch.

    Stretches hold successive rows of ``keys`` and ``order`` and about equally many each: Spark samples the
    boundaries, so neither a frequent key nor a frequent beginning of names fills one.  Equal rows share a
    stretch.  The number is an order-preserving bucket for ``position`` and its kin.
    """
    return written(df.repartitionByRange(*keys, *order).withColumn(out, F.spark_partition_id()), "ranged")


def ranked_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "seq", large: int = LARGE_KEY) -> DataFrame:
    """Zero-based position of every row inside its key, in any order of columns without ties.

    Keys of more than ``large`` rows get their positions in sampled ranges, the others in one window each.
    """
    rows = written(df, "ranked")
    hot = written(large_keys(rows, keys, large), "large-keys")
    place = lambda some: some.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint") - 1)
    if hot.isEmpty():
        return place(rows)
    hot = F.broadcast(hot)
    many = ranged(join_null_safe(rows, hot, keys, "left_semi"), keys, order)
    return place(join_null_safe(rows, hot, keys, "left_anti")).unionByName(position(many, keys, order, F.col("_range"), out).drop("_range"))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """First k rows per key. Spark keeps only k rows per key and map task before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col("_rank") <= k)
    return kept.withColumnRenamed("_rank", rank) if rank else kept.drop("_rank")


def short_list(
    df: DataFrame, keys: Sequence[str], value: Column, order: Sequence[Column], limit: int, out: str, sep: str = ", "
) -> DataFrame:
    """Per key, the first ``limit`` values joined to one text, followed by ' …' when there are more."""
    top = first_rows(df.withColumn("_value", value), keys, order, limit + 1, rank="_k")
    folded = top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_k", "_value"))).alias("_all"))
    shown = F.array_join(F.transform(F.slice("_all", 1, limit), lambda x: x["_value"]), sep)
    more = F.when(F.size("_all") > limit, F.lit(" …")).otherwise(F.lit(""))
    return folded.select(*keys, F.concat(shown, more).alias(out))


def fold_text(
    df: DataFrame, keys: Sequence[str], value: Column, order: Sequence[str], out: str, sep: str = ", ", width: int = LIST_WIDTH, hot: bool = False
) -> DataFrame:
    """Join the values of a key, in order, into texts of at most ``width`` values each.

    Columns: keys, part, out.  Every key is cut the same way: ``part`` is the position of a value
    divided by ``width``, from 0, so the parts of a key joined in order are its whole text and no
    single value grows without bound.  ``hot`` is for keys that may hold much of the table: values get
    their positions in sampled ranges, and no task sees more of a key than one range or one part.
    """
    marks = [f"_o{i}" for i in range(len(order))]
    slim = df.select(*keys, *[F.col(c).alias(m) for c, m in zip(order, marks)], value.alias("_value"))
    if hot:
        placed = ranked_position(slim, keys, [*marks, "_value"], "_at")
    else:
        placed = slim.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*marks, "_value")) - 1)
    parts = placed.withColumn("part", F.floor(F.col("_at") / width).cast("bigint"))
    folded = parts.groupBy(*keys, "part").agg(F.sort_array(F.collect_list(F.struct("_at", "_value"))).alias("_all"))
    return folded.select(*keys, "part", F.array_join(F.transform("_all", lambda x: x["_value"]), sep).alias(out))
