"""Where two long token sequences of a document differ: matching blocks, longest first.

The rule: the longest run of tokens that both sides share is a match (the earliest on the left, then on the
right, among equals); what lies before it on both sides, and after it, is compared in the same way.

A document need not be one task's work.  Runs of at least GRAM tokens that nothing contradicts are found with
joins and windows over positions: a run is *certain* when every other pair of equal GRAM-token stretches lies
wholly before or wholly after each of its own on both sides.  No competing run can then be longer, so the rule
takes a certain run whole, whatever it does elsewhere, and documents fall into pieces between them.  Stretches
are never paired with each other; per stretch its first and last place on the other side is enough.  Pieces
are compared in Arrow workers, many to a batch.  Only a piece in which no stretch is certain (two texts
without GRAM tokens in common and in order) is as long as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markloom.operators import sequences as S
from markloom.session import shuffled, written

GRAM, BUCKET, LARGE = 8, 8192, 4_000
_FEW_PAIRS = 2_000_000
BLOCKS = "doc_id {}, i1 long, i2 long, j1 long, j2 long"


def _bucketed(tokens: DataFrame, halo: int, size: int) -> DataFrame:
    """Rows of every bucket of positions and up to ``halo`` rows on either side of it; ``own`` marks its own."""
    here = F.floor(F.col("pos") / size)
    sides = [here, F.floor((F.col("pos") - halo) / size), F.floor((F.col("pos") + halo) / size)]
    return tokens.withColumn("bucket", F.explode(F.array_distinct(F.array(*sides)))).withColumn("own", F.col("bucket") == here)


def _grams(tokens: DataFrame, gram: int, size: int) -> DataFrame:
    """``(doc_id, pos, gram)`` of every stretch of ``gram`` tokens, by its first place."""
    ahead = Window.partitionBy("doc_id", "bucket").orderBy("pos").rowsBetween(0, gram - 1)
    listed = _bucketed(tokens.select("doc_id", "pos", "text"), gram, size).withColumn("_w", F.collect_list("text").over(ahead))
    return listed.filter(F.col("own") & (F.size("_w") == gram)).select("doc_id", "pos", F.xxhash64("_w").alias("gram"), F.xxhash64(F.lit(1), "_w").alias("check"))


def certain_runs(exam: DataFrame, key: DataFrame, gram: int = GRAM, size: int = BUCKET) -> DataFrame:
    """``(doc_id, i, j, n)`` of runs that the rule is sure to take whole."""
    same = ["doc_id", "gram", "check"]
    there = _grams(key, gram, size).groupBy(*same).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    met = written(_grams(exam, gram, size).join(shuffled(there), same).select("doc_id", "pos", "first", "last"), "met")
    diagonal = F.when(F.col("first") == F.col("last"), F.col("first") - F.col("pos"))
    # Farthest place on the other side of all stretches in the buckets before and after, beyond the halo.
    tops = _bucketed(met, gram, size).groupBy("doc_id", "bucket").agg(
        F.max(F.when(F.col("own") & (F.col("pos") < (F.col("bucket") + 1) * size - gram), F.col("last"))).alias("inner_last"),
        F.min(F.when(F.col("own") & (F.col("pos") >= F.col("bucket") * size + gram), F.col("first"))).alias("inner_first"),
        F.max(F.when(F.col("own"), F.col("last"))).alias("all_last"), F.min(F.when(F.col("own"), F.col("first"))).alias("all_first"),
    )
    order = Window.partitionBy("doc_id").orderBy("bucket")
    # The bucket next to this one gives all but its rows within the halo, those beyond give all; buckets may be missing.
    near = lambda shift, value: F.when(F.lag("bucket", shift).over(order) == F.col("bucket") - shift, F.lag(value, shift).over(order)).otherwise(F.lag("all_" + value.split("_")[1], shift).over(order))
    carried = tops.select(
        "doc_id", "bucket",
        F.greatest(near(1, "inner_last"), F.max("all_last").over(order.rowsBetween(Window.unboundedPreceding, -2))).alias("before"),
        F.least(near(-1, "inner_first"), F.min("all_first").over(order.rowsBetween(2, Window.unboundedFollowing))).alias("after"),
    )
    rows = Window.partitionBy("doc_id", "bucket").orderBy("pos")
    wide = S.join_null_safe(_bucketed(met, gram, size), shuffled(carried), ["doc_id", "bucket"]).withColumn("d", diagonal)
    around = rows.rangeBetween(-(gram - 1), gram - 1)
    lower = F.greatest("before", F.max("last").over(rows.rangeBetween(Window.unboundedPreceding, -gram)))
    upper = F.least("after", F.min("first").over(rows.rangeBetween(gram, Window.unboundedFollowing)))
    alone = (F.count("d").over(around) == F.count("*").over(around)) & (F.min("d").over(around) == F.max("d").over(around))
    told = wide.select(
        "doc_id", "pos", "first", "own", (alone & F.coalesce(lower <= F.col("first") - gram, F.lit(True)) & F.coalesce(upper >= F.col("first") + gram, F.lit(True))).alias("clean"),
        F.coalesce((F.lag("pos").over(rows) == F.col("pos") - 1) & (F.lag("d").over(rows) == F.col("d")), F.lit(False)).alias("goes_on"),
    )
    own = told.filter("own").drop("own")
    runs = S.running_sum(own, ["doc_id"], ["pos"], F.floor(F.col("pos") / size), (~F.col("goes_on")).cast("int"), "run")
    taken = runs.groupBy("doc_id", "run").agg(F.min("pos").alias("i"), F.min("first").alias("j"), F.count("*").alias("n"), F.min("clean").alias("clean"))
    return taken.filter("clean").select("doc_id", "i", "j", (F.col("n") + gram - 1).alias("n"))


def _pieces(tokens: DataFrame, runs: DataFrame, start: str, size: int) -> DataFrame:
    """Tokens outside the runs, with the number of runs before them."""
    marks = runs.select("doc_id", F.col(start).alias("pos"), "n")
    marked = tokens.select("doc_id", "pos", "text").join(shuffled(marks), ["doc_id", "pos"], "left")
    bucket = F.floor(F.col("pos") / size)
    numbered = S.running_sum(marked, ["doc_id"], ["pos"], bucket, F.col("n").isNotNull().cast("int"), "piece")
    inside = runs.select("doc_id", F.explode(F.sequence(start, F.col(start) + F.col("n") - 1)).alias("pos"))
    return numbered.drop("n").join(shuffled(inside), ["doc_id", "pos"], "left_anti")


def _windows(codes: np.ndarray, n: int, top: int) -> np.ndarray:
    """One number per stretch of ``n`` codes; equal stretches of sequences up to ``top`` long have equal ones."""
    powers = np.cumprod(np.append(np.uint64(1), np.full(top, 0x9E3779B97F4A7C15, np.uint64)), dtype=np.uint64)
    sums = np.append(np.uint64(0), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], dtype=np.uint64))
    return (sums[n:] - sums[:-n]) * powers[top - np.arange(len(codes) - n + 1)]


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The longest common stretch of two sequences, by halving its length."""
    low, high, top = 0, min(len(a), len(b)), max(len(a), len(b))
    while low < high:
        n = (low + high + 1) // 2
        low, high = (n, high) if np.isin(_windows(a, n, top), _windows(b, n, top)).any() else (low, n - 1)
    if not low:
        return 0, 0, 0
    here, there = _windows(a, low, top), _windows(b, low, top)
    i = int(np.flatnonzero(np.isin(here, there))[0])
    return i, int(np.flatnonzero(there == here[i])[0]), low


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of equal codes that can't be made longer: both starts and the length."""
    order = np.argsort(b, kind="stable")
    first, last = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = last - first
    i = np.repeat(np.arange(len(a)), n)
    j = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    new = np.append(True, (np.diff(i) != 1) | (np.diff(j) != 1))[: len(i)]
    starts = np.flatnonzero(new)
    return i[starts], j[starts], np.diff(np.append(starts, len(i)))


def matching_blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Matches ``(i, j, n)`` of two code sequences by the rule, in order."""
    found, work = [], [(0, len(a), 0, len(b), None)]
    while work:
        a0, a1, b0, b1, runs = work.pop()
        if a0 == a1 or b0 == b1:
            continue
        if runs is None:
            _, sizes_a = np.unique(np.concatenate((a[a0:a1], b[b0:b1])), return_inverse=True)
            counts = [np.bincount(x, minlength=int(sizes_a.max()) + 1) for x in (sizes_a[: a1 - a0], sizes_a[a1 - a0 :])]
            if int(counts[0] @ counts[1]) > _FEW_PAIRS:
                i, j, n = _longest(a[a0:a1], b[b0:b1])
                i, j = i + a0, j + b0
            else:
                starts_i, starts_j, sizes = _runs(a[a0:a1], b[b0:b1])
                runs = (starts_i + a0, starts_j + b0, sizes)
        if runs is not None:
            si, sj, size = runs
            head = np.maximum(np.maximum(a0 - si, b0 - sj), 0)
            left = np.minimum(np.minimum(a1 - si, b1 - sj), size) - head
            live = left > 0
            if not live.any():
                continue
            runs, head, left = (si[live], sj[live], size[live]), head[live], left[live]
            n = int(left.max())
            best = np.flatnonzero(left == n)
            at = best[np.lexsort((runs[1][best] + head[best], runs[0][best] + head[best]))[0]]
            i, j = int(runs[0][at] + head[at]), int(runs[1][at] + head[at])
        if n:
            found.append((i, j, n))
            work += [(a0, i, b0, j, runs), (i + n, a1, j + n, b1, runs)]
    return sorted(found)


def changes(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """``(i1, i2, j1, j2)`` of the stretches between matches where the right side has something."""
    _, codes = np.unique(np.array([*a, *b], object).astype(str), return_inverse=True) if a or b else (None, np.zeros(0, int))
    out, i, j = [], 0, 0
    for x, y, n in [*matching_blocks(codes[: len(a)], codes[len(a) :]), (len(a), len(b), 0)]:
        if y > j:
            out.append((i, x, j, y))
        i, j = x + n, y + n
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of the pieces of a stream that is sorted by document, piece, side and position."""

    def solve(table: pa.Table) -> pa.Table:
        rows = []
        for (doc, _), part in table.to_pandas().groupby(["doc_id", "piece"], sort=False):
            left, right = part[part["side"] == 0], part[part["side"] == 1]
            i0, j0 = int(part["i0"].iloc[0]), int(part["j0"].iloc[0])
            rows += [(doc, i0 + i1, i0 + i2, j0 + j1, j0 + j2) for i1, i2, j1, j2 in changes(left["text"].tolist(), right["text"].tolist())]
        kinds = [table.schema.field("doc_id").type, *[pa.int64()] * 4]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "i1", "i2", "j1", "j2"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        docs, pieces = batch.column("doc_id").to_pylist(), batch.column("piece").to_pylist()
        last = len(docs)
        while last and (docs[last - 1], pieces[last - 1]) == (docs[-1], pieces[-1]):
            last -= 1
        if last or (held and (held[-1].column("doc_id")[0].as_py(), held[-1].column("piece")[0].as_py()) != (docs[0], pieces[0])):
            yield from solve(pa.Table.from_batches([*held, batch.slice(0, last)])).to_batches()
            held = []
        held.append(batch.slice(last))
    if held:
        yield from solve(pa.Table.from_batches(held)).to_batches()


def sequence_changes(exam: DataFrame, key: DataFrame, gram: int = GRAM, large: int = LARGE, size: int = BUCKET) -> DataFrame:
    """``(doc_id, i1, i2, j1, j2)``: stretches of the key's tokens, j1 to j2, that the exam lacks or has
    otherwise, i1 to i2.

    Both tables: (doc_id, pos, text), positions dense from 0.  Documents of more than ``large`` tokens a side
    are cut at certain runs first; the result does not depend on ``large``, ``gram`` or ``size``.
    """
    exam, key = exam.select("doc_id", "pos", "text"), key.select("doc_id", "pos", "text")
    sizes = exam.unionAll(key).groupBy("doc_id").agg(F.max("pos").alias("_n")).filter(F.col("_n") >= large).select("doc_id")
    sizes = written(sizes, "large")
    some = [S.join_null_safe(t, sizes, ["doc_id"], "left_semi") for t in (exam, key)]
    rest = [S.join_null_safe(t, sizes, ["doc_id"], "left_anti").withColumn("piece", F.lit(0).cast("bigint")) for t in (exam, key)]
    runs = written(certain_runs(*some, gram, size), "runs")
    cut = [_pieces(t, runs, start, size).select("doc_id", "pos", "text", "piece") for t, start in zip(some, ("i", "j"), strict=True)]
    # Where each piece begins on either side: behind the run before it.
    ends = runs.select("doc_id", (F.col("i") + F.col("n")).alias("i0"), (F.col("j") + F.col("n")).alias("j0"), "i")
    starts = S.position(ends, ["doc_id"], ["i"], F.floor(F.col("i") / size), "piece").select("doc_id", (F.col("piece") + 1).alias("piece"), "i0", "j0")
    sides = [df.select("doc_id", "piece", F.lit(k).alias("side"), "pos", "text") for k in (0, 1) for df in (rest[k], cut[k])]
    whole = sides[0].unionAll(sides[1]).unionAll(sides[2]).unionAll(sides[3])
    placed = S.join_null_safe(whole, shuffled(starts), ["doc_id", "piece"]).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("i0", "j0")})
    sorted_ = placed.repartition("doc_id", "piece").sortWithinPartitions("doc_id", "piece", "side", "pos")
    return sorted_.mapInArrow(_compare, BLOCKS.format(exam.schema["doc_id"].dataType.simpleString()))


def tokens_of(blocks: DataFrame, tokens: DataFrame, start: str, end: str) -> DataFrame:
    """The tokens of the stretch ``start`` to ``end`` of every block, with the block's number ``block``."""
    spots = blocks.filter(F.col(start) < F.col(end)).select("doc_id", F.col("j1").alias("block"), F.explode(F.sequence(F.col(start), F.col(end) - 1)).alias("pos"))
    return spots.join(shuffled(tokens), ["doc_id", "pos"])

