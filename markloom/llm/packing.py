"""Packing of tokenised documents into few sequences by linear grouping.

Lengths are whole numbers up to the capacity, so their histogram has at most ``capacity`` rows however many
documents there are; it alone reaches the driver.  There, lengths above a share of the capacity are cut
into groups of equal cardinality and rounded up to the largest of their group; configurations of these few
lengths are optimised by column generation; the real lengths take the slots of their group; the shorter ones
follow by best fit, longest first.  The outcome is a list of classes of equally filled sequences, bounded by
the number of different lengths.  Documents are then numbered within their length, in buckets so that no
length needs one task, and joined to the slots of their length.

Defined cases: null and empty texts have one id (the closing 0); repeated rows are packed each; an empty
table gives no rows; columns besides those named pass through ``place`` unchanged, clashing or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import body, ranked, written
from markloom.llm.tokens import part_tokenizer
from markloom.llm.words import released, text_column

GROUPS = 48
PIECES = "row long, doc_id long, piece int, start long, length long, ids binary"


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = part_tokenizer(path)
        for batch in batches:
            at = 0
            for ids, counts in tokenizer.blocks(text_column(batch)):
                ends = np.cumsum(counts)
                flat = np.insert(ids, ends, 0).astype("<u4")
                sizes = counts + 1
                firsts = np.cumsum(sizes) - sizes
                n = -(-sizes // capacity)
                text = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(sizes[text] - start, capacity)
                edges = np.append(firsts[text] + start, len(flat)) * 4
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(text), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(flat)])
                own = pa.array(text + at)
                cols = [batch.column("row").take(own), batch.column("doc_id").take(own), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), binary.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "piece", "start", "length", "ids"])
                at += len(counts)

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Every document's ids (closed by 0), cut into pieces of ``capacity`` ids; ``ids`` are little-endian
    unsigned 32-bit numbers."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    return texts.mapInArrow(released(_pieces(path, capacity)), PIECES)


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes of the greatest worth within the capacity."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        gains = value[room - sizes[fits]] + worth[fits]
        best = int(np.argmax(gains))
        value[room], last[room] = value[room - 1], -1
        if gains[best] > value[room] + 1e-12:
            value[room], last[room] = gains[best], fits[best]
    taken, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            taken[last[room]] += 1
            room -= int(sizes[last[room]])
    return taken


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """``(count, multiplicities)`` covering the demand exactly: a linear programme solved by column
    generation until no column improves it, rounded down, and first fit for what rounding leaves."""
    basis = np.diag(capacity // sizes).astype(float)
    amount = demand / np.diag(basis)
    met: set[bytes] = set()
    while True:
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = _best_configuration(sizes, worth, capacity)
        if worth @ column <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-12, amount / np.where(step > 1e-12, step, 1), np.inf)
        out = int(np.argmin(ratio))
        amount = np.maximum(amount - ratio[out] * step, 0)
        if ratio[out] > 1e-9:
            met.clear()
        amount[out], basis[:, out] = ratio[out], column
        if (key := basis.tobytes()) in met:
            break  # steps of no length have come back to where they were
        met.add(key)
    left, found = demand.astype(np.int64).copy(), []
    for count, column in zip(amount, basis.T.astype(np.int64), strict=True):
        used = column > 0
        whole = min(int(count + 1e-9), int((left[used] // column[used]).min()))
        if whole:
            found.append((whole, column))
            left -= whole * column
    while left.any():
        room, column = capacity, np.zeros(len(sizes), np.int64)
        for i in np.argsort(-sizes):
            column[i] = min(left[i], room // sizes[i])
            room -= int(column[i] * sizes[i])
        used = column > 0
        whole = int((left[used] // column[used]).min())
        found.append((whole, column))
        left -= whole * column
    return found


def _substituted(config: list[tuple[int, np.ndarray]], groups: list[list[list[int]]]) -> list[list]:
    """Classes ``[count, [(length, times)]]``: the slots of a group take its real lengths in order."""
    classes = []
    for count, column in config:
        runs = []
        for g in np.flatnonzero(column):
            for _ in range(int(column[g])):
                run, need = [], count
                while need:
                    length, n = groups[g][0]
                    take = min(n, need)
                    run.append([length, take])
                    need -= take
                    groups[g][0][1] -= take
                    if not groups[g][0][1]:
                        groups[g].pop(0)
                runs.append(run)
        while count:
            some = min(run[0][1] for run in runs)
            held: dict[int, int] = {}
            for run in runs:
                held[run[0][0]] = held.get(run[0][0], 0) + 1
                run[0][1] -= some
                if not run[0][1]:
                    run.pop(0)
            classes.append([some, list(held.items())])
            count -= some
    return classes


def fill_plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> list[list]:
    """Classes ``[count, [(length, times), ...]]`` that use every document of the histogram once.

    What counts as large is a free parameter of the scheme; the bounds tried are a half, a third and a
    quarter of the capacity, and the plan with the fewest sequences is kept.
    """
    plans = [_grouped_plan(histogram, capacity, groups, capacity // part) for part in (2, 3, 4)]
    return min(plans, key=lambda plan: sum(count for count, _ in plan))


def _grouped_plan(histogram: dict[int, int], capacity: int, groups: int, bound: int) -> list[list]:
    large = [[length, n] for length, n in sorted(histogram.items(), reverse=True) if bound < length < capacity and n > 0]
    total, classes = sum(n for _, n in large), []
    if total:
        parts: list[list[list[int]]] = []
        size, seen = -(-total // groups), 0
        for length, n in large:
            while n:
                at = seen // size
                if at >= len(parts):
                    parts.append([])
                take = min(n, (at + 1) * size - seen)
                parts[-1].append([length, take])
                seen, n = seen + take, n - take
        merged: dict[int, list[list[int]]] = {}
        for part in parts:
            merged.setdefault(part[0][0], []).extend(part)
        sizes = np.array(list(merged))
        demand = np.array([sum(n for _, n in part) for part in merged.values()])
        classes = _substituted(configurations(sizes, demand, capacity), list(merged.values()))
    if histogram.get(capacity):
        classes.append([histogram[capacity], [(capacity, 1)]])
    rooms: list[list[list]] = [[] for _ in range(capacity + 1)]
    for c in classes:
        rooms[capacity - sum(length * times for length, times in c[1])].append(c)
    for length in sorted((x for x, n in histogram.items() if x <= bound and n > 0), reverse=True):
        n = histogram[length]
        while n:
            room = next((r for r in range(length, capacity + 1) if rooms[r]), None)
            if room is None:
                per = capacity // length
                rooms[capacity].append([-(-n // per), []])
                continue
            count, held = rooms[room].pop()
            per = room // length
            full = min(count, n // per)
            if full:
                rooms[room - full // full * per * length].append([full, [*held, (length, per)]])
                n -= full * per
            if full < count and n and full == n // per + full and n < per:
                rooms[room - n * length].append([1, [*held, (length, n)]])
                full, n = full + 1, 0
            if full < count:
                rooms[room].append([count - full, held])
    return [c for room in rooms for c in room]


def slots(classes: list[list]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first_rank, end_rank, times, first_sequence, offset)`` of every class and length."""
    rank: dict[int, int] = {}
    found, sequence = [], 0
    for count, held in classes:
        offset = 0
        for length, times in held:
            first = rank.get(length, 0)
            rank[length] = first + count * times
            found.append((length, first, rank[length], times, sequence, offset))
            offset += length * times
        sequence += count
    return found


def place(pieces: DataFrame, order: list[str], capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    ``order`` names columns that tell the rows apart; among equal lengths they decide who goes where.  The
    rows are read twice, so they should come from a table.
    """
    counts = pieces.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.collect()}  # at most ``capacity`` rows
    schema = "_length long, _first long, _end long, _times long, _sequence long, _offset long"
    where = pieces.sparkSession.createDataFrame(slots(fill_plan(histogram, capacity)), schema)
    numbered = ranked(pieces, ["length"], order, "_rank")
    taken = numbered.join(where, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    nth = F.col("_rank") - F.col("_first")
    return taken.select(
        *[taken[c] for c in pieces.columns],
        (F.col("_sequence") + F.floor(nth / F.col("_times"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (nth % F.col("_times")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_digest(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Where every piece went, with a checksum of its ids in place of the ids."""
    pieces = token_pieces(docs, path, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(written(pieces, "pieces"), ["row", "piece"], capacity).drop("row")
