"""Repeated passages: word windows that already start in a document with a smaller id are cut out.

Windows are found through anchors.  An anchor is a shorter run of words that starts at a position whose
remainder modulo a period lies in a perfect difference set; whatever the offsets of two equal windows in
their texts, some anchor inside them starts at such a position in both.  So only 3 of 7 positions (for
13-word windows) are hashed and shuffled.  Anchors found in two rows are extended: all full windows around
them are hashed and grouped, and a window is cut wherever its group holds a smaller id.  Both groupings are
sorted streams: a passage that most documents share passes through in constant memory.

Rows whose whole word sequence another row with a smaller id has are recognised first: all their windows are
cut, so they need no anchors.  The texts are shuffled once; the three joins read the same exchange.

Defined cases: a null text has no words; texts shorter than a window lose nothing; rows with equal ids take
nothing from each other; a null id counts as larger than any other; an empty table gives no rows; other
columns are ignored.  Texts are read again by numbers that do not depend on how a read is split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import body, numbered, written
from markloom.llm.words import joined, mix, text_column, word_blocks

#: Perfect difference sets by their period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
LAST = (1 << 63) - 1


def cover_of(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover positions and anchor length for windows of so many words."""
    period = max((p for p in COVERS if p <= (window + 1) // 2), default=1)
    return period, COVERS.get(period, (0,)), window - period + 1


def _places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and position of every word of a block."""
    text = np.repeat(np.arange(len(counts)), counts)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)


def _anchors(window: int):
    period, cover, length = cover_of(window)
    wanted = np.isin(np.arange(period), cover)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = batch.column("row").to_numpy(), 0
            for words, counts in word_blocks(text_column(batch)):
                text, pos = _places(counts)
                fits = wanted[pos % period] & (pos + window <= counts[text] + window - length)
                start = np.flatnonzero(fits)
                codes = joined(words, length)[start].view(np.int64) if len(start) else np.zeros(0, np.int64)
                own = rows[at : at + len(counts)][text[start]]
                at += len(counts)
                for a in range(0, len(start), 1 << 16):
                    b = a + (1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array(codes[a:b]), pa.array(own[a:b]), pa.array(pos[start[a:b]], pa.int32())], ["code", "row", "pos"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a stream sorted by (code, row) whose code has more than one row."""
    kept: list[pa.RecordBatch] = []
    last, several = None, False

    def out() -> Iterator[pa.RecordBatch]:
        for part in kept:
            yield part.select(["row", "pos"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        code, row = batch.column("code").to_numpy(), batch.column("row").to_numpy()
        cut = np.flatnonzero(code[1:] != code[:-1]) + 1
        starts, ends = np.append(0, cut), np.append(cut, len(code))
        if last is not None and code[0] == last[0]:
            several = several or bool((row[: ends[0]] != last[1]).any())
            if several:
                yield from out()
                kept = []
        else:
            kept, several = [], False
        many = row[starts] != row[ends - 1]
        many[0] |= several
        yield batch.filter(pa.array(np.repeat(many, ends - starts))).select(["row", "pos"])
        tail = int(starts[-1])
        if len(starts) > 1:
            kept, several = [], False
        several = bool(many[-1])
        if not several:
            kept.append(batch.slice(tail))
        last = (code[-1], row[-1])


def _windows(window: int):
    period, _, _ = cover_of(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, at = batch.column("row").to_numpy(), batch.column("id").to_numpy(), 0
            places = batch.column("places")
            for words, counts in word_blocks(text_column(batch)):
                heads = np.cumsum(counts) - counts
                part = places.slice(at, len(counts))
                own, n = rows[at : at + len(counts)], part.value_lengths().to_numpy()
                anchors = np.repeat(heads, n) + part.flatten().to_numpy()
                at += len(counts)
                near = np.zeros(len(words) + 1, np.int64)
                np.add.at(near, np.maximum(anchors - period + 1, 0), 1)
                np.add.at(near, anchors + 1, -1)
                text, pos = _places(counts)
                start = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (pos + window <= counts[text]))
                codes = joined(words, window)[start].view(np.int64) if len(start) else np.zeros(0, np.int64)
                owner, own_ids = own[text[start]], ids[at - len(counts) : at][text[start]]
                for a in range(0, len(start), 1 << 16):
                    b = a + (1 << 16)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(codes[a:b]), pa.array(own_ids[a:b]), pa.array(owner[a:b]), pa.array(pos[start[a:b]], pa.int32())], ["code", "id", "row", "pos"]
                    )

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a stream sorted by (code, id) whose code starts with a smaller id."""
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        code, ids = batch.column("code").to_numpy(), batch.column("id").to_numpy()
        cut = np.flatnonzero(code[1:] != code[:-1]) + 1
        starts = np.append(0, cut)
        least = ids[starts].copy()
        if last is not None and last[0] == code[0]:
            least[0] = last[1]
        first = np.repeat(least, np.diff(np.append(starts, len(code))))
        last = (code[-1], least[-1])
        yield batch.filter(pa.array(ids > first)).select(["row", "pos"])


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words and 128 bits of hash of every row's word sequence."""
    for batch in batches:
        found = [(np.zeros(0, np.int64),) * 3]
        for words, counts in word_blocks(text_column(batch)):
            _, pos = _places(counts)
            placed = mix(words + mix(pos.astype(np.uint64)))
            sums = [np.append(np.uint64(0), np.cumsum(x)) for x in (placed, mix(placed + np.uint64(1)))]
            ends = np.cumsum(counts)
            found.append((counts.astype(np.int64), *((x[ends] - x[ends - counts]).view(np.int64) for x in sums)))
        n, one, two = (np.concatenate(x) for x in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n), pa.array(one), pa.array(two)], ["row", "doc_id", "n", "one", "two"])


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places, whole, total, gone, kept = text_column(batch), batch.column("places"), batch.column("whole").to_pylist(), [], [], []
            for i in range(batch.num_rows):
                words = texts[i].as_buffer().to_pybytes().split()
                total.append(len(words))
                starts = np.asarray(places[i].values, np.int64) if places[i].is_valid else np.zeros(0, np.int64)
                if whole[i]:
                    words = []
                elif len(starts):
                    edge = np.zeros(len(words) + window + 1, np.int64)
                    edge[starts] += 1
                    edge[starts + window] -= 1
                    stays = np.cumsum(edge)[: len(words)] == 0
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            cols = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.large_binary()).cast(pa.large_string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _sorted(rows: DataFrame, *order: str | Column) -> DataFrame:
    return rows.repartition("code").sortWithinPartitions(*order)


def cut_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every document; kept words are joined by one space."""
    texts = numbered(docs, "row", F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).select("row", "doc_id", "text")
    same = written(texts.mapInArrow(_codes, "row long, doc_id long, n long, one long, two long"), "codes").withColumn("id", F.coalesce("doc_id", F.lit(LAST))).filter(F.col("n") >= window)
    least = same.groupBy("n", "one", "two").agg(F.min("id").alias("least"))
    copies = written(same.join(least, ["n", "one", "two"]).select("row", (F.col("id") > F.col("least")).alias("whole")), "copies")

    shared_texts = texts.hint("merge")
    firsts = copies.filter(~F.col("whole")).select("row")
    anchors = firsts.join(shared_texts, "row").select("row", "doc_id", "text").mapInArrow(_anchors(window), "code long, row long, pos int")
    shared = _sorted(anchors, "code", "row").mapInArrow(_shared, "row long, pos int")
    places = shared.groupBy("row").agg(F.collect_list("pos").alias("places"))
    known = places.join(shared_texts, "row").select("row", F.coalesce("doc_id", F.lit(LAST)).alias("id"), "text", "places")
    later = _sorted(known.mapInArrow(_windows(window), "code long, id long, row long, pos int"), "code", "id").mapInArrow(_later, "row long, pos int")
    cuts = later.groupBy("row").agg(F.collect_list("pos").alias("places"), F.lit(False).alias("whole"))
    cuts = cuts.union(copies.filter("whole").select("row", F.lit(None).cast("array<int>").alias("places"), "whole"))
    marked = shared_texts.join(cuts, "row", "left").select("doc_id", "text", "places", F.coalesce("whole", F.lit(False)).alias("whole"))
    return marked.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text string")
