"""License notices by diagonal voting.

All rolling word k-grams of a text are hashed and joined to the positions of the same k-grams in license
templates (a table of fixed size, broadcast).  A match votes for the diagonal ``place in text - place in
template``; votes are counted per text, template and diagonal with partial sums.  Diagonals that lie close
together (a word more or less) form a band, whose lines at neighbouring places are merged; a stray line can
so widen a span, not split it.  A merged span counts when it covers enough of its template's k-grams, each
counted once.  Base phrases are templates that one k-gram covers whole.

Words are lower-cased runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; k-grams are compared by 64-bit hash.

Defined cases: null and empty texts have no words and no labels; repeated rows get a row each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markloom.llm.common import body
from markloom.llm.words import joined, text_column, token_blocks

#: Phrases whose every place counts, with their labels.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Customary notices with their labels.
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
)
#: k of the notices; words a merged span may shift; words between merged spans; share of k-grams to cover.
GRAM, SLIP, GAP, SHARE = 3, 3, 6, 0.6
_NONE = 0  # joins every text to one row, so that texts without a match stay


def template_rows() -> list[tuple[int, int, int, str, bool, int]]:
    """``(gram, template, position, label, base, grams)`` of every template k-gram."""
    rows = [(_NONE, -1, 0, "", False, 1)]
    for number, (label, text) in enumerate(PHRASES + NOTICES):
        words = next(token_blocks(pa.array([text], pa.large_string())))[0]
        base = number < len(PHRASES)
        k = len(words) if base else GRAM
        grams = joined(words, k).view(np.int64).tolist()
        assert len(grams) < 64  # the places a span covers are bits of a long
        rows += [(gram, number, at, label, base, len(grams)) for at, gram in enumerate(grams)]
    return rows


def _grams(sizes: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for words, counts in token_blocks(text_column(batch)):
                text = np.repeat(np.arange(len(counts)), counts)
                left = np.repeat(np.cumsum(counts), counts) - np.arange(len(text))
                pos = np.repeat(counts, counts) - left
                parts = [(np.arange(len(counts)), np.zeros(len(counts), np.int64), np.full(len(counts), _NONE, np.int64))]
                for k in sizes:
                    fits = np.flatnonzero(left >= k)
                    parts.append((text[fits], pos[fits], joined(words, k)[fits].view(np.int64) if len(fits) else np.zeros(0, np.int64)))
                own, start, gram = (np.concatenate(x) for x in zip(*parts, strict=True))
                for a in range(0, len(own), 1 << 16):
                    some = slice(a, a + (1 << 16))
                    take = pa.array(own[some] + at)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row").take(take), batch.column("doc_id").take(take), pa.array(counts[own[some]].astype(np.int64)), pa.array(start[some].astype(np.int64)), pa.array(gram[some])],
                        ["row", "doc_id", "n_words", "start", "gram"],
                    )
                at += len(counts)

    return run


def license_spans(docs: DataFrame) -> DataFrame:
    """``row, doc_id, n_words, template, label, base, first, last, cover``: merged diagonals of every text,
    with one row of template -1 for every text."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    sizes = tuple(sorted({GRAM, *(len(p.split()) for _, p in PHRASES)}))
    grams = texts.mapInArrow(_grams(sizes), "row long, doc_id long, n_words long, start long, gram long")
    templates = docs.sparkSession.createDataFrame(template_rows(), "gram long, template int, position int, label string, base boolean, grams int")
    votes = grams.join(F.broadcast(templates), "gram").withColumn("diagonal", F.col("start") - F.col("position"))
    keys = ["row", "doc_id", "n_words", "template", "label", "base", "grams"]
    lines = votes.groupBy(*keys, "diagonal").agg(F.bit_or(F.expr("shiftleft(1L, position)")).alias("covered"), F.min("start").alias("first"), F.max("start").alias("last"))
    across = Window.partitionBy(*keys).orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(across) > SLIP) | F.col("base")
    bands = lines.withColumn("_apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("band", F.sum("_apart").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*keys, "band").orderBy("first", "diagonal")
    beyond = F.col("first") > F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1)) + GAP
    spans = bands.withColumn("_beyond", F.coalesce(beyond, F.lit(True)).cast("int")).withColumn("span", F.sum("_beyond").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy(*keys, "band", "span").agg(F.bit_or("covered").alias("covered"), F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.withColumn("cover", F.bit_count("covered") / F.col("grams")).drop("band", "span", "covered", "grams")


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every document;
    ``score`` is the largest share of a template that a span covers."""
    spans = license_spans(docs)
    real, base = F.col("template") >= 0, F.col("base")
    found = base | (real & (F.col("cover") >= SHARE))
    listed = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        listed(base).alias("base_labels"), listed(found).alias("labels"), F.max(F.when(real, F.col("cover")).otherwise(0.0)).alias("score"),
    ).drop("row")
