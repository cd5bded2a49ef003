"""Spelling variants: words one edit apart, found by composing vocabulary acceptors with a one-edit transducer.

Words are counted over all texts.  The composition of the minimised vocabulary acceptor, a one-edit transducer
and the acceptor again is cut by its initial states, so that each part is a task's work: after the first HEAD
code points both sides are in one state or the edit lies before it.  A word is therefore in one ``tail`` part
(words with its first HEAD code points; edits behind them) and two ``head`` parts (words with its ending
behind HEAD and behind HEAD + 1 code points; edits before).  Parts with more than MOST words are cut again one
code point further on: edits exactly at the cut have parts of their own (same beginning and same ending, at most one
word per letter and one more), later ones a longer common beginning.  No part can stay large, whatever
beginning or ending is frequent.  Where two words first differ is one place, and each kind of part answers for
other places, so every pair comes out once.

The most frequent near word, if at least TIMES as frequent, is a word's form.  Forms get ever more frequent,
so following them ends; pointers double per round.

Defined cases: null and empty texts hold no word; a null id counts as an empty one where runs are disturbed;
repeated rows count each; ties of frequency go to the smaller word in code-point order; an empty table gives
no rows; other columns are ignored; a run of any length is a word, and only a hash of its ending is dealt by.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.llm.automata import Acceptor
from markloom.llm.common import body, written

LETTER = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
HEAD, MOST = 3, 10_000


def lowered(run: Column) -> Column:
    """A-Z lower-cased, all other letters unchanged."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    marked = (F.octet_length(run) > F.char_length(run)) & run.rlike("[À-Þ]")
    return F.when(marked, F.translate(run, capitals, capitals.lower())).otherwise(F.lower(run))


def disturbed_runs(docs: DataFrame, least: int = LEAST_LENGTH, every: int = 31) -> DataFrame:
    """``word`` of every run of at least ``least`` code points; a run whose checksum with the document's id
    ``every`` divides has lost one code point."""
    long_enough = F.lit(f"{LETTER}{{{least},}}+")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(body(), long_enough, F.lit(0))).alias("run"))
    runs = runs.select("id", lowered(F.col("run")).alias("run"))
    summed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return summed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= least)


def vocabulary(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words that occur ``least`` times or more."""
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _ending(at: Column | int) -> Column:
    return F.substring(F.col("word"), F.lit(1) + at, F.char_length("word"))


def _beginning(at: Column | int) -> Column:
    return F.substring(F.col("word"), F.lit(1), F.lit(0) + at)


def _tails(words: DataFrame, at: int) -> DataFrame:
    key = F.xxhash64(F.lit(at), _beginning(at))
    return words.select(key.alias("key"), F.lit("tail").alias("kind"), F.lit(at).alias("at"), F.lit(False).alias("exact"), "word", "n")


def _heads(words: DataFrame) -> DataFrame:
    """Both head parts of a word; the kind tells how much of the word lies before the shared ending."""
    sides = [F.struct(F.xxhash64(F.lit(-1), _ending(at)).alias("key"), F.lit(kind).alias("kind")) for at, kind in ((HEAD, "head"), (HEAD + 1, "long"))]
    dealt = words.select(F.explode(F.array(*sides)).alias("p"), "word", "n")
    return dealt.select("p.key", "p.kind", F.lit(HEAD).alias("at"), F.lit(False).alias("exact"), "word", "n")


def _ats(dealt: DataFrame, at: int) -> DataFrame:
    """Of each part, the parts of words that share all but the code point at ``at``, or have none there."""
    sides = [F.xxhash64("key", F.lit(at), _beginning(at), _ending(end)) for end in (at, at + 1)]
    return dealt.select(F.explode(F.array(*sides)).alias("key"), "kind", F.lit(at).alias("at"), F.lit(True).alias("exact"), "word", "n")


def parts(words: DataFrame, most: int = MOST) -> DataFrame:
    """The words of every part, ``key, kind, at, exact, word, n``; only parts with one ``exact`` place, which
    hold at most one word per letter and one more, are not held to ``most`` rows."""

    def cut(dealt: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        large = written(dealt.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("key"), "large")
        if large.isEmpty():
            return dealt, None
        return dealt.join(large, "key", "left_anti").select(dealt.columns), written(dealt.join(large, "key", "left_semi").select(dealt.columns), "rest")

    found, rest = cut(_heads(words))
    if rest is not None:
        for at in range(HEAD):
            found = found.union(_ats(rest, at))
    at, left = HEAD, words
    while left is not None:
        some, rest = cut(_tails(left, at))
        found, left = found.union(some), None
        if rest is not None:
            found, left = found.union(_ats(rest, at)), rest.select("word", "n")
        at += 1
    return found


def _pairs_of_part(kinds: list[str], at: int, exact: bool, words: list[str]) -> Iterator[tuple[str, str]]:
    """The pairs of a part that it answers for: see ``parts``; two longer sides meet in another part."""
    kind = dict(zip(words, kinds, strict=True))
    for x, y in Acceptor(words).near_pairs():
        same = len(commonprefix((x, y)))
        if (kind[x] != "long" or kind[y] != "long") and (same == at if exact else kind[x] == "tail" or same < at):
            yield x, y


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of every part of a stream sorted by key and word, in both directions."""
    kept: list[pa.RecordBatch] = []

    def found() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(kept)
        keys = table.column("key").to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
        many = np.flatnonzero(np.diff(edges) > 1)
        out: list[tuple[str, str, int]] = []
        for a, b in zip(edges[many].tolist(), edges[many + 1].tolist(), strict=True):
            part = table.slice(a, b - a)
            words = part.column("word").to_pylist()
            n = dict(zip(words, part.column("n").to_pylist(), strict=True))
            for x, y in _pairs_of_part(part.column("kind").to_pylist(), part.column("at")[0].as_py(), part.column("exact")[0].as_py(), words):
                out += [(x, y, n[y]), (y, x, n[x])]
            if len(out) > 50_000:
                yield rows(out)
                out = []
        yield rows(out)

    def rows(out: list[tuple[str, str, int]]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["word", "near", "near_n"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column("key").to_numpy()
        last = int(np.flatnonzero(keys == keys[-1])[0])
        if last or (kept and kept[-1].column("key")[0].as_py() != keys[0]):
            kept.append(batch.slice(0, last))
            yield from found()
            kept = []
        kept.append(batch.slice(last))
    if kept:
        yield from found()


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """``word, near, near_n`` of every ordered pair of words that one edit parts; ``words`` is a table."""
    dealt = parts(words, most).repartition("key").sortWithinPartitions("key", "word")
    return dealt.mapInArrow(_near, "word string, near string, near_n long")


def variants(words: DataFrame, times: int = TIMES, most: int = MOST) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of a table ``word, n``."""
    near = near_words(words, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(near, "word", "left")
    formed = -F.col("best.less") >= times * F.col("n")
    found = written(
        found.select("word", F.when(formed, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, -F.col("best.less")).alias("form_n")), "forms"
    )
    roots = written(found.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        stepped = written(roots.join(up, "root", "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "roots")
        roots = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            break
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants of all words of whole texts."""
    return variants(written(vocabulary(disturbed_runs(docs)), "vocabulary"))
