"""Language of spans of text: script ranges narrow the candidates, then Viterbi over word scores.

A word is a run of letters of one script.  Its score in a language is the sum of log-probabilities of its
hashed 1- to 4-letter pieces and of itself, divided by the number of piece lengths; languages that hardly use
its script are no candidates.  The best path of languages through a text, with a penalty for every switch,
labels its words; equal neighbours make spans.  A document's language is the one with most letters.

Learning counts pieces over a bounded sample: the SAMPLE documents of each language with the smallest hash.
Counts are summed by Spark; the model, whose size is the number of languages times SLOTS, goes to the tasks.
Every whole text is labelled; paths of all texts of a block advance together, word by word.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and no span; so is every text if
nothing could be learnt; words of a script that no learnt language uses count for all languages alike; ties go
to the language that is first in code-point order; rows with a null id aren't learnt from; repeated rows are
labelled each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.llm.common import body
from markloom.llm.scripts import SCRIPTS, Words, word_runs
from markloom.llm.words import mix, text_column

SLOTS, LENGTHS, SAMPLE = 1 << 16, 4, 2000
SMOOTH, SCRIPT_SHARE, SWITCH, EXCLUDED = 0.5, 0.01, 8.0, -50.0
UNKNOWN = "und"
SPAN = "array<struct<start:int,end:int,lang:string>>"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's language may not be learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # SLOTS by languages
    candidates: np.ndarray  # scripts by languages


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal words, and the set of every word."""
    powers = np.cumprod(np.append(np.uint64(1), np.full(max(len(words.points) - 1, 0), _BASE)), dtype=np.uint64)
    backwards = powers[::-1][: len(words.points)]
    sums = np.append(np.uint64(0), np.cumsum(mix(words.points + np.uint64(1)) * backwards, dtype=np.uint64))
    # The last code point of a word is brought to the same power wherever the word stands.
    hashes = (sums[words.ends] - sums[words.starts]) * powers[words.ends - 1] + mix((words.ends - words.starts).astype(np.uint64))
    _, first, own = np.unique(hashes, return_index=True, return_inverse=True)
    return first, own


def pieces(words: Words, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the pieces of some words, with the number of the word each belongs to."""
    size = words.ends[some] - words.starts[some] + 2
    ends = np.cumsum(size)
    own = np.repeat(np.arange(len(some)), size)
    place = np.arange(len(own)) - (ends - size)[own]
    inner = (place > 0) & (place < size[own] - 1)
    points = np.zeros(len(own), np.uint64)
    points[inner] = words.points[words.starts[some][own[inner]] + place[inner] - 1] + np.uint64(1)
    slots, owner, rolled = [], [], np.zeros(len(own), np.uint64)
    for n in range(1, LENGTHS + 1):
        live = len(own) - n + 1
        if live <= 0:
            break
        rolled = mix(rolled[:live] * _BASE + points[n - 1 :] + np.uint64(n))
        fits = (place[:live] + n <= size[own[:live]]) & (inner[:live] if n == 1 else True)
        slots.append(rolled[fits])
        owner.append(own[:live][fits])
    sums = np.append(np.uint64(0), np.cumsum(points * mix(place.astype(np.uint64) + np.uint64(7)), dtype=np.uint64))
    slots.append(mix(sums[ends] - sums[ends - size] + size.astype(np.uint64)))
    owner.append(np.arange(len(some)))
    return (np.concatenate(slots) & np.uint64(SLOTS - 1)).astype(np.int64), np.concatenate(owner)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a partition's texts: pieces by slot, then letters by script."""
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in set(langs.tolist()):
            own = found.setdefault(lang, np.zeros(SLOTS + len(SCRIPTS), np.int64))
            for words in word_runs(text_column(batch).filter(pa.array(langs == lang))):
                if not len(words.starts):
                    continue
                first, of = _distinct(words)
                times = np.bincount(of)
                slots, owner = pieces(words, first)
                own[:SLOTS] += np.bincount(slots, times[owner], SLOTS).astype(np.int64)
                own[SLOTS:] += np.bincount(words.script, words.ends - words.starts, len(SCRIPTS)).astype(np.int64)
    for lang, own in found.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "slot", "n"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of a bounded sample of the rows that have a language and aren't held out."""
    order = F.xxhash64(F.lit(11), "doc_id", "text").alias("order")
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", order, "text")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    some = usable.select("lang", "order").distinct().withColumn("nth", nth).filter(F.col("nth") <= sample)
    # At most ``sample`` rows a language; equal texts of one id count once.
    texts = usable.join(F.broadcast(some.select("lang", "order")), ["lang", "order"]).groupBy("lang", "order").agg(F.first("text").alias("text"))
    sums = texts.select("lang", "text").mapInArrow(_counts, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    if not sums.num_rows:
        return None
    lang = np.array(sums.column("lang").to_pylist(), object)
    languages = sorted(set(lang.tolist()), key=lambda x: x.encode())
    table = np.zeros((SLOTS + len(SCRIPTS), len(languages)))
    table[sums.column("slot").to_numpy(), [languages.index(x) for x in lang]] = sums.column("n").to_numpy()
    known, letters = table[:SLOTS], table[SLOTS:]
    scores = np.log((known + SMOOTH) / (known.sum(axis=0) + SMOOTH * SLOTS))
    return Model(languages, scores.astype(np.float32), letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1))


def word_scores(model: Model, words: Words, first: np.ndarray) -> np.ndarray:
    """Scores of distinct words in every language."""
    slots, owner = pieces(words, first)
    scores = np.stack([np.bincount(owner, model.scores[slots, k], len(first)) for k in range(len(model.languages))], axis=1) / LENGTHS
    able = model.candidates[words.script[first]]
    able[~able.any(axis=1)] = True
    scores -= scores.max(axis=1, keepdims=True)
    return np.where(able, scores, EXCLUDED + scores.min(axis=1, keepdims=True))


def best_paths(scores: np.ndarray, code: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The language of every word on the best path through its text; all texts advance together."""
    langs, n = scores.shape[1], len(code)
    firsts = np.cumsum(counts) - counts
    by_length = np.argsort(-counts, kind="stable")
    firsts, lengths = firsts[by_length], counts[by_length]
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
    stays, came = np.zeros((n, langs), bool), np.zeros(n, np.int16)
    state, rows = np.zeros((len(counts), langs)), np.arange(len(counts))
    for t, m in enumerate(active.tolist()):
        at = firsts[:m] + t
        before = state[:m]
        top = before.argmax(axis=1)
        switched = before[rows[:m], top] - penalty
        stays[at], came[at] = before >= switched[:, None], top
        state[:m] = np.maximum(before, switched[:, None]) + scores[code[at]]
    label, now = np.zeros(n, np.int16), state.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        at = firsts[: active[t]] + t
        own = now[: active[t]]
        label[at] = own
        now[: active[t]] = np.where(stays[at, own], own, came[at])
    return label


def _label(model: Model | None, spans: bool):
    names = np.array([*model.languages, UNKNOWN], object) if model else np.array([UNKNOWN], object)

    def of_run(words: Words) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
        n_texts, n_langs = len(words.counts), len(names) - 1
        if not n_langs or not len(words.starts):
            return np.full(n_texts, n_langs), np.zeros(n_texts), [[] for _ in range(n_texts)]
        first, code = _distinct(words)
        scores = word_scores(model, words, first)
        label = best_paths(scores, code, words.counts, SWITCH)
        text, size = np.repeat(np.arange(n_texts), words.counts), words.ends - words.starts
        letters = np.bincount(text * n_langs + label, size, n_texts * n_langs).reshape(n_texts, n_langs)
        best = np.where(words.counts > 0, letters.argmax(axis=1), n_langs)
        chance = np.exp(scores)
        chance /= chance.sum(axis=1, keepdims=True)
        sure = np.bincount(text, size * chance[code, best[text]], n_texts) / np.maximum(letters.sum(axis=1), 1)
        found: list[list[dict]] = [[] for _ in range(n_texts)]
        if spans:
            cut = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (text[1:] != text[:-1])))
            for a, b in zip(cut.tolist(), [*(cut[1:] - 1).tolist(), len(label) - 1], strict=True):
                t = int(text[a])
                found[t].append({"start": int(words.starts[a] - words.heads[t]), "end": int(words.ends[b] - words.heads[t]), "lang": names[label[a]]})
        return best, np.clip(sure, 0, 1), found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for words in word_runs(text_column(batch)):
                best, sure, found = of_run(words)
                columns = [batch.column("doc_id").slice(at, len(best)), pa.array(names[best], pa.string()), pa.array(sure)]
                more = [pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))] if spans else []
                yield pa.RecordBatch.from_arrays([*columns, *more], ["doc_id", "lang_pred", "score", *["spans"] * spans])
                at += len(best)

    return run


def languages(docs: DataFrame, model: Model | None, spans: bool = True) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document and, if asked for, its ``spans`` in code points."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    return texts.mapInArrow(_label(model, spans), "doc_id long, lang_pred string, score double" + f", spans {SPAN}" * spans)


def language_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, learnt from the documents that aren't held out."""
    found = languages(docs, learn(docs), spans=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
