"""Toxicity scores from a factorization machine over hashed terms.

A text is the set of its lower-cased letter runs, hashed into BUCKETS slots.  The score is the logistic
function of ``bias + sum of weights + sum over pairs of terms of the dot product of their factors``: the
pairs let an insult count for more next to a mention of whom it hits, which added weights can't express.
Terms are weighted by ``1 / sqrt(number of terms)`` in the pair part, so long texts don't drown it.

Learning takes a bounded sample: the SAMPLE labelled rows with the smallest hash of their id, of each class
at most half.  One task trains on the hashed terms (bounded by SAMPLE rows of at most TERMS slots each; a
text with more terms has its rows split, as further examples of the same label) and writes the model, of
fixed size, which scoring tasks get in their closure.  Every whole text is scored; labels, lang, source and
doc_id never enter a score.

Defined cases: null and empty texts get the score of the bias alone, repeated rows equal scores; rows with a
null id count as held out; an id with both labels is not learnt from; of several texts of one id the first in
code-point order is; without any usable label the score is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markloom.llm.common import body, free_name, written
from markloom.llm.words import mix, released, text_column, token_blocks

BUCKETS, FACTORS = 1 << 18, 4
SAMPLE, TERMS = 24_000, 2048
RATE, DECAY_WEIGHT, DECAY_FACTOR = 0.1, 1e-2, 1e-3
#: Passes over the sample: at least so many, and so many batches in all.
EPOCHS, STEPS, BATCH = 8, 800, 64
#: A slot takes part if it occurs in so large a share of the examples (between 5 and 20 of them).
LEAST_SHARE, LEAST_SEEN = 0.002, (5, 20)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's labels may not be learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def term_sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct term slots of runs of texts, one text after another, with the number in each text."""
    for hashes, counts in token_blocks(texts):
        text = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
        slot = (mix(hashes) & np.uint64(BUCKETS - 1)).astype(np.int64)
        both = np.unique(text * BUCKETS + slot)
        yield both % BUCKETS, np.bincount(both // BUCKETS, minlength=len(counts))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, at = batch.column("toxic"), 0
        for slots, counts in term_sets(text_column(batch)):
            ends = np.cumsum(counts)
            for i, (a, b) in enumerate(zip(ends - counts, ends, strict=True)):
                parts = [slots[x : min(x + TERMS, b)].astype(np.int32) for x in range(a, max(b, a + 1), TERMS)]
                yield pa.RecordBatch.from_arrays([pa.array([labels[at + i].as_py()] * len(parts), pa.int32()), pa.array([p.tolist() for p in parts], pa.list_(pa.int32()))], ["toxic", "slots"])
            at += len(counts)


def _forward(model: dict[str, np.ndarray], slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Raw scores of texts, the factor sums and the scale of each text."""
    heads = np.cumsum(counts) - counts
    scale = 1 / np.sqrt(np.maximum(counts, 1))
    full = counts > 0
    linear, sums, squares = np.zeros(len(counts)), np.zeros((len(counts), FACTORS)), np.zeros((len(counts), FACTORS))
    if full.any():
        factors = model["factors"][slots]
        at = heads[full]
        linear[full] = np.add.reduceat(model["weights"][slots], at)
        sums[full] = np.add.reduceat(factors, at, axis=0)
        squares[full] = np.add.reduceat(factors * factors, at, axis=0)
    raw = model["bias"][0] + linear + 0.5 * scale * (sums * sums - squares).sum(axis=1)
    return raw, sums, scale


def train(examples: list[np.ndarray], labels: np.ndarray, seed: int = 4) -> dict[str, np.ndarray]:
    """Adagrad over shuffled batches; classes weigh alike."""
    rng = np.random.default_rng(seed)
    seen_in = np.bincount(np.concatenate(examples) if examples else np.zeros(0, np.int64), minlength=BUCKETS)
    least = min(max(LEAST_SHARE * len(examples), LEAST_SEEN[0]), LEAST_SEEN[1])
    known = seen_in >= least
    examples = [e[known[e]] for e in examples]
    model = {"bias": np.zeros(1), "weights": np.zeros(BUCKETS), "factors": rng.normal(0, 0.02, (BUCKETS, FACTORS))}
    seen = {k: np.full_like(v, 1e-3) for k, v in model.items()}
    share = max(labels.mean(), 1e-6), max(1 - labels.mean(), 1e-6)
    importance = np.where(labels > 0, 0.5 / share[0], 0.5 / share[1])
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(len(examples), 1)))):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            counts = np.array([len(examples[i]) for i in some])
            slots = np.concatenate([examples[i] for i in some])
            raw, sums, scale = _forward(model, slots, counts)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]) * importance[some] / len(some)
            text = np.repeat(np.arange(len(some)), counts)
            used, back = np.unique(slots, return_inverse=True)
            g_weights = np.bincount(back, slope[text], len(used)) + DECAY_WEIGHT * model["weights"][used]
            each = (slope * scale)[text, None] * (sums[text] - model["factors"][slots])
            g_factors = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(FACTORS)], axis=1) + DECAY_FACTOR * model["factors"][used]
            for name, rows, grad in (("bias", slice(None), np.array([slope.sum()])), ("weights", used, g_weights), ("factors", used, g_factors)):
                seen[name][rows] += grad * grad
                model[name][rows] -= RATE * grad / np.sqrt(seen[name][rows])
    model["weights"][~known] = np.nan
    return model


def _train_group(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["toxic", "order"], kind="stable")
    model = train([np.asarray(s, np.int32) for s in group["slots"]], group["toxic"].to_numpy(float))
    flat = np.concatenate([model["bias"], model["weights"], model["factors"].ravel()]).astype("<f4")
    return pd.DataFrame({"model": [flat.tobytes()]})


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """The model of a bounded sample of the labelled rows that are not held out."""
    usable = labels.filter(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most")
    draw = usable.withColumn("order", F.xxhash64(F.lit(4), "doc_id"))
    part = draw.filter("toxic = 1").orderBy("order", "doc_id").limit(sample // 2).union(draw.filter("toxic = 0").orderBy("order", "doc_id").limit(sample // 2))
    texts = docs.select("doc_id", body().alias("text")).join(F.broadcast(part.select("doc_id", "toxic")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    examples = texts.select("text", "toxic").mapInArrow(released(_terms), "toxic int, slots array<int>")
    keyed = examples.withColumn("order", F.xxhash64("slots")).withColumn("one", F.lit(1))
    found = written(keyed.groupBy("one").applyInPandas(_train_group, "model binary"), "toxicity").collect()
    if not found:
        return None
    flat = np.frombuffer(found[0]["model"], "<f4").astype(np.float64)
    return {"bias": flat[:1], "weights": flat[1 : 1 + BUCKETS], "factors": flat[1 + BUCKETS :].reshape(BUCKETS, FACTORS)}


def _score(model: dict[str, np.ndarray] | None, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for slots, counts in term_sets(text_column(batch)):
                if model is None:
                    scores.append(np.zeros(len(counts)))
                    continue
                known = ~np.isnan(model["weights"][slots])
                text = np.repeat(np.arange(len(counts)), counts)[known]
                raw, _, _ = _forward(model, slots[known], np.bincount(text, minlength=len(counts)))
                scores.append(1 / (1 + np.exp(-np.clip(raw, -60, 60))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores), pa.float64())], [*batch.schema.names, name])

    return run


def with_scores(docs: DataFrame, labels: DataFrame, name: str, sample: int = SAMPLE) -> DataFrame:
    """The rows with their score as a further column of the given name."""
    model = learn(docs, labels, sample)
    if model is not None:
        model = {k: v.astype(np.float32) for k, v in model.items()}
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(released(_score(model, name)), schema)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with the input's columns."""
    score = free_name(docs, "score")
    return with_scores(docs, labels, score).filter(F.col(score) < threshold).drop(score)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    return with_scores(docs.select("doc_id", "text"), labels, "score").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
