import math
import random
import zlib

import numpy as np
import pyarrow as pa

from markloom.llm import toxicity as X
from markloom.llm.toxicity import clean, toxicity
from tests.llm.conftest import CLASHING, odd_rows


def labelled(n, seed):
    """Toxic if an insult meets a group; either alone is harmless, so weights that only add must fail."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(5, 40))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["vermin"] * insult + ["neighbours"] * group + ["harmless"] * (not insult) + ["people"] * (not group)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(insult and group)))
    return rows, labels


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    n = sum(labels)
    return (order[np.array(labels) == 1].sum() - n * (n - 1) / 2) / (n * (len(labels) - n))


def test_pairs_are_learnt_and_held_out_rows_judged(docs_of, spark):
    rows, labels = labelled(1500, 4)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity(docs_of(rows + [(10_000 + i, t) for i, t in odd_rows_texts()], **CLASHING), table).collect()
    truth = {i: t for i, _, t in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert auc([r.score for r in held], [truth[r.doc_id] for r in held]) > 0.95


def odd_rows_texts():
    return [(i, r[1]) for i, r in enumerate(odd_rows())]


def test_held_out_labels_do_not_matter(docs_of, spark):
    rows, labels = labelled(300, 5)
    flipped = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels]
    docs = docs_of(rows)
    one, two = (sorted((r.doc_id, r.score) for r in toxicity(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, flipped))
    assert one == two


def test_without_labels_and_empty(docs_of, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of(odd_rows(), **CLASHING)
    assert {r.score for r in toxicity(docs, none).collect()} == {0.0}
    assert clean(docs, none).count() == len(odd_rows()) and clean(docs, none).columns == docs.columns
    assert toxicity(docs_of([]), none).collect() == []


def test_sample_table(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    held = found.filter("held_out").join(labels.dropDuplicates(["doc_id"]), "doc_id").collect()
    assert auc([r.score for r in held], [r.toxic for r in held]) > 0.9


def plain_training(examples, labels, seed=4):
    """The machine in plain loops: pairs one by one, Adagrad entry by entry."""
    rng = np.random.default_rng(seed)
    seen_in = {}
    for e in examples:
        for s in e:
            seen_in[s] = seen_in.get(s, 0) + 1
    least = min(max(X.LEAST_SHARE * len(examples), X.LEAST_SEEN[0]), X.LEAST_SEEN[1])
    examples = [[s for s in e if seen_in[s] >= least] for e in examples]
    start = rng.normal(0, 0.02, (X.BUCKETS, X.FACTORS))
    bias, weight, factor = [0.0], {}, {}
    sum_bias, sum_weight, sum_factor = [1e-3], {}, {}
    for s in seen_in:
        weight[s], sum_weight[s], factor[s], sum_factor[s] = 0.0, 1e-3, list(start[s]), [1e-3] * X.FACTORS

    def raw(e):
        pairs = sum(factor[a][f] * factor[b][f] for i, a in enumerate(e) for b in e[i + 1 :] for f in range(X.FACTORS))
        return bias[0] + sum(weight[s] for s in e) + pairs / max(len(e), 1) ** 0.5

    share = sum(labels) / len(labels)
    for _ in range(X.EPOCHS):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), X.BATCH):
            some = order[at : at + X.BATCH]
            slope = {i: (1 / (1 + math.exp(-raw(examples[i]))) - labels[i]) * (0.5 / share if labels[i] else 0.5 / (1 - share)) / len(some) for i in some}
            used = sorted({s for i in some for s in examples[i]})
            g_weight = {s: sum(slope[i] for i in some if s in examples[i]) + X.DECAY_WEIGHT * weight[s] for s in used}
            g_factor = {
                s: [sum(slope[i] / len(examples[i]) ** 0.5 * sum(factor[o][f] for o in examples[i] if o != s) for i in some if s in examples[i]) + X.DECAY_FACTOR * factor[s][f] for f in range(X.FACTORS)]
                for s in used
            }
            g_bias = sum(slope.values())
            sum_bias[0] += g_bias**2
            bias[0] -= X.RATE * g_bias / sum_bias[0] ** 0.5
            for s in used:
                sum_weight[s] += g_weight[s] ** 2
                weight[s] -= X.RATE * g_weight[s] / sum_weight[s] ** 0.5
                for f in range(X.FACTORS):
                    sum_factor[s][f] += g_factor[s][f] ** 2
                    factor[s][f] -= X.RATE * g_factor[s][f] / sum_factor[s][f] ** 0.5
    return [1 / (1 + math.exp(-raw(e))) for e in examples]


def test_training_and_scores_against_plain_loops(monkeypatch):
    monkeypatch.setattr(X, "STEPS", 0)
    monkeypatch.setattr(X, "EPOCHS", 2)
    monkeypatch.setattr(X, "BATCH", 8)
    rows, labels = labelled(60, 9)
    texts = pa.array([t for _, t in rows], pa.large_string())
    [(slots, counts)] = X.term_sets(texts)
    examples = np.split(slots, np.cumsum(counts)[:-1])
    want = plain_training([e.tolist() for e in examples], [t for _, _, t in labels])
    model = X.train(examples, np.array([t for _, _, t in labels], float))
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    [out] = X._score(model, "score")(iter([batch]))
    assert np.allclose(out.column("score").to_numpy(), want, rtol=1e-9)


def test_conflicting_labels_and_repeated_ids(docs_of, spark):
    rows, labels = labelled(300, 6)
    schema = "doc_id long, quality int, toxic int"
    both = [(i, 1, x) for i in range(0, 300, 3) for x in (0, 1)]
    apart = [x for x in labels if x[0] % 3]
    one = toxicity(docs_of(rows + rows[:50] * 20), spark.createDataFrame(apart + both, schema)).select("doc_id", "score").distinct()
    two = toxicity(docs_of(rows), spark.createDataFrame(apart, schema)).select("doc_id", "score")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
