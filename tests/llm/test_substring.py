import hashlib
import random
import re

import pytest

from markloom.llm.substring import COVERS, cover_of, cut_repeats
from tests.llm.conftest import CLASHING, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows, window):
    last = (1 << 63) - 1
    texts = [(last if r[0] is None else r[0], WORD.findall(r[1] or "")) for r in rows]
    first = {}
    for doc_id, words in texts:
        for i in range(len(words) - window + 1):
            key = hashlib.md5(" ".join(words[i : i + window]).encode()).digest()
            first[key] = min(first.get(key, last + 1), doc_id)
    out = []
    for (doc_id, words), row in zip(texts, rows, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if first[hashlib.md5(" ".join(words[i : i + window]).encode()).digest()] < doc_id:
                gone.update(range(i, i + window))
        out.append((str(row[0]), len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out)


def check(docs, rows, window=13):
    found = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in cut_repeats(docs, window).collect())
    assert found == expected(rows, window)


@pytest.mark.parametrize("period", COVERS)
def test_covers_hold_every_difference(period):
    assert {(a - b) % period for a in COVERS[period] for b in COVERS[period]} == set(range(period))
    assert cover_of(13) == (7, (0, 1, 3), 7)


@pytest.mark.parametrize("batch", [7, 10_000])
def test_random_texts(docs_of, spark, batch):
    rng = random.Random(6)
    passages = [[rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(rng.randint(10, 40))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 30))]
        rows.append((rng.randint(0, 10**6), rng.choice([" ", "\n", " \t "]).join(words)))
    rows += rows[:5] + [(r[0] + 1, r[1]) for r in rows[5:12]] + odd_rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        check(docs_of(rows, **CLASHING), rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table_and_other_window(docs_of):
    assert cut_repeats(docs_of([])).collect() == []
    rows = [(2, "a b c d e f g"), (1, "x c d e f y"), (3, "c d e")]
    check(docs_of(rows), rows, 3)
