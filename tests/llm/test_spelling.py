import collections
import random
import re
import zlib

import pytest

from markloom.llm import spelling as S
from markloom.llm.automata import Acceptor
from markloom.llm.common import written
from tests.llm.conftest import CLASHING, odd_rows

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    n = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(CAPITALS)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            n[word] += len(word) >= 7
    return {w: c for w, c in n.items() if c >= 2}


def expected(n):
    near_of = {w: [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)] for w in n}
    form = {}
    for w, others in near_of.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, str(form.get(w)), root(w), n[w], len(near_of[w]), str(n[form[w]] if w in form else None)) for w in n)


def rows_of(df):
    return sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in df.collect())


def test_acceptor_against_brute_force():
    for seed in range(300):
        rng = random.Random(seed)
        letters = "ab" if seed % 2 else "abcé"
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 60))})
        found = [tuple(sorted(p)) for p in Acceptor(words).near_pairs()]
        assert len(found) == len(set(found))
        assert set(found) == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)}


def test_acceptor_shares_endings_and_takes_deep_words():
    assert len(Acceptor([f"{x}{y}ending" for x in "abcdefgh" for y in "abcdefgh"]).final) == 3
    deep = ["a" * i for i in range(1, 3000)]
    assert sum(1 for _ in Acceptor(deep).near_pairs()) == len(deep) - 1


@pytest.mark.parametrize("most", [3, 40, 10_000])
def test_parts_of_any_size_give_every_pair_once(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choice("abx") for _ in range(rng.randint(7, 9))) for _ in range(500)}
    words |= {"same" + "".join(rng.choice("ab") for _ in range(rng.randint(3, 6))) for _ in range(100)}
    words |= {"".join(rng.choice("abcd") for _ in range(rng.randint(3, 4))) + "ending" for _ in range(200)} | {"q" * i for i in range(7, 15)}
    table = written(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), "words")
    found = [(r.word, r.near) for r in S.near_words(table, most).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and near(a, b)}
    if most == 3:
        assert S.parts(table, most).filter("not exact").groupBy("key").count().filter(f"count > {most}").isEmpty()


def test_whole_table(docs_of, spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + odd_rows()
    rows += [(900, "planette " * 2 + "planetted " * 25 + "planettede " * 300 + "ÀPLANET àplanet Àplanet ÀPLANET ×÷×÷×÷×÷ ×÷×÷×÷×÷"), (901, "Ab" * 3000 + " " + "ab" * 3000)]
    docs = docs_of(rows, **CLASHING)
    assert rows_of(S.spelling_variants(docs)) == expected(counted(rows))


def test_chain_ties_and_empty(docs_of, spark):
    n = {"abcdefg": 2, "abcdefgh": 30, "abcdefghi": 400, "abcdefghj": 400, "zbcdefgh": 2, "zzzzzzz": 5}
    table = written(spark.createDataFrame(list(n.items()), "word string, n long"), "words")
    assert rows_of(S.variants(table)) == expected(n)
    assert S.spelling_variants(docs_of([])).collect() == [] == S.spelling_variants(docs_of([(1, None), (2, "")])).collect()
