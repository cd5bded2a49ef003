import itertools
import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest

from markloom.llm import language as L
from markloom.llm import scripts
from tests.llm.conftest import CLASHING, odd_rows

ENGLISH = "the house of this thing that was on it with and from there which would have been"
FRENCH = "la maison des choses est dans une ville avec les enfants qui sont sur la route"
RUSSIAN = "этот дом стоит на улице где живут люди которые любят читать"


def plain_words(text):
    """Maximal runs of letters of one script, marks going with the letter before."""
    found, last, kind = [], None, None
    kinds, _ = scripts.tables()
    for i, c in enumerate(text):
        category = unicodedata.category(c)[0]
        own = kind if category == "M" and kind else kinds[ord(c)] if category == "L" else None
        if own is not None and own == kind and last == i - 1:
            found[-1][1] = i + 1
        elif own is not None:
            found.append([i, i + 1])
        last, kind = (i, own) if own is not None else (None, None)
    return [tuple(x) for x in found]


def test_words_are_runs_of_one_script():
    rng = random.Random(3)
    texts = ["", "abc", "a1b", "ét́", "́x", "latinрусский漢字かな", " ", "ÀÖ×ÿ", "x" * 50]
    texts += ["".join(rng.choice("ab é1 ж漢́\n") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    at = 0
    for words in scripts.word_runs(pa.array(texts, pa.large_string())):
        ends = np.cumsum(words.counts)
        for i, (a, b) in enumerate(zip(ends - words.counts, ends, strict=True)):
            head = words.heads[i]
            assert [(int(x - head), int(y - head)) for x, y in zip(words.starts[a:b], words.ends[a:b], strict=True)] == plain_words(texts[at + i])
        at += len(words.counts)
    assert at == len(texts)


def test_equal_words_are_found_wherever_they_stand():
    texts = ["one two one", "two", "enO ONE eno", "", "twone"]
    [words] = scripts.word_runs(pa.array(texts, pa.large_string()))
    _, code = L._distinct(words)
    plain = ["".join(map(chr, words.points[a:b])) for a, b in zip(words.starts, words.ends, strict=True)]
    assert plain == ["one", "two", "one", "two", "eno", "one", "eno", "twone"]
    assert all((x == y) == (a == b) for (x, a), (y, b) in itertools.combinations(zip(plain, code.tolist(), strict=True), 2))


def test_pieces():
    [words] = scripts.word_runs(pa.array(["abca abca zz"], pa.large_string()))
    slots, owner = L.pieces(words, np.arange(3))
    of = [sorted(slots[owner == i].tolist()) for i in range(3)]
    # 1 to 4 letters of ^abca$ (the bare marks don't count), and the word itself.
    assert [len(x) for x in of] == [4 + 5 + 4 + 3 + 1, 17, 2 + 3 + 2 + 1 + 1] and of[0] == of[1] and not set(of[0]) & set(of[2])


@pytest.mark.parametrize("penalty", [0.0, 1.0, 3.0])
def test_best_paths_against_all_paths(penalty):
    rng = np.random.default_rng(int(penalty))
    counts = np.array([0, 5, 1, 6, 0, 3])
    scores = rng.normal(size=(8, 3)) * 3
    code = rng.integers(0, 8, counts.sum())
    label, at = L.best_paths(scores, code, counts, penalty), 0
    for n in counts:
        own = code[at : at + n]
        worth = lambda path, own=own: sum(scores[c, k] for c, k in zip(own, path, strict=True)) - penalty * sum(a != b for a, b in itertools.pairwise(path))
        best = max((worth(p) for p in itertools.product(range(3), repeat=int(n))), default=0)
        assert worth(label[at : at + n].tolist()) == pytest.approx(best)
        at += n


def model_of(docs_of):
    rows = [(i, " ".join(random.Random(i).choices((ENGLISH, FRENCH, RUSSIAN)[i % 3].split(), k=30))) for i in range(120)]
    docs = docs_of(rows)
    from pyspark.sql import functions as F

    return L.learn(docs.withColumn("lang", F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "ru")]), (F.col("doc_id") % 3 + 1).cast("int"))))


def test_spans_of_mixed_text(docs_of):
    model = model_of(docs_of)
    assert model.languages == ["en", "fr", "ru"]
    assert model.candidates[scripts.SCRIPTS.index("latin")].tolist() == [True, True, False]
    text = f"{ENGLISH}. {FRENCH}, {RUSSIAN}! {ENGLISH}"
    rows = [(101, text), (102, "12 !"), (103, None), (104, ""), (105, "漢字"), (106, "the дом"), *odd_rows()]
    found = {}
    for r in L.languages(docs_of(rows, **CLASHING), model).collect():
        found[r.doc_id] = r
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not r.spans)
    assert [(text[s.start : s.end].split()[0], s.lang) for s in found[101].spans] == [("the", "en"), ("la", "fr"), ("этот", "ru"), ("the", "en")]
    assert "".join(text[s.start : s.end] for s in found[101].spans) == text.replace(". ", "").replace(", ", "").replace("! ", "")
    assert found[102].lang_pred == "und" and found[102].score == 0
    assert [(s.start, s.end, s.lang) for s in found[106].spans] == [(0, 3, "en"), (4, 7, "ru")]


def test_nothing_learnt_and_empty_table(docs_of):
    from pyspark.sql import functions as F

    rows = odd_rows()
    docs = docs_of(rows).withColumn("lang", F.lit(None).cast("string"))
    found = L.language_digest(docs).collect()
    assert len(found) == len(rows) and {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}
    assert L.language_digest(docs_of([])).collect() == []


def test_held_out_accuracy_and_determinism(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.language_digest(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(found) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    apart = [r for r in found if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in apart) / len(apart) > 0.98
    again = L.language_digest(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in found) == sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in again)


def test_one_text_many_times_is_learnt_once(docs_of):
    rows = [(1, f"{ENGLISH} {i}") for i in range(3)] + [(2, FRENCH)] * 200
    one, many = L.learn(docs_of(rows)), L.learn(docs_of(rows[:4]))
    assert (one.scores == many.scores).all()
