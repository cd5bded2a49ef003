import collections
import math
import re

from markloom.llm import quality as Q
from tests.llm.conftest import CLASHING, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = collections.Counter(grams)
    inside = {p for i, g in enumerate(grams) if counts[g] > 1 for p in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    part = lambda a, m: a * math.log2(a / m) if a else 0.0
    return math.sqrt(sum(part(a, (a + b) / 2) + part(b, (a + b) / 2) for a, b in zip(p, q, strict=True)) / 2)


def check(found, rows):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert got == sorted((str(r[0]), *expected(r[1])) for r in rows)
    assert not any(r.kept and r.base_failed for r in found)


def test_whole_table(docs_of, spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + odd_rows()
    rows += [(900, "a b c a b c a b c d"), (901, "a a a a"), (902, "x\n\n x\nx\n x\r\n y z\n"), (903, "a b c d a b c e b c d")]
    check(Q.quality(docs_of(rows, **CLASHING)).collect(), rows)


def test_distance_and_verdict(docs_of):
    prose = "the cat and the dog of this house was in a garden by the sea with that bird on it "
    junk = "qzx## vvk%% jjw&& zzq** xxk$$ "
    rows = [(i, " ".join(f"{w} tree{chr(97 + k % 26)}{chr(97 + k // 26)}" for k, w in enumerate((prose * 4).split()))) for i in range(40)]
    rows += [(100, " ".join(f"{w}{k}" for k, w in enumerate((junk * 30).split())))]
    docs = docs_of(rows)
    found = {r.doc_id: r for r in Q.quality(docs).collect()}
    assert not found[100].kept and all(found[i].kept for i in range(40))
    parts = {r.doc_id: r for r in Q.features(docs).collect()}
    sums = [sum(x) for x in zip(*(r.classes for r in parts.values() if not r.base_failed), strict=True)]
    assert abs(found[3].class_distance - distance(parts[3].classes, sums)) < 1e-9
    assert sum(parts[3].classes) == len(rows[3][1]) and sum(parts[3].common) == parts[3].n_words


def test_empty_table(docs_of):
    assert Q.quality(docs_of([])).collect() == []


def test_rare_languages_are_judged_by_the_smoothed_reference(docs_of):
    from pyspark.sql import functions as F

    prose = "the cat and the dog of this house was in a garden by the sea with that bird on it "
    junk = " ".join(f"qzx{k}## VVK%%" for k in range(200))
    rows = [(i, " ".join(f"{w} tree{chr(97 + k % 26)}{chr(97 + k // 26)}" for k, w in enumerate((prose * 4).split()))) for i in range(40)] + [(100, junk)]
    for lang in (None, "rare"):
        docs = docs_of(rows).withColumn("lang", F.when(F.col("doc_id") == 100, F.lit(lang)).otherwise(F.lit("en")))
        found = {r.doc_id: r for r in Q.quality(docs).collect()}
        assert not found[100].kept and found[100].class_distance > 0.25 and found[3].kept
    parts = {r.doc_id: r for r in Q.features(docs).collect()}
    en = [sum(x) for x in zip(*(parts[i].classes for i in range(40)), strict=True)]
    both = [a + b for a, b in zip(en, parts[100].classes, strict=True)]
    smooth = [a + Q.PRIOR * c / 41 for a, c in zip(parts[100].classes, both, strict=True)]
    assert abs(found[100].class_distance - distance(parts[100].classes, smooth)) < 1e-9


def test_classes_part_all_characters(docs_of):
    texts = ["aAbB1 ,#\n\té€Ω漢\U0001F600-ÿɏͰ￿", "", "aaa", "\x00\x7f"]
    for r in Q.features(docs_of(list(enumerate(texts)))).collect():
        want = [len(re.findall(f"[{c}]", texts[r.doc_id])) for c in Q.CLASSES]
        assert r.classes == [*want, len(texts[r.doc_id]) - sum(want)]
