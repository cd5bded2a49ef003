import re

from markloom.llm.licenses import NOTICES, license_scan
from tests.llm.conftest import CLASHING, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def expected(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted((i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p)] == p)
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def check(found, rows):
    got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in found)
    want = sorted((str(r[0]), *(str(x) if i in (2, 3) else x for i, x in enumerate(expected(r[1])))) for r in rows)
    assert got == want
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)


def test_whole_table(docs_of, spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + odd_rows()
    rows += [(900, "CC-BY cc\nby CC  BY, general public\tlicense GENERAL PUBLIC License all rights all rights reserved"), (901, "cc"), (902, "İ cc by É ccby")]
    check(license_scan(docs_of(rows, **CLASHING)).collect(), rows)


def test_notices_with_changed_words(docs_of):
    text = "Permission is hereby given free of charge, to any single person obtaining a copy of this software and all associated documentation files"
    rows = {r.doc_id: r for r in license_scan(docs_of([(1, text), (2, "permission is hereby granted to any person"), (3, "the cat sat")])).collect()}
    assert rows[1].labels == "mit" and rows[1].n_base == 0 and rows[2].labels == "" and rows[3].score == 0


def test_notice_with_a_word_more_or_less_anywhere(docs_of):
    words = dict(NOTICES)["apache"].split()
    rows = [(i, " ".join([*words[:i], "inserted", *words[i:]])) for i in range(1, len(words))]
    rows += [(100 + i, " ".join([*words[:i], *words[i + 1 :]])) for i in range(len(words))]
    found = {r.doc_id: r for r in license_scan(docs_of(rows)).collect()}
    assert {r.labels for r in found.values()} == {"apache"} and round(found[15].score * 29) == 27


def test_a_gram_counts_once(docs_of):
    assert license_scan(docs_of([(1, "of the license " * 40)])).collect()[0].labels == ""


def test_empty_table(docs_of):
    assert license_scan(docs_of([])).collect() == []
