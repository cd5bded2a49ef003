import hashlib
import re

import pytest
from pyspark.sql import functions as F

from markloom.llm.exact import exact_groups, keep_first
from tests.llm.conftest import CLASHING, odd_rows


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def expected(rows):
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(bare(r[1]), []).append((-len(r[1] or ""), r[0] is None, r[0] or 0, i))
    out = []
    for text, members in groups.items():
        keep = min(members)
        for m in members:
            tie = m[:3] == keep[:3]
            out.append((str(rows[m[3]][0]), str(rows[keep[3]][0]), len(members), tie, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


ROWS = [
    (10, "ab c d"), (11, "a b c d"), (12, " abcd"), (13, "ab c d"), (14, "abce"), (15, "x" * 9000), (16, "x" * 5000 + "\n" + "x" * 4000), (17, "x" * 9001),
    (20, "One two. Three! " * 200), (21, "One  two. Three! " * 200), (22, "One two. Three! " * 199 + "One two. Three? "), (23, "　a"), (24, "a"),
]


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.length(c).cast("long"), lambda c: F.lit(1).cast("long")])
def test_groups_even_with_clashing_hashes(docs_of, digest):
    rows = ROWS + odd_rows()
    found = exact_groups(docs_of(rows, **CLASHING), digest).collect()
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in found)
    want = expected(rows)
    ties = {(w[0], w[4]) for w in want if sum(x == w for x in want) > 1 and w[3]}  # of equal rows one stays
    loose = lambda rows: [r for r in rows if (r[0], r[4]) not in ties]
    assert loose(got) == loose(want) and len(got) == len(rows)
    assert all(sum(r.kept for r in found if r.text_sha256 == sha) == 1 for sha in {r.text_sha256 for r in found})


def test_kept_rows_and_empty_table(docs_of):
    docs = docs_of(ROWS, **CLASHING)
    assert sorted(r.doc_id for r in keep_first(docs).collect()) == [11, 14, 16, 17, 21, 22, 23, 24]
    assert keep_first(docs).columns == docs.columns and exact_groups(docs_of([])).collect() == []
