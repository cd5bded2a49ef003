import zlib

import numpy as np
import pytest

from markloom.llm.packing import fill_plan, pack_digest
from markloom.llm.queries import token_file
from tests.llm.conftest import CLASHING, odd_rows

tokenizers = pytest.importorskip("tokenizers")


def expected_pieces(rows, capacity):
    tokenizer = tokenizers.Tokenizer.from_file(token_file())
    out = []
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for n, start in enumerate(range(0, len(ids), capacity)):
            piece = ids[start : start + capacity]
            out.append((doc_id, n, start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    return sorted(out, key=str)


def check(found, rows, capacity):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str) == expected_pieces(rows, capacity)
    filled = {}
    for r in found:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pieces_and_places(docs_of, spark, capacity):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + odd_rows()
    rows += [(900, "İstanbul ẛ̣ don't I'LL <|endoftext|> ½ x² 漢字かな a\x1cb\x85c d")]
    found = pack_digest(docs_of(rows, **CLASHING), token_file(), capacity).collect()
    n = check(found, rows, capacity)
    total = sum(r.length for r in found)
    assert n <= 1.03 * -(-total // capacity) + 2


def test_empty_table(docs_of):
    assert pack_digest(docs_of([]), token_file()).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_everything_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 400))
    sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 3000)))
    histogram = {int(k): int(n) for k, n in zip(*np.unique(sizes, return_counts=True), strict=True)}
    used = {}
    for count, held in fill_plan(histogram, capacity):
        assert count > 0 and sum(length * n for length, n in held) <= capacity
        for length, n in held:
            used[length] = used.get(length, 0) + count * n
    assert used == histogram
