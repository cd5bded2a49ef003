import random
import re

import numpy as np
import pyarrow as pa
import pytest

from markloom.llm.common import components
from markloom.llm.near import CHUNKS, FAR, LANES, LONGS, _bucket_keys, first_of_each, lanes_apart, near_groups
from tests.llm.conftest import CLASHING, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def expected(rows, k):
    sets = [shingles(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(least.get(top(i)))) for i, r in enumerate(rows))


def family(rng, size, changes, start):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    out = []
    for i in range(size):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 10**6)}"
        out.append((start + i, " ".join(words)))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_families_against_brute_force(docs_of, k):
    rng = random.Random(k)
    rows = family(rng, 260, 14, 1000) + family(rng, 40, 6, 5000) + family(rng, 3, 2, 7000) + family(rng, 2, 30, 7100)
    rows += [(9000 + i, f"lone {i} " * 3) for i in range(30)] + odd_rows() + [(8000, rows[3][1].upper()), (8001, rows[3][1])]
    rng.shuffle(rows)
    found = near_groups(docs_of(rows, **CLASHING), k)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found.collect()) == expected(rows, k)


def test_first_rows_stay(docs_of):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (9, "z"), (9, "z"), (4, ""), (6, None)]
    kept = first_of_each(docs_of(rows, **CLASHING))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 9]


def test_empty_table_and_low_similarity(docs_of):
    assert near_groups(docs_of([])).collect() == []
    with pytest.raises(ValueError):
        near_groups(docs_of([]), percent=70)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(1, x) for x in range(2, 30)] + [(500, 400), (400, 450), (7, 7)]
    rng = random.Random(1)
    rng.shuffle(edges)
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[x] == 100 for x in range(100, 181)) and all(found[x] == 1 for x in range(1, 30)) and found[500] == 400


def test_lanes_apart(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(200):
        a = [rng.getrandbits(16) for _ in range(8)]
        b = [x if rng.random() < 0.5 else x ^ (1 << rng.randrange(16)) for x in a]
        pack = lambda v: [int.from_bytes(b"".join(x.to_bytes(2, "little") for x in v[i : i + 4]), "little", signed=True) for i in (0, 4)]
        rows.append((pack(a), pack(b), sum(x != y for x, y in zip(a, b, strict=True))))
    df = spark.createDataFrame(rows, "one array<long>, two array<long>, n int")
    assert df.filter(lanes_apart("one", "two") != df.n).count() == 0


def test_signatures_meet_up_to_far():
    """The guarantee itself: pairs at every distance up to FAR lanes share a key, wherever the lanes differ."""
    rng = np.random.default_rng(5)
    assert FAR <= 2 * CHUNKS - 1 and LANES % CHUNKS == 0

    def keys_of(lanes):
        flat = pa.array(np.concatenate(lanes).view(np.int64))
        sig = pa.ListArray.from_arrays(pa.array(np.arange(len(lanes) + 1, dtype=np.int32) * LONGS), flat)
        [out] = _bucket_keys(iter([pa.RecordBatch.from_arrays([pa.array(range(len(lanes))), sig], ["row", "sig"])]))
        return [set(x) for x in out.column("keys").to_pylist()]

    width = LANES // CHUNKS
    for distance in range(FAR + 1):
        pairs = []
        for case in range(6):
            one = rng.integers(0, 1 << 16, LANES).astype(np.uint16)
            # Half of the cases differ in two lanes of as many chunks as they can, which is the worst.
            worst = np.concatenate([rng.choice(width, 2, replace=False) + width * c for c in rng.permutation(CHUNKS)])
            at = worst[:distance] if case % 2 else rng.choice(LANES, distance, replace=False)
            two = one.copy()
            two[at] ^= np.uint16(1 + case)
            pairs += [one, two]
        keys = keys_of(pairs)
        assert all(keys[i] & keys[i + 1] for i in range(0, len(keys), 2)), distance


def test_many_small_classes_in_one_family(docs_of):
    """Rounds of hubs, closed buckets and tiles: chains of copies, some of them beyond each other's reach."""
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(100)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(100), rng.choice([1, 4, 9, 12])):
            words[at] = f"n{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    found = near_groups(docs_of(rows), 2)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found.collect()) == expected(rows, 2)
