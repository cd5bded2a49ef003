import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from markloom.llm.mixing import chosen, drawn, hypergeometric, mix_digest, shard_draws, splitting_tree
from tests.llm.conftest import CLASHING, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_level(sizes):
    """Targets by repeated sharing of the excess, one round at a time."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest, free = total - sum(fixed.values()), [s for s in names if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def check(found, rows, block):
    sizes, source = {}, {}
    for doc_id, text, *more in rows:
        sizes[more[0] if more else "a"] = sizes.get(more[0] if more else "a", 0) + len(WORD.findall(text or ""))
        source[doc_id] = more[0] if more else "a"
    want, taken = water_level(sizes), {}
    for r in found:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= block / 2 + 1e-6


def test_targets_and_takes(docs_of):
    rows = [(i, "w " * (7 * i % 300), f"s{i % 11}") for i in range(1, 900)] + [(i, "x y " * 40, "hot") for i in range(1000, 1500)]
    docs = docs_of(rows, **CLASHING)
    found = mix_digest(docs).collect()
    check(found, rows, 64)
    assert sorted(map(str, mix_digest(docs).collect())) == sorted(map(str, found))


def test_odd_rows(docs_of):
    rows = odd_rows()
    assert len(mix_digest(docs_of(rows)).collect()) == len(rows)
    assert mix_digest(docs_of([])).collect() == []
    assert {r.taken for r in mix_digest(docs_of([(1, None), (2, "")])).collect()} == {0}


def test_shards_are_even_disjoint_and_exact(docs_of):
    docs = docs_of([(i, "w " * 40, f"s{i % 4}") for i in range(1200)])
    _, _, blocks = chosen(docs, 8)
    draws = shard_draws(blocks, shard_blocks=700)
    quota = blocks.agg(F.sum("times")).first()[0]
    assert draws.count() == quota == draws.select("row", "block", "epoch").distinct().count()
    sizes = [r["count"] for r in draws.groupBy("shard").count().collect()]
    assert len(sizes) == -(-quota // 700) and max(sizes) - min(sizes) <= len(sizes)
    assert all(r.n == r.top + 1 for r in draws.groupBy("shard").agg(F.max("place").alias("top"), F.count("*").alias("n")).collect())
    share = {(r.shard, r.source): r.n for r in draws.groupBy("shard", "source").agg(F.count("*").alias("n")).collect()}
    whole = {r.source: r.n for r in draws.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert all(abs(share.get((k, s), 0) - n / len(sizes)) < 6 * (n / len(sizes)) ** 0.5 + 2 for k in range(len(sizes)) for s, n in whole.items())


def test_drawn_keeps_whole_texts_and_columns(docs_of):
    rows = [(i, f"  a{i}\tb \n c{i} " * 5, "x") for i in range(50)] + [(i, "q " * 10, "y") for i in range(100, 110)]
    docs = docs_of(rows)
    mixed = drawn(docs, 1000)
    assert mixed.columns == docs.columns
    texts = {r[0]: r[1] for r in rows}
    assert all(r.text == texts[r.doc_id] for r in mixed.collect())
    small = drawn(docs, 4).groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n"))
    taken = {r.doc_id: r.taken for r in mix_digest(docs, 4).collect()}
    assert {r.doc_id: r.n for r in small.collect()} == {k: n for k, n in taken.items() if n}


def taken_of(docs, **more):
    return sorted((r.doc_id, r.taken, r.first_shard) for r in mix_digest(docs, 8, shard_blocks=60, **more).collect())


def test_splits_partitions_and_a_rewritten_copy_change_nothing(docs_of, spark):
    rows = [(i, f"w{i} " * (i % 60), f"s{i % 5}") for i in range(700)] + [(5, "same " * 40, "hot")] * 150 + [(6, "x " * 30, None)] * 3
    docs = docs_of(rows)
    want = taken_of(docs)
    assert len({r[2] for r in want} - {None}) > 20
    copy = docs_of(list(reversed(rows))).repartition(11)
    texts = sorted(r.text for r in drawn(docs, 8, shard_blocks=60).collect())
    for name, value in (("spark.sql.files.minPartitionNum", "16"), ("spark.sql.shuffle.partitions", "3")):
        before = spark.conf.get(name, None)
        spark.conf.set(name, value)
        try:
            assert taken_of(docs) == want
        finally:
            spark.conf.set(name, before) if before else spark.conf.unset(name)
    assert taken_of(copy) == want and sorted(r.text for r in drawn(copy, 8, shard_blocks=60).collect()) == texts
    assert taken_of(docs, seed=11) != want


def test_mix_lies_shard_by_shard(docs_of):
    docs = docs_of([(i, f"w{i} " * 4, f"s{i % 3}") for i in range(600)])
    mixed = drawn(docs, 8, shard_blocks=60).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    _, _, blocks = chosen(docs, 8)
    rows = {r.row: r.doc_id for r in chosen(docs, 8)[0].collect()}
    want = {}
    for r in shard_draws(blocks, shard_blocks=60).collect():
        want.setdefault(r.shard, []).append((r.place, rows[r.row]))
    found = {}
    for r in mixed.orderBy("at").collect():
        found.setdefault(r.part, []).append(r.doc_id)
    shards = [[d for _, d in sorted(x)] for x in want.values()]
    whole = ["," + ",".join(map(str, x)) + "," for x in found.values()]
    assert len(shards) > 5 and all(any("," + ",".join(map(str, s)) + "," in w for w in whole) for s in shards)


def test_splitting_tree_over_rounds(spark):
    quotas = spark.createDataFrame([("a", 5000), ("b", 37), (None, 900), ("c", 0)], "source string, quota long")
    tree = splitting_tree(quotas, 3, 50).collect()
    shards = -(-5937 // 50)
    assert shards > 2**4 and {r.shard for r in tree} == set(range(shards))
    sizes = [sum(r.quota for r in tree if r.shard == k) for k in range(shards)]
    assert sum(sizes) == 5937 and max(sizes) - min(sizes) <= 7
    for source, quota in (("a", 5000), ("b", 37), (None, 900)):
        at = 0
        for r in sorted((r for r in tree if r.source == source), key=lambda r: r.shard):
            assert r.first == at
            at += r.quota
        assert at == quota


def test_large_draws_are_exact():
    small = [hypergeometric(np.random.default_rng(i), 60, 40, 30) for i in range(3000)]
    halved = [hypergeometric(np.random.default_rng(i), 60, 40, 30, limit=20) for i in range(3000)]
    assert abs(np.mean(small) - np.mean(halved)) < 0.2 and abs(np.std(small) - np.std(halved)) < 0.12
    for good, bad, drawn_ in ((0, 5, 3), (5, 0, 3), (7, 3, 10), (7, 3, 0)):
        n = hypergeometric(np.random.default_rng(1), good, bad, drawn_, limit=2)
        assert max(0, drawn_ - bad) <= n <= min(good, drawn_)
    huge = hypergeometric(np.random.default_rng(2), 10**13, 3 * 10**13, 10**12)
    assert abs(huge - 25 * 10**10) < 6 * (10**12 * 0.25 * 0.75) ** 0.5
