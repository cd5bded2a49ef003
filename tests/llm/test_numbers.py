"""Results when the input is split differently from one read to the next, as happens when executors come or go."""

import random

import pytest
from pyspark.sql import functions as F

from markloom.llm import common, exact, mixing, near, substring
from markloom.session import scratch_path

FIRST = {"signed", "codes", "recipes", "sizes", "groups"}


def table(spark):
    """Texts in six files of different size: copies, near copies and repeated passages of other rows."""
    rng = random.Random(7)
    base = [[f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(30, 120))] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 + i, " ".join(w)) for i, w in enumerate(base[:8])]
    rows += [(200 + i, " ".join([*w[:-1], "changed"])) for i, w in enumerate(base[8:16])] + [(300 + i, f"own{i} " + " ".join(w[5:25]) + f" end{i}") for i, w in enumerate(base[16:24])]
    path = scratch_path(spark, "split")
    docs = spark.createDataFrame([(i, t, "abc"[i % 3]) for i, t in rows], "doc_id long, text string, source string")
    docs.repartition(6, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def resplit(spark, monkeypatch):
    """From the second table on that an operator writes, every file is a split of its own."""
    key = "spark.sql.files.minPartitionNum"
    store = common.written

    def patched(df, label):
        spark.conf.set(key, "1" if label in FIRST else "100")
        out = store(df, label)
        spark.conf.set(key, "100")
        return out

    def start():
        for module in (common, exact, mixing, near, substring):
            monkeypatch.setattr(module, "written", patched)

    yield start
    spark.conf.unset(key)


@pytest.mark.parametrize("run", [
    exact.keep_first, lambda d: exact.exact_groups(d).drop("row"), mixing.mix_digest, near.first_of_each, lambda d: near.near_groups(d).select("doc_id", "component_id"), substring.cut_repeats, lambda d: mixing.drawn(d, 16),
], ids=["keep_first", "exact_groups", "mix_digest", "first_of_each", "near_groups", "cut_repeats", "drawn"])
def test_another_split_gives_the_same_rows(spark, resplit, run):
    docs = table(spark)
    want = sorted(map(str, run(docs).collect()))
    resplit()
    assert sorted(map(str, run(docs).collect())) == want


def test_numbers_of_any_input(spark):
    docs = table(spark)
    path = docs._jdf.inputFiles()[0]
    twice = spark.read.parquet(path, path)
    clashing = docs.withColumn("_metadata", F.lit(1)).withColumn("path", F.lit("x")).withColumn("row", F.lit(1))
    for given in (docs, twice, clashing, docs.crossJoin(spark.range(2)), docs.filter("false")):
        found = common.numbered(given, "_row")
        assert found.drop("_row").columns == given.columns
        assert found.count() == found.select("_row").distinct().count() == given.count()
