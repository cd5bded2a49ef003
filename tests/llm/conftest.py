import random

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def make_docs(spark, rows, **more):
    """``rows`` of (doc_id, text) or (doc_id, text, source), stored as a table so that reads agree."""
    from markloom.session import scratch_path

    full = [Row(doc_id=r[0], text=r[1], lang="en", source=r[2] if len(r) > 2 else "a", n_chars=len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name, value in more.items():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(value))
    path = scratch_path(spark, "docs")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def docs_of(spark):
    return lambda rows, **more: make_docs(spark, rows, **more)


#: Rows every operator must take: nulls, empty, white space, one word, repeated rows, ties, a very long text.
def odd_rows():
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "Ünïcode", "x1,"]) + str(rng.randint(0, 900)) for _ in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one"), (None, "one two three"), (None, None), (6, long), (7, long + " end"), (8, "A\x00B c　d é"), (9, "b" * 5000, None)]


#: Columns of the input whose names an operator uses for its own.
CLASHING = {"row": 1, "id": "x", "length": "y", "component": 3, "size": 2, "kept": True, "words": "w", "_n": 0, "hash": 9, "key": 1, "score": 2.0, "code": 5, "_row": 7, "rank": 1}
