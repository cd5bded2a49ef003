import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from markloom.llm.common import written
from markloom.llm.spectrum import Spectrum, rank_one
from markloom.llm.whitening import fitted, spectrum_of, whitened


def table(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return written(df.repartition(5), "vectors")


def expected(rows, components=4):
    usable = [(i, [math.floor(256 * float(c)) for c in np.asarray(v, np.float32)]) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    exact = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(exact.T @ exact / n)
    keep = [i for i in np.argsort(-values)[:components] if values[i] > 1e-9 * values.max()]
    found = {}
    for at, (i, x) in enumerate(usable):
        for c, k in enumerate(keep):
            found[at, c + 1] = (i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), float((np.array(x) - np.array(sums) / n) @ vectors[:, k] / math.sqrt(values[k])), values[k] / values.sum())
    return found


def check(found, rows, components=4):
    want = sorted(expected(rows, components).items(), key=lambda x: (x[0][1], str(x[1][0]), x[1][2], abs(x[1][3])))
    found = sorted(found, key=lambda r: (r.component, str(r.vec_id), r.deviation, abs(r.whitened)))
    assert len(found) == len(want)
    signs = {}
    for r, ((_, c), (i, n, deviation, value, share)) in zip(found, want, strict=True):
        assert (r.vec_id, r.component, r.n, r.deviation) == (i, c, n, deviation)
        if abs(value) > 1e-6:
            assert signs.setdefault(c, r.whitened * value > 0) == (r.whitened * value > 0)
        assert abs(r.whitened) == pytest.approx(abs(value), rel=1e-9, abs=1e-9) and r.explained == pytest.approx(share, rel=1e-9) and r.identity_error < 1e-9


def test_rank_one_changes():
    rng = np.random.default_rng(1)
    for case in range(150):
        size = int(rng.integers(1, 20))
        basis, _ = np.linalg.qr(rng.normal(size=(size, size)))
        values = np.sort(rng.choice([0, 0, 1, 2, 2 + 1e-14, 5, 1e-9, 1e6], size) * 1.0) if case % 2 else np.sort(rng.random(size) * 10 ** rng.uniform(-3, 6))
        u = basis[:, 0] * 2.0 if case % 3 == 0 else rng.normal(size=size) * 10 ** rng.uniform(-6, 3)
        whole = basis @ np.diag(values) @ basis.T + np.outer(u, u)
        new, turned = rank_one(values, basis, u)
        assert np.abs(turned @ np.diag(new) @ turned.T - whole).max() < 1e-12 * np.abs(whole).max()
        assert np.abs(turned.T @ turned - np.eye(size)).max() < 1e-12
    assert rank_one(np.zeros(3), np.eye(3), np.zeros(3))[0].tolist() == [0, 0, 0]


def test_merged_spectra_agree_with_one():
    rng = np.random.default_rng(2)
    rows = rng.integers(-50, 50, (700, 12))
    rows[:, 3], rows[:, 5] = rows[:, 4], 0
    parts = []
    for a, b in ((0, 3), (3, 4), (4, 200), (200, 700)):
        parts.append(Spectrum.empty(12))
        parts[-1].add(rows[a:b])
    for p in parts[1:]:
        parts[0].merge(p)
    scatter = np.cov(rows.T, bias=True) * 700
    assert parts[0].n == 700 and (parts[0].sums == rows.sum(axis=0)).all()
    assert np.abs(parts[0].vectors @ np.diag(parts[0].values) @ parts[0].vectors.T - scatter).max() < 1e-12 * scatter.max()


def test_spectrum_before_refinement(spark):
    rng = np.random.default_rng(3)
    rows = rng.integers(-40, 40, (900, 6)) * np.array([1, 5, 2, 3, 9, 4])
    fit = written(spark.createDataFrame([(r.tolist(),) for r in rows], "x array<long>").repartition(20), "fit")
    found = spectrum_of(fit, 6)
    assert np.allclose(found.values, np.linalg.eigvalsh(np.cov(rows.T, bias=True) * 900), rtol=1e-12)
    assert fitted(fit, 6, 6).explained.sum() == pytest.approx(1)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rows += [(10_000 + i, r[1], None) for i, r in enumerate(rows[:40])] + [(20_000, None, 1), (20_001, [float("nan")] * 64, 1), (20_002, [float("inf")] + [0.0] * 63, 1), (20_003, [None] + [0.0] * 63, 1), (None, rows[7][1], 1), (5, [-0.0] * 64, 1)]
    check(whitened(table(spark, rows, x=1, n="n", component=2, i=3)).collect(), rows)


def test_flat_and_short_tables(spark):
    assert whitened(table(spark, [])).collect() == []
    assert whitened(table(spark, [(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)])).collect() == []
    assert whitened(table(spark, [(1, [], 0), (2, None, 0)])).collect() == []
    line = [(i, [i / 4, i / 2, -i / 8], 0) for i in range(20)]
    check(whitened(table(spark, line)).collect(), line)
    short = [(i, [float(i), float(i * i % 7), 1.0][: 1 + i % 3], 0) for i in range(30)]
    check(whitened(table(spark, short)).collect(), [(i, [*v, 0.0, 0.0][:3], x) for i, v, x in short])


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(1 << (i % 40)), float(i)], 0) for i in range(60)]
    found = {r.vec_id: r.deviation for r in whitened(table(spark, rows)).filter("component = 1").collect()}
    want = {i: d for (_, c), (i, _, d, _, _) in expected(rows).items() if c == 1}
    assert found == {i: d if d < 1 << 63 else None for i, d in want.items()} and None in found.values()
