"""Whitening of embeddings by an incremental eigendecomposition.

Entries are put on a grid of 1/256, so that sums and distances are exact.  The fit list holds every distinct
vector once.  Each partition of it keeps a spectrum (see ``spectrum``) up to date by centred rank-one changes;
spectra are merged, eight at a time, by the rank-one changes that the eigenpairs of one make to another.  The
resulting basis is then refined: one pass sums the covariance of the fit list, centred by its exact mean, in
that basis, and the eigenpairs of the small matrix turn the basis (Rayleigh-Ritz), which brings it to double
precision whatever errors the updates have left.  A last pass over the fit list measures how far the whitened
vectors are from unit covariance.  Only matrices of the number of dimensions reach the driver.

Defined cases: a null vector, or one with a null, NaN or infinite entry, is dropped; vectors shorter than the
longest count as ending in zeros; repeated vectors are whitened each and fitted once; components whose
eigenvalue is zero (up to rounding) can't be whitened and are left out, so equal vectors give no rows, and
neither does an empty table; null ids stay; a deviation beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import written
from markloom.llm.spectrum import EPS, Spectrum

GRID, MERGED = 256, 8
STATE = "n long, sums array<long>, values array<double>, vectors array<double>"


@dataclass
class Whitening:
    n: int
    sums: np.ndarray
    components: np.ndarray  # unit eigenvectors, one a column, by falling eigenvalue
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def gridded(vector: str) -> Column:
    """Whole numbers of a usable vector, null for others."""
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * GRID).cast("long"))
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(usable, whole)


def _rows(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, size)


def _pack(s: Spectrum) -> list:
    return [s.n, s.sums.tolist(), s.values.tolist(), s.vectors.ravel().tolist()]


def _unpack(row) -> Spectrum:
    values = np.asarray(row["values"], float)
    return Spectrum(int(row["n"]), np.asarray(row["sums"], np.int64), values, np.asarray(row["vectors"], float).reshape(len(values), -1))


def _spectra(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum.empty(size)
        for batch in batches:
            spectrum.add(_rows(batch, size))
        if spectrum.n:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(_pack(spectrum), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], ["n", "sums", "values", "vectors"])

    return run


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    rows = [r for _, r in group.sort_values("n", ascending=False, kind="stable").iterrows()]
    spectrum = _unpack(rows[0])
    for row in rows[1:]:
        spectrum.merge(_unpack(row))
    return pd.DataFrame([_pack(spectrum)], columns=["n", "sums", "values", "vectors"])


def spectrum_of(fit: DataFrame, size: int) -> Spectrum | None:
    """The spectrum of all vectors ``x``, merged by levels; None without any."""
    states = written(fit.select("x").mapInArrow(_spectra(size), STATE), "spectra")
    left = states.count()
    while left > 1:
        groups = -(-left // MERGED)
        dealt = states.withColumn("part", F.pmod(F.xxhash64("n", "sums"), F.lit(groups)))
        states = written(dealt.groupBy("part").applyInPandas(lambda g: _merged(g.drop(columns="part")), STATE), "spectra")
        left = states.count()
    return _unpack(states.first()) if left else None


def _moments(mean: np.ndarray, basis: np.ndarray):
    """Sums of products of centred vectors in a basis, upper triangle row by row, and after them the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = basis.shape[1]
        products, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            turned = (_rows(batch, len(mean)) - mean) @ basis
            products += turned.T @ turned
            sums += turned.sum(axis=0)
        flat = np.append(products[np.triu_indices(k)], sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    return run


def _covariance(fit: DataFrame, n: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    k = basis.shape[1]
    sums = fit.select("x").mapInArrow(_moments(mean, basis), "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.zeros(k * (k + 1) // 2 + k)
    for row in sums.collect():  # a number of rows set by the dimensions
        flat[row["i"]] = row["v"]
    whole = np.zeros((k, k))
    whole[np.triu_indices(k)] = flat[:-k] / n
    centre = flat[-k:] / n
    return whole + np.triu(whole, 1).T - np.outer(centre, centre)


def fitted(fit: DataFrame, size: int, components: int = 4) -> Whitening | None:
    """The whitening of a table of distinct vectors ``x``; None if it is empty."""
    found = spectrum_of(fit, size)
    if found is None:
        return None
    mean = found.sums / found.n
    basis, _ = np.linalg.qr(found.vectors[:, ::-1])
    values, turn = np.linalg.eigh(_covariance(fit, found.n, mean, basis))
    total, order = values.sum(), np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > 64 * size * EPS * max(values.max(), 0)]
    vectors = basis @ turn[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    vectors, values = vectors / np.sqrt((vectors * vectors).sum(axis=0)), values[order]
    error = np.abs(_covariance(fit, found.n, mean, vectors / np.sqrt(values)) - np.eye(len(order))).max() if len(order) else 0.0
    return Whitening(found.n, found.sums, vectors, values, values / total if total > 0 else values, float(error))


def _deviations(rows: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Exact sums of squares of ``n * x - sums``; null beyond a long."""
    most = n * int(np.abs(rows).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if len(sums) * most * most < 1 << 63:
        apart = n * rows - sums
        return pa.array((apart * apart).sum(axis=1))
    exact = [sum((n * a - b) ** 2 for a, b in zip(r, sums.tolist(), strict=True)) for r in rows.tolist()]
    return pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())


def _whitened(model: Whitening):
    scale, mean = model.components / np.sqrt(model.values), model.sums / model.n
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch, len(mean))
            own = pa.array(np.repeat(np.arange(len(rows)), k))
            columns = [
                batch.column("vec_id").take(own), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()), pa.array(np.full(len(own), model.n)),
                _deviations(rows, model.n, model.sums).take(own), pa.array(((rows - mean) @ scale).ravel()),
                pa.array(np.tile(model.explained, len(rows))), pa.array(np.full(len(own), model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whitened(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row."""
    usable = vectors.select(F.col(ident).cast("long").alias("vec_id"), gridded(vector).alias("x")).filter("x is not null")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = usable.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if sizes[1] != sizes[0]:
        usable = usable.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(sizes[1]) - F.size("x"))))
    model = fitted(written(usable.select("x").distinct(), "fit"), sizes[1], components) if sizes[1] else None
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    return usable.mapInArrow(_whitened(model), schema)
