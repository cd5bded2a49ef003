"""Eigendecompositions kept up to date by rank-one changes.

A spectrum holds, of a set of vectors, their number, their exact sum and the eigenpairs of their scatter about
their mean.  A centred vector changes it by a rank-one term: in the basis of the eigenvectors the new values are
the roots of a secular equation, one between each two old values; entries that the change does not touch and
equal values are deflated first.  Eigenvectors come from the roots by the formula that keeps them orthogonal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = np.finfo(float).eps


@dataclass
class Spectrum:
    n: int
    sums: np.ndarray  # exact, int64
    values: np.ndarray  # ascending
    vectors: np.ndarray  # one a column

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size, np.int64), np.zeros(size), np.eye(size))

    def _change(self, u: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, u)

    def _join(self, n: int, sums: np.ndarray) -> None:
        """The term that scatters about two means leave between them, and the joint number and sum."""
        if self.n and n:
            self._change(np.sqrt(self.n * n / (self.n + n)) * (sums / n - self.sums / self.n))
        self.n, self.sums = self.n + n, self.sums + sums

    def add(self, block: np.ndarray) -> None:
        """Add rows of whole numbers.  More rows than dimensions are turned into as many rows as dimensions
        of the same scatter (the triangular factor); each row is a rank-one change."""
        if not len(block):
            return
        sums = block.sum(axis=0)
        rows = block - sums / len(block)
        for u in np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows:
            self._change(u)
        self._join(len(block), sums)

    def merge(self, other: Spectrum) -> None:
        """Add another spectrum: its eigenpairs one after the other, then the two means."""
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self._change(np.sqrt(value) * vector)
        self._join(other.n, other.sums)


def secular_roots(poles: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(z**2 / (poles - x))``, each above its pole, and the matrix ``poles[:, None] - roots``.

    A root is found as its distance from the nearer pole, so differences of nearly equal numbers stay exact.
    """
    squares = z * z
    gaps = np.append(np.diff(poles), squares.sum())
    middle = 1 + (squares[:, None] / (poles[:, None] - (poles + gaps / 2))).sum(axis=0)
    from_left = middle > 0
    from_left[-1] = True
    origin = np.where(from_left, np.arange(len(poles)), np.minimum(np.arange(len(poles)) + 1, len(poles) - 1))
    sign = np.where(from_left, 1.0, -1.0)
    apart = poles[:, None] - poles[origin]
    high = np.where(np.arange(len(poles)) < len(poles) - 1, gaps / 2, gaps)
    low = high * 1e-35
    for _ in range(62):
        step = np.where(high > 2 * low, np.sqrt(low) * np.sqrt(high), (low + high) / 2)
        above = 1 + (squares[:, None] / (apart - sign * step)).sum(axis=0) > 0
        beyond = above == from_left  # the root is nearer to the pole
        high, low = np.where(beyond, step, high), np.where(beyond, low, step)
    shift = sign * (low + high) / 2
    return poles[origin] + shift, apart - shift


def rank_one(values: np.ndarray, vectors: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs, ascending, of ``vectors @ diag(values) @ vectors.T + outer(u, u)``."""
    z = vectors.T @ u
    length = np.sqrt(z @ z)
    scale = max(float(values[-1]), length * length) if len(values) else 0.0
    if scale == 0:
        return values, vectors
    tolerance = 8 * EPS * scale
    vectors = vectors.copy()
    edges = np.append(np.flatnonzero(np.append(True, np.diff(values) > tolerance)), len(values))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = z[a:b].copy()
        size = np.sqrt(part @ part)
        if b - a > 1 and size > 0:  # equal values: turn their vectors so that one carries the change
            mirror, side = part.copy(), size if part[-1] >= 0 else -size
            mirror[-1] += side
            mirror /= np.sqrt(mirror @ mirror)
            vectors[:, a:b] -= 2 * np.outer(vectors[:, a:b] @ mirror, mirror)
            z[a:b] = 0
            z[b - 1] = -side
    live = np.abs(z) * length > tolerance
    if not live.any():
        return values, vectors
    poles, z = values[live], z[live]
    roots, apart = secular_roots(poles, z)
    # The change that has exactly these roots: its eigenvectors are orthogonal.
    own = np.eye(len(poles), dtype=bool)
    ratio = np.where(own, -apart.T, apart.T / np.where(own, 1, poles[None, :] - poles[:, None]))
    fitted = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=0))), z)
    turned = fitted[:, None] / apart
    turned /= np.sqrt((turned * turned).sum(axis=0))
    values, vectors[:, live] = values.copy(), vectors[:, live] @ turned
    values[live] = roots
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]
