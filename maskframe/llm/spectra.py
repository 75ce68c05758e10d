"""Eigenvalues and eigenvectors of a scatter matrix under rank-one updates.

``values`` d, in rising order, and ``vectors`` U, in columns, stand for U diag(d) U'. Adding w v v' asks for the
roots of the secular equation 1 + w sum z_i^2 / (d_i - x) = 0 with z = U'v. Entries that z hardly touches keep their
eigenpair, and a group of equal d is reflected so that z touches one of them only (deflation). The roots are found
by rational interpolation inside brackets, relative to the nearer pole; z is then computed anew from the
roots, so that the new vectors are orthogonal (after Bunch, Nielsen and Sorensen, 1978; Li, 1993; Gu and Eisenstat, 1994).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_EPS = np.finfo(np.float64).eps


@dataclass
class Spectrum:
    """``rows`` vectors around ``mean``, and the eigenpairs of their centred scatter."""

    rows: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def nothing(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim), np.zeros(dim), np.eye(dim))


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum weights_i / (poles_i - x), one above each pole: the nearer pole's number and the distance from it.

    ``poles`` rise strictly and ``weights`` are positive.
    """
    n = len(poles)
    gap = np.append(np.diff(poles), weights.sum())
    middle = 1 + (weights / (poles - poles[:, None] - (gap / 2)[:, None])).sum(1)
    left = (middle >= 0) | (np.arange(n) == n - 1)  # the last has no pole above it
    nearer = np.where(left, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    shifted = poles - poles[nearer][:, None]  # of all poles, from each root's own
    here, there = np.where(left, 0.0, -gap), np.where(left, gap, 0.0)
    half = np.where(left, gap / 2, -gap / 2)
    low = np.where(left, np.where(middle >= 0, 0.0, half), half)
    high = np.where(left, np.where(middle >= 0, half, gap), 0.0)
    x = (low + high) / 2
    below = np.tri(n, dtype=bool)  # the poles up to each root's own
    for _ in range(100):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            d = shifted - x[:, None]
            terms = weights / d
            f = 1 + terms.sum(1)
            low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
            slopes = terms / d
            psi, phi = np.where(below, slopes, 0).sum(1), np.where(below, 0, slopes).sum(1)
            dk, dl = here - x, there - x
            c = f - dk * psi - dl * phi
            a = (dk + dl) * f - dk * dl * (psi + phi)
            b = dk * dl * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = x + step
        inside = (new > low) & (new < high)
        new = np.where(inside, new, (low + high) / 2)
        enough = np.abs(f) <= 4 * _EPS * (1 + np.abs(terms).sum(1))  # f is not known any better
        done = enough | (np.abs(new - x) <= 2 * _EPS * np.abs(new))
        x = np.where(enough, x, new)
        if done.all():
            break
    return nearer, x


def updated(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """The eigenpairs of U diag(values) U' + weight v v', weight not negative."""
    z = vectors.T @ v * np.sqrt(weight)
    size = max(float(np.abs(values).max(initial=0.0)), float(z @ z))
    if size == 0:
        return values, vectors
    order = np.argsort(values, kind="stable")
    d, u, z = values[order], vectors[:, order].copy(), z[order]
    near = 8 * _EPS * size
    ends = np.flatnonzero(np.append(np.diff(d) > near, True)) + 1
    for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
        if b - a > 1 and (length := np.sqrt(z[a:b] @ z[a:b])) > 0:
            mirror = z[a:b].copy()
            mirror[-1] += np.copysign(length, mirror[-1])
            mirror /= np.sqrt(mirror @ mirror)
            u[:, a:b] -= 2 * np.outer(u[:, a:b] @ mirror, mirror)
            z[a : b - 1], z[b - 1] = 0, -np.copysign(length, z[b - 1])
    moved = np.flatnonzero(np.abs(z) * np.sqrt(size) > near)
    if not len(moved):
        return d, u
    poles, weights = d[moved], z[moved] ** 2
    nearer, x = secular_roots(poles, weights)
    gaps = (poles - poles[nearer][:, None]) - x[:, None]  # pole i less root j, at [j, i]
    apart = poles - poles[:, None]  # pole i less pole j
    ratio = -gaps / np.where(np.eye(len(moved), dtype=bool), 1.0, -apart)
    fitted = np.sqrt(np.abs(ratio.prod(0)))
    new = np.copysign(fitted, z[moved]) / gaps
    new /= np.sqrt((new * new).sum(1))[:, None]
    d[moved] = poles[nearer] + x
    u[:, moved] = u[:, moved] @ new.T
    return d, u


def with_rows(spectrum: Spectrum, rows: np.ndarray) -> Spectrum:
    """The spectrum of more vectors.

    The rows around their own mean enter one by one. If they are more than they have dimensions, the rows of their triangular
    factor do, which have the same scatter. One more update is for the step from one mean to the other.
    """
    n = len(rows)
    if n == 0:
        return spectrum
    mean = rows.mean(0)
    centred = rows - mean
    if len(centred) > centred.shape[1]:
        centred = np.linalg.qr(centred, mode="r")
    values, vectors = spectrum.values, spectrum.vectors
    for v in centred:
        values, vectors = updated(values, vectors, v, 1.0)
    return _shifted(spectrum, n, mean, values, vectors)


def merged(one: Spectrum, other: Spectrum) -> Spectrum:
    """The spectrum of the vectors of both: an update for each eigenpair of the other, and one for the means."""
    if not one.rows or not other.rows:
        return one if one.rows else other
    values, vectors = one.values, one.vectors
    for value, v in zip(other.values, other.vectors.T, strict=True):
        if value > 0:
            values, vectors = updated(values, vectors, v, float(value))
    return _shifted(one, other.rows, other.mean, values, vectors)


def _shifted(old: Spectrum, n: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> Spectrum:
    rows = old.rows + n
    step = mean - old.mean
    if old.rows:
        values, vectors = updated(values, vectors, step, old.rows * (n / rows))
    return Spectrum(rows, old.mean + step * (n / rows), values, vectors)
