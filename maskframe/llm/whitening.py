"""Embeddings whitened: projected on the principal axes of the whole table, each to variance 1.

Each partition keeps the eigenpairs of its vectors' centred scatter by rank-one updates (``spectra``). The partitions' spectra are
combined, a few at a time in rounds, by one more update for each eigenpair and one for the step between means. The basis that comes out
is near the eigenvectors; a pass over all vectors then adds up their scatter in that basis, around the exact mean, and the
eigenpairs of that small matrix (Rayleigh-Ritz) turn the basis into the axes to double precision.

Entries c are the whole numbers floor(scale c) + shift, so counts, sums and deviations are exact. Vectors of
different dimension are different tables: each dimension has a mean and axes of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .spectra import Spectrum, merged, with_rows

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
FAN = 8  # spectra that one task combines
LARGEST = 1 << 40  # of a whole number, so that sums over a batch are exact

_PARTIAL = "dim int, part int, n long, sums array<string>, mean binary, values binary, vectors binary"


def _matrices(batch: pa.RecordBatch, scale: int, shift: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, row numbers and whole numbers (exact, as doubles) of the batch's vectors that take part."""
    column = batch.column("embedding")
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
        good = np.isfinite(x).all(1)
        x = np.floor(scale * x[good]) + shift
        if x.size and np.abs(x).max() > LARGEST:
            raise ValueError(f"an entry is beyond {LARGEST} when scaled")
        if len(x):
            yield dim, rows[good], x


def _plain(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _packed(dim: int, part: int, sums, s: Spectrum) -> dict:
    stored = {k: np.ascontiguousarray(getattr(s, k), "<f8").tobytes() for k in ("mean", "values", "vectors")}
    return {"dim": dim, "part": part, "n": s.rows, "sums": [str(x) for x in sums]} | stored


def _unpacked(row) -> Spectrum:
    mean, values, vectors = (np.frombuffer(bytes(row[k]), "<f8") for k in ("mean", "values", "vectors"))
    return Spectrum(int(row["n"]), mean, values, vectors.reshape(len(mean), len(mean)))


def partial_spectra(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """For each partition and dimension: ``n``, exact ``sums``, and mean, values and vectors of the scatter."""
    schema = pa.schema(
        [("dim", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))]
        + [(k, pa.binary()) for k in ("mean", "values", "vectors")]
    )

    def run(batches):
        spectra, sums = {}, {}
        for batch in batches:
            for dim, _, x in _matrices(batch, scale, shift):
                spectra[dim] = with_rows(spectra.get(dim) or Spectrum.nothing(dim), x)
                sums[dim] = sums.get(dim, 0) + x.astype(np.int64).sum(0).astype(object)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([_packed(d, part, sums[d], s) for d, s in spectra.items()], schema=schema)

    return _plain(vectors).select("embedding").mapInArrow(run, _PARTIAL)


def combined(partials: DataFrame) -> DataFrame:
    """One spectrum for each dimension, from those of the partitions, ``FAN`` of them in a task."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        spectrum, sums = Spectrum.nothing(int(rows["dim"].iloc[0])), 0
        for _, row in rows.iterrows():
            spectrum = merged(spectrum, _unpacked(row))
            sums = sums + np.array([int(x) for x in row["sums"]], object)
        return pd.DataFrame([_packed(int(rows["dim"].iloc[0]), int(rows["part"].iloc[0]) // FAN, sums, spectrum)])

    found = written(partials, "spectra")
    while (found.groupBy("dim").count().agg(F.max("count")).first()[0] or 0) > 1:
        found = written(found.groupBy("dim", F.floor(F.col("part") / FAN)).applyInPandas(fold, _PARTIAL), "spectra")
    return found


def _summed(df: DataFrame) -> dict[int, np.ndarray]:
    """The sums of the arrays ``cells``, entry by entry, for each ``dim``; as large as one of the arrays."""
    cells = df.select("dim", F.posexplode("cells").alias("i", "cell")).groupBy("dim", "i").agg(F.sum("cell").alias("cell"))
    out: dict[int, dict[int, float]] = {}
    for row in cells.collect():
        out.setdefault(row["dim"], {})[row["i"]] = row["cell"]
    return {dim: np.array([found[i] for i in range(len(found))]) for dim, found in out.items()}


@dataclass
class Axes:
    """What the vectors of one dimension are whitened by: ``vectors`` in columns, by falling ``values``."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(s // self.n) + (s % self.n) / self.n for s in self.sums])


def axes(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> dict[int, Axes]:
    """The principal axes of each dimension; what comes to the driver is a few matrices of dimension by dimension."""
    rough = {}
    for row in combined(partial_spectra(vectors, scale, shift)).collect():
        sums = [int(x) for x in row["sums"]]
        rough[row["dim"]] = Axes(row["n"], sums, np.zeros(0), _unpacked(row).vectors, 0.0)
    shared = vectors.sparkSession.sparkContext.broadcast(rough)
    schema = pa.schema([("dim", pa.int32()), ("cells", pa.list_(pa.float64()))])

    def run(batches):
        means, scatters = {d: a.mean for d, a in shared.value.items()}, {}
        for batch in batches:
            for dim, _, x in _matrices(batch, scale, shift):
                y = (x - means[dim]) @ shared.value[dim].vectors
                scatters[dim] = scatters.get(dim, 0) + y.T @ y
        yield pa.RecordBatch.from_pylist([{"dim": d, "cells": s.ravel()} for d, s in scatters.items()], schema=schema)

    cells = _summed(_plain(vectors).select("embedding").mapInArrow(run, "dim int, cells array<double>"))
    out = {}
    for dim, a in rough.items():
        ritz = cells[dim].reshape(dim, dim) / a.n
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        best = a.vectors @ turn[:, ::-1]
        signs = np.sign(best[np.abs(best).argmax(0), np.arange(dim)])  # the largest entry is positive
        out[dim] = Axes(a.n, a.sums, values[::-1], best * signs, float(np.trace(ritz)))
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """sum (n x - S)^2 of each row, exactly."""
    widest = n * int(np.abs(x).max()) + max(map(abs, sums))
    if widest**2 * x.shape[1] < 1 << 63:
        away = n * x.astype(np.int64) - np.array(sums, np.int64)
        return pa.array((away * away).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
    away = n * x.astype(np.int64).astype(object) - np.array(sums, object)
    return pa.array([Decimal(int(t)) for t in (away * away).sum(1)], pa.decimal128(38, 0))


def whitened(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS) -> DataFrame:
    """``vec_id``, ``dim``, ``n``, ``deviation``, and for each component up to ``components`` an entry of ``whitened`` and ``explained``.

    ``deviation`` is the exact sum of (n x - S)^2 over the dimensions. Components go by falling variance; the largest entry of
    an axis is positive. ``explained`` is the component's share of the whole variance.

    - Vectors that are null, empty, or hold null or non-finite entries are left out. A null ``vec_id`` stays null.
    - Each vector counts as often as it occurs. Equal variances have axes at right angles, which ones is left open.
    - A component without variance (all vectors equal, fewer vectors than dimensions) has null ``whitened``, and ``explained`` 0, or
      null if there is no variance at all.
    - Vectors of another dimension are fitted by themselves. Other columns are not looked at; an empty table gives an empty one.
    - An entry beyond 2^40 once scaled is an error.
    """
    found = axes(vectors, scale, shift)
    shared = vectors.sparkSession.sparkContext.broadcast(found)
    schema = pa.schema(
        [("vec_id", pa.int64()), ("dim", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0))]
        + [("whitened", pa.list_(pa.float64())), ("explained", pa.list_(pa.float64()))]
    )

    def run(batches):
        for batch in batches:
            for dim, rows, x in _matrices(batch, scale, shift):
                a = shared.value[dim]
                k = min(dim, components)
                spread = a.values[:k] > dim * np.finfo(float).eps * a.values[0]
                z = (x - a.mean) @ (a.vectors[:, :k][:, spread] / np.sqrt(a.values[:k][spread]))
                table = np.full((len(x), k), np.nan)
                table[:, spread] = z
                shares = np.maximum(a.values[:k], 0) / a.trace if a.values[0] > 0 else np.full(k, np.nan)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v.ravel(), from_pandas=True)) for v in (table, np.tile(shares, len(x)))]
                sizes = [pa.array(np.full(len(x), v), t) for v, t in ((dim, pa.int32()), (a.n, pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(rows)), *sizes, _deviations(x, a.n, a.sums), *lists], schema=schema
                )

    types = "vec_id long, dim int, n long, deviation decimal(38,0), whitened array<double>, explained array<double>"
    return _plain(vectors).mapInArrow(run, types)


def identity_error(rows: DataFrame, components: int = COMPONENTS) -> float | None:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity; None if nothing varies."""
    cells = [(i, j) for i in range(components) for j in range(i + 1)]
    entry = lambda i: F.get("whitened", F.lit(i))
    errors = [F.abs(F.covar_pop(entry(i), entry(j)) - int(i == j)) for i, j in cells]
    per_dim = rows.groupBy("dim").agg(F.array_max(F.array(*errors)).alias("error"))
    return per_dim.agg(F.max("error")).first()[0]


def whitened_components(vectors: DataFrame, **more) -> DataFrame:
    """A row for each vector and component: ``vec_id``, ``component`` from 1, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    rows = written(whitened(vectors, **more), "whitened")
    error = identity_error(rows, more.get("components", COMPONENTS))
    pairs = rows.select("vec_id", "n", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "c"))
    return pairs.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
