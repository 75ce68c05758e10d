import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe.llm import spectra, whitening
from maskframe.llm.queries import QUERIES

from .conftest import SF

VECTORS = "vec_id long, embedding array<double>"


def scatter(rows):
    centred = rows - rows.mean(0)
    return centred.T @ centred


def some_rows(kind, n, dim, seed=0):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-300, 300, (n, dim)).astype(float) + 100_000
    return {
        "plain": rows,
        "equal": np.repeat(rows[:1], n, 0),
        "flat": np.where(np.arange(dim) < dim // 2, rows, 3.0),
        "axes": np.eye(dim)[np.arange(n) % dim] * 1000,
        "graded": (rows - 100_000) * np.logspace(0, 6, dim),
        "clusters": rows[np.arange(n) % 3],
    }[kind]


def same(spectrum, rows):
    whole = scatter(rows)
    size = max(np.abs(whole).max(), 1)
    dim = rows.shape[1]
    assert spectrum.rows == len(rows) and np.allclose(spectrum.mean, rows.mean(0), rtol=1e-12)
    assert np.abs(spectrum.vectors.T @ spectrum.vectors - np.eye(dim)).max() < 1e-12
    assert np.abs(spectrum.vectors * spectrum.values @ spectrum.vectors.T - whole).max() < 1e-10 * size


@pytest.mark.parametrize("kind", ["plain", "equal", "flat", "axes", "graded", "clusters"])
@pytest.mark.parametrize("dim", [1, 2, 7, 40])
def test_updates_and_merges_have_the_scatter_of_all_rows(kind, dim):
    rows = some_rows(kind, 150, dim)
    whole = spectra.Spectrum.nothing(dim)
    for a, b in ((0, 1), (1, 4), (4, 60), (60, 150)):
        whole = spectra.with_rows(whole, rows[a:b])
        same(whole, rows[:b])
    parts = [spectra.with_rows(spectra.Spectrum.nothing(dim), rows[a:b]) for a, b in ((0, 70), (70, 71), (71, 150))]
    same(spectra.merged(spectra.merged(parts[0], parts[1]), parts[2]), rows)


def test_roots_lie_between_the_poles():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 20):
        poles = np.sort(rng.random(n)) * 10.0 ** rng.integers(-6, 6)
        weights = rng.random(n) ** 4 + 1e-12
        nearer, x = spectra.secular_roots(poles, weights)
        roots = poles[nearer] + x
        assert np.allclose(np.sort(roots), np.linalg.eigvalsh(np.diag(poles) + np.outer(np.sqrt(weights), np.sqrt(weights))), rtol=1e-9, atol=1e-12)
        assert (roots >= poles).all() and (roots[:-1] <= poles[1:]).all()


def by_hand(rows, k=8):
    """One dense decomposition; axes signed by their largest entry."""
    good = [(i, v) for i, v in rows if v and None not in v and all(map(math.isfinite, v))]
    whole = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in good]
    n, sums = len(good), [sum(c) for c in zip(*whole, strict=True)]
    x = np.array(whole, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(x.T @ x / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])])
    z = x @ vectors / np.sqrt(values)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in whole]
    share = values / np.trace(x.T @ x / n)
    return {(i, c + 1): (n, deviation[r], z[r, c], share[c]) for r, (i, _) in enumerate(good) for c in range(z.shape[1])}


def check(found, expected):
    got = {(r["vec_id"], r["component"]): r for r in found}
    assert got.keys() == expected.keys() and len(found) == len(expected)
    for key, (n, deviation, z, share) in expected.items():
        r = got[key]
        assert (r["n"], int(r["deviation"])) == (n, deviation)
        assert abs(r["whitened"] - z) < 1e-8 and abs(r["explained"] - share) < 1e-9 * share
        assert r["identity_error"] < 1e-9


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(QUERIES["op13_whitening"](spark, SF).collect(), by_hand(rows))


@pytest.mark.parametrize("dim", [1, 3, 12])
def test_many_partitions_and_hot_rows(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(c) for c in rng.normal(0, 0.1 * np.arange(1, dim + 1))]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(300)]
    df = spark.createDataFrame(rows, VECTORS).repartition(37)
    check(whitening.whitened_components(df).collect(), by_hand(rows))


def test_deviation_beyond_a_long_is_exact(spark):
    rows = [(0, [9e8, -9e8]), (1, [1.5, 0.0]), (2, [-9e8, 9e8])]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect()}
    whole = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    assert [got[i] for i in range(3)] == [sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in whole]
    assert got[0] > 1 << 63
    with pytest.raises(Exception, match="beyond"):
        whitening.whitened(spark.createDataFrame([(1, [1e300])], VECTORS)).collect()


def test_unusual_rows(spark):
    rng = np.random.default_rng(3)
    plain = [(i, [float(c) for c in rng.normal(0, 1, 4)]) for i in range(60)]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [math.nan] * 4), (103, [math.inf, 0.0, 0.0, 0.0]), (104, [])]
    rows = plain + odd + [plain[3], plain[3], (None, [0.5, 0.25, -1.0, 2.0])]
    df = spark.createDataFrame(rows, VECTORS)
    clash = df
    for c in ("dim", "part", "n", "sums", "mean", "values", "vectors", "cells", "component", "whitened", "explained", "label"):
        clash = clash.withColumn(c, F.lit("x"))
    expected = by_hand(rows)
    for frame in (df, clash):
        found = whitening.whitened_components(frame).collect()
        assert len(found) == 4 * 63
        check([r for r in found if r["vec_id"] != 3] + [r for r in found if r["vec_id"] == 3][:4], expected)
    other = spark.createDataFrame([(200 + i, [float(c) for c in rng.normal(0, 1, 2)]) for i in range(9)], VECTORS)
    both = whitening.whitened_components(df.unionByName(other)).collect()
    assert {r["n"] for r in both if (r["vec_id"] or 0) < 100} == {63} and {r["n"] for r in both if (r["vec_id"] or 0) >= 200} == {9}
    assert whitening.whitened_components(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whitened_components(spark.createDataFrame(odd, VECTORS)).count() == 0


def test_components_without_variance(spark):
    one = whitening.whitened_components(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], VECTORS)).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in one] == [(None, None, None, 0)] * 4
    line = whitening.whitened_components(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], VECTORS)).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)}
    assert all(r["identity_error"] < 1e-9 for r in line)
