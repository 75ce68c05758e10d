import random

import numpy as np
import pytest

from maskframe.llm import topk


def by_hand(rows, every=50, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and all(np.isfinite(v)):
            good[i] = [int(np.floor(256.0 * x)) for x in v]
    out = set()
    for q, a in good.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good.items() if i != q and len(b) == len(a))
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


def vectors(seed, n, dim, spread):
    """Clusters, very different lengths, ties by repeated vectors, negative and zero ones."""
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        size = rnd.choice(spread)
        rows.append((i, [size * (c + rnd.gauss(0, 0.3)) for c in rnd.choice(centres)]))
    rows += [(n + j, rows[j % 7][1]) for j in range(20)] + [(n + 20, [0.0] * dim), (n + 21, [-1.0] * dim)]
    return rows


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return {tuple(r) for r in topk.top_products(df, **more).collect()}


@pytest.mark.parametrize("spread", [[1.0], [0.01, 1, 30], [0.5, 1, 2, 1000]])
def test_answers_are_exact(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rows = vectors(3, 500, 8, spread)
    assert run(spark, rows) == by_hand(rows)


def test_pruning_keeps_all_that_can_reach_the_bound():
    rnd = np.random.default_rng(2)
    for t in (0.05, 0.4, 0.9, 0.99):
        numbers = rnd.integers(-300, 300, (400, 16))
        lengths = np.sqrt((numbers**2).sum(1))
        order = np.argsort(-lengths)
        numbers, lengths = numbers[order], lengths[order]
        query = numbers[5] + rnd.integers(-20, 20, 16)
        size = float(np.sqrt((query**2).sum()))
        bound = t * size * lengths[0]
        left = set(topk.survivors(numbers / lengths[:, None], lengths, query, size, bound).tolist())
        assert set(np.flatnonzero(numbers @ query >= bound).tolist()) <= left
        assert t < 0.9 or len(left) < 200


def test_unusual_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [9.0, 9.0]), (50, [1.0, 2.0]), (51, [-1.0, 0.1]),
            (52, [1.0]), (100, [2.0]), (150, []), (151, []), (200, None), (250, [1.0, 2.0, 3.0])]
    assert run(spark, rows) == by_hand(rows)
    assert run(spark, rows + rows) == by_hand(rows)
    assert run(spark, [(1, [1.0])]) == set()
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, bucket string, part string")
    assert topk.top_products(df).count() == 0


def test_blocks_meet_without_a_join(spark, monkeypatch):
    """A table of query blocks looks small to Spark, and repeated for each block of vectors it would go to the driver."""
    monkeypatch.setattr(topk, "BLOCK", 20)
    rows = vectors(4, 600, 4, [1.0]) + [(i, v[:3]) for i, v in vectors(5, 200, 4, [0.2, 5])]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        found = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {tuple(r) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [word for word in ("Join", "Broadcast", "Generate") if word in plan], plan
    few, many = by_hand([r for r in rows if len(r[1]) == 3], 3), by_hand([r for r in rows if len(r[1]) == 4], 3)
    every = {}
    for query, _, other, score in few | many:
        every.setdefault(query, []).append((-score, other))
    assert got == {(q, n, i, -s) for q, found in every.items() for n, (s, i) in enumerate(sorted(found)[:5], 1)}


def test_large_products_are_exact():
    a = np.array([[2**40 + 1, 3], [2**40, 5]], np.int64)
    q = np.array([2**20 + 1, 7], np.int64)
    assert topk.products(a, q, False).tolist() == [(2**40 + 1) * (2**20 + 1) + 21, 2**40 * (2**20 + 1) + 35]
    with pytest.raises(OverflowError):
        topk.products(np.array([[2**61, 2**61]]), np.array([2**61, 2**61]), False)


def shaped(shape, seed, n, dim):
    """Vectors that lie along few axes: a dominant coordinate, one-hot or mostly zeros."""
    rnd = np.random.default_rng(seed)
    x = rnd.normal(0, 1, (n, dim))
    axis = rnd.integers(0, dim, n)
    if shape == "dominant":
        x[np.arange(n), axis] += rnd.choice([-4, 4], n)
    elif shape == "one-hot":
        x = np.eye(dim)[axis] * rnd.choice([-1, 1, 1.05], n)[:, None]
    elif shape == "sparse":
        x *= rnd.random((n, dim)) < 0.15
    return x * rnd.choice([1.0, 1.04, 3.0], n)[:, None]


SHAPES = [("dominant", 8), ("one-hot", 8), ("sparse", 16), ("low", 1), ("low", 2), ("low", 3), ("low", 4)]


@pytest.mark.parametrize("shape, dim", SHAPES)
def test_pruning_keeps_all_along_an_axis(shape, dim):
    for seed in range(4):
        numbers = np.floor(256 * shaped(shape, seed, 300, dim)).astype(np.int64)
        lengths = np.sqrt((numbers**2).sum(1))
        order = np.argsort(-lengths)
        numbers, lengths = numbers[order], lengths[order]
        units = numbers / np.maximum(lengths, 1)[:, None]
        for query in numbers[:280:7]:
            size = float(np.sqrt((query**2).sum()))
            for t in (0.3, 0.5, 0.7, 0.9, 0.99, 1):
                bound = t * size * lengths[0]
                left = set(topk.survivors(units, lengths, query, size, bound).tolist())
                assert set(np.flatnonzero(numbers @ query >= max(bound, 1)).tolist()) <= left


@pytest.mark.parametrize("shape, dim", SHAPES)
@pytest.mark.parametrize("scale", [256, 2**26])
def test_blocks_give_the_best_however_they_are_pruned(shape, dim, scale):
    """Alone by coordinates, together by length, or in whole numbers where floating point would round."""
    numbers = np.floor(scale * shaped(shape, 7, 300, dim)).astype(np.int64)
    numbers = numbers[np.argsort(-np.sqrt((numbers.astype(float) ** 2).sum(1)), kind="stable")]
    ids = np.random.default_rng(1).permutation(300)
    asked, q_ids = numbers[::6], ids[::6]
    found, bounds = [(np.array([], np.int64), np.array([], np.int64))] * len(asked), np.full(len(asked), -np.inf)
    for at in range(0, 300, 60):
        topk._score(found, bounds, q_ids, asked, ids[at : at + 60], numbers[at : at + 60], 5)
    for query, vector, (got, scores) in zip(q_ids, asked, found, strict=True):
        every = sorted((-sum(int(a) * int(b) for a, b in zip(vector, v, strict=True)), i) for i, v in zip(ids.tolist(), numbers, strict=True) if i != query)
        assert list(zip((-scores).tolist(), got.tolist(), strict=True)) == every[:5]
