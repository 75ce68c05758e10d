import random

import numpy as np
import pytest

from maskframe.llm import fingerprints, near_dedup
from maskframe.llm.components import components

from . import brute
from .conftest import texts


def corpus(seed, n=120, groups=12):
    """Groups of copies with words changed at many rates, chains of them, shared passages, short texts, ties."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [rnd.choice(vocab) for _ in range(60)]
    rows, i = [], 0
    for g in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 8, 40, 150, 400]))]
        if g % 3 == 0:
            base += passage
        for _ in range(rnd.randint(1, n // groups)):
            copy = [w if rnd.random() > rnd.choice([0, 0.005, 0.02, 0.04, 0.08]) else rnd.choice(vocab) for w in base]
            rows.append((i, " ".join(copy)))
            if rnd.random() < 0.3:
                base = copy  # a chain: the ends need not be alike
            i += 1
    rnd.shuffle(rows)
    return rows


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_components_are_those_of_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_components(docs, width=4)
    assert found(got) == brute.components(rows, 4)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_minhash_bands_find_the_same(spark):
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(fingerprints.alike(docs)) == brute.components(rows, 5)


def test_a_large_group_of_near_copies_is_not_compared_in_all_pairs(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(300)]
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(3):
            copy[rnd.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_dedup.near_components(docs, width=4)) == brute.components(rows, 4)


def test_sketch_estimates_similarity_and_fills():
    rnd = np.random.default_rng(4)
    for n in (1, 2, 7, 50, 1000):
        x = rnd.integers(0, 1 << 62, 2 * n).astype(np.uint64)
        a, b = x[: n + n // 2], x[n // 2 :]
        s, t = near_dedup.sketch(a), near_dedup.sketch(b)
        assert len(s) == near_dedup.COORDINATES and (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(x.tolist()))
        assert abs((s == t).mean() - true) < 0.15
        assert (near_dedup.sketch(a[::-1]) == s).all()


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(500, 500), (7, 3), (None, 4)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_unusual_rows(spark, odd, with_clashes, empty):
    null_id = spark.createDataFrame([(None, "one two three", "en", "s", 13)], odd.schema)
    for df in (odd.union(null_id), with_clashes):
        rows = near_dedup.near_components(df, width=4).collect()
        assert len(rows) == df.count()
        comp = {r["doc_id"]: r["component_id"] for r in rows}
        assert comp[4] == comp[5] == comp[6] == 4 and comp[7] == comp[8] == 7
        assert all(comp[i] == i for i in (1, 2, 3, 9, 10, 11, 12, 13, 14))
        kept = near_dedup.keep_one(df)
        assert kept.columns == df.columns
        assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 3, 4, 7, 9, 10, 11, 12, 13, 14]
    assert near_dedup.keep_one(odd.union(null_id)).where("doc_id is null").count() == 1
    assert near_dedup.keep_one(empty).count() == 0
    assert dict(texts(odd))[5] == "one two three"


def test_an_id_with_two_texts_is_linked_by_both(spark):
    rnd = random.Random(3)
    a, b = ([f"{c}{rnd.randint(0, 999)}" for _ in range(200)] for c in "ab")
    near = [[*words[:100], "other", *words[101:]] for words in (a, b)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, " ".join(near[0])), (7, " ".join(near[1])), (8, "nothing like it at all")]
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), width=5).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 8)]


def test_shuffles_of_sketches_are_given_back_before_sets_are_shuffled(spark, monkeypatch):
    steps, write, give_back = [], near_dedup.written_to, near_dedup.release
    monkeypatch.setattr(near_dedup, "written_to", lambda df, label: (steps.append(label), write(df, label))[1])
    monkeypatch.setattr(near_dedup, "release", lambda *a: (steps.append("release"), give_back(*a))[1])
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "x"])), (3, "other words here only")], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    at = steps.index("alike")
    assert steps[at : at + 3] == ["alike", "release", "links"]
