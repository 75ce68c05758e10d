import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from maskframe.llm import runs
from maskframe.llm.queries import QUERIES

from .conftest import SF, texts


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs_by_hand(words, shortest=24, times=3):
    """Every stretch of every lag, word by word; a stretch counts under its smallest lag."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, times * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def repeated_by_hand(doc_id, text):
    words = words_of(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def row_by_hand(words):
    found = runs_by_hand(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    shape = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *shape, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def some_words(rnd, alphabet, n):
    """Noise, and stretches that repeat, some inside others, some with one word wrong."""
    out = []
    while len(out) < n:
        part = [rnd.choice(alphabet) for _ in range(rnd.randint(1, 14))]
        if rnd.random() < 0.5:
            part = part * rnd.randint(2, 9) + part[: rnd.randint(0, len(part))]
        if rnd.random() < 0.2:
            part = part * rnd.randint(2, 4)
        if rnd.random() < 0.3:
            part[rnd.randrange(len(part))] = rnd.choice(alphabet)
        out += part
    return out[:n]


@pytest.mark.parametrize("letters", [1, 2, 3, 30])
@pytest.mark.parametrize("shortest, times", [(24, 3), (3, 3), (10, 4), (1, 3)])
def test_runs_are_those_of_all_lags(letters, shortest, times):
    rnd = random.Random(letters)
    for _ in range(60):
        words = some_words(rnd, [b"%d" % i for i in range(letters)], rnd.randint(0, 260))
        assert runs.runs_of(words, shortest, times) == runs_by_hand(words, shortest, times), words


def test_few_blocks_a_round(monkeypatch):
    monkeypatch.setattr(runs, "_PAIRS", 7)
    rnd = random.Random(9)
    for _ in range(40):
        words = some_words(rnd, [b"a", b"b"], 200)
        assert runs.runs_of(words) == runs_by_hand(words)


def test_segments_hold_no_rare_word_and_all_runs():
    rnd = random.Random(4)
    for _ in range(200):
        ids = np.array([rnd.randrange(12) for _ in range(rnd.randint(1, 120))], np.int64)
        found = sorted(runs.segments(ids, 5, 3))
        expected, todo = [], [(0, len(ids))]
        while todo:
            a, b = todo.pop()
            rare = [i for i in range(a, b) if (ids[a:b] == ids[i]).sum() < 3]
            if rare:
                todo += list(zip([a, *(i + 1 for i in rare)], [*rare, b], strict=True))
            elif b - a >= 5:
                expected.append((a, b))
        assert found == sorted(expected)


@pytest.mark.parametrize(
    "words",
    [[b"a"] * 300_000, [b"a", b"b"] * 150_000, [b"%d" % (i % 90_000) for i in range(300_000)], [b"%d" % (i * i % 7919) for i in range(300_000)]],
)
def test_long_texts(words):
    start = time.time()
    found = runs.runs_of(words)
    assert time.time() - start < 60 and len(found) <= 1
    assert not found or found[0][:2] == (0, 300_000)


def test_splits_that_go_one_word_at_a_time():
    """A chain in which each split makes one more word too rare, at the end of a long segment."""
    n = 40_000
    ids = np.arange(n, dtype=np.int64) // 3
    ids[::3] = np.roll(ids[::3], 1)
    start = time.time()
    assert all((np.bincount(ids[a:b] - ids[a:b].min())[ids[a:b] - ids[a:b].min()] >= 3).all() for a, b in runs.segments(ids))
    assert time.time() - start < 60


def test_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    docs = texts(spark.read.parquet(f"{SF}/documents.parquet"))
    assert len(got) == len(docs)
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = 0
    for i, text in docs:
        expected = row_by_hand(repeated_by_hand(i, text))
        assert tuple(got[i][c] for c in columns) == expected
        found += expected[0]
    assert found > 10


def test_unusual_rows(spark, odd, with_clashes, empty):
    expected = sorted((i, runs_by_hand(words_of(t)) if i not in (7, 8) else None) for i, t in texts(odd))
    for df in (odd, with_clashes):
        found = runs.periodic_runs(df).collect()
        got = sorted((r["doc_id"], [tuple(x) for x in r["runs"]] if r["doc_id"] not in (7, 8) else None) for r in found)
        assert got == expected
        left = {r["doc_id"]: r["collapsed"] for r in found}
        assert left[1] == left[2] == left[3] == "" and left[13] == "tab and more\x1cx" and left[14].count("a@b.c") == 1
        planted = runs.with_repeats(df)
        assert planted.columns == ["doc_id", "text"]
        assert sorted((i, words_of(t)) for i, t in texts(planted)) == sorted((i, repeated_by_hand(i, t)) for i, t in texts(df))
    assert runs.periodic_runs(empty).count() == 0 and runs.with_repeats(empty).count() == 0
    nameless = spark.createDataFrame([(None, "a " * 30), (None, None)], "doc_id long, text string")
    assert sorted(len(r["runs"]) for r in runs.periodic_runs(runs.with_repeats(nameless)).collect()) == [0, 1]
    with pytest.raises(ValueError, match="three periods"):
        runs.periodic_runs(empty, times=2)


def test_ties_go_to_the_first_and_then_the_smaller_period(spark):
    lists = [([(5, 30, 3), (0, 40, 4), (9, 60, 6)], (0, 40, 4)), ([(2, 24, 2), (2, 36, 3)], (2, 24, 2)), ([(0, 100, 33), (7, 301, 99)], (7, 301, 99)), ([], None)]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(lists)], "i int, runs array<struct<start:long,length:long,period:long>>")
    got = {r["i"]: r["best"] for r in df.select("i", runs.longest_repeat(df["runs"]).alias("best")).collect()}
    assert [got[i] and tuple(got[i]) for i in range(4)] == [best for _, best in lists]
