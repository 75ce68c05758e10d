"""Periodic runs of words: stretches in which every word equals the one a period further on.

A run is a stretch of consecutive words with smallest period q and at least ``max(shortest, times * q)`` words, that no
neighbouring word extends. Each of its words occurs at least ``times`` times in it, so a word that occurs less often
in a segment of the text is in no run inside that segment and splits it. What is left is counted again and split until nothing
changes; a text in which nothing repeats is gone after a few steps. Pieces below ``shortest`` words are dropped.

The segments that survive are scanned by lag. In a run of period q at least s = ``max(shortest, times * q)`` - q words in a row equal those q
further on, so (s + 1) / 2 of them fill an aligned block of that size, and no less than q words. Only such blocks are compared, by hashes
from running sums: about m log m of them in m words, for all lags together. Blocks that agree are extended word by word to the whole stretch. A block inside a run of a smaller period is passed over:
two periods in more words than their sum have a common one (Fine and Wilf, 1965), so the stretch is that run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices

SHORTEST, TIMES = 24, 3
_LAGS, _PAIRS = 8, 1 << 20  # a round of the scan takes this many times as many lags as came before, and about this many blocks
_BASE = 0x9E3779B97F4A7C15

Run = tuple[int, int, int]


def segments(ids: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> Iterator[tuple[int, int]]:
    """The stretches, ends exclusive, in which every word occurs ``times`` times at least.

    Of the pieces of a split the largest is not counted again: only words of the rest can have become too rare in it. So a word is
    counted again only in a piece of at most half the size, log n times at most.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    places = ids[order] * (n + 1) + order  # sorted; the places of a word in a segment are one range of these
    stack = [(0, n, ids)]  # a segment and the words that may be too rare in it
    while stack:
        start, end, suspects = stack.pop()
        if end - start < shortest:
            continue
        words = np.unique(suspects)
        first = np.searchsorted(places, words * (n + 1) + start)
        count = np.searchsorted(places, words * (n + 1) + end) - first
        rare = (count > 0) & (count < times)
        if not rare.any():
            yield start, end
            continue
        first, count = first[rare], count[rare]
        at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        cuts = np.sort(order[at])
        starts, ends = np.append(start, cuts + 1), np.append(cuts, end)
        largest = int(np.argmax(ends - starts))
        for i in np.flatnonzero(ends - starts >= shortest):
            a, b = int(starts[i]), int(ends[i])
            stack.append((a, b, ids[a:b] if i != largest else np.concatenate([ids[start:a], ids[b:end]])))


def _stretch(ids: np.ndarray, lag: int, at: int, size: int) -> tuple[int, int]:
    """Start and end of the longest stretch around ``at`` in which words a lag apart are equal, given that ``size`` places there are."""
    low, high, step = at, at + size, 64
    while low > 0:
        a = max(0, low - step)
        differ = np.flatnonzero(ids[a:low] != ids[a + lag : low + lag])
        if len(differ):
            low = a + int(differ[-1]) + 1
            break
        low, step = a, step * 2
    step = 64
    while high + lag < len(ids):
        b = min(len(ids) - lag, high + step)
        differ = np.flatnonzero(ids[high:b] != ids[high + lag : b + lag])
        if len(differ):
            high += int(differ[0])
            break
        high, step = b, step * 2
    return low, high + lag


def scan(ids: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[Run]:
    """The runs of a segment as (start, length, period)."""
    m, out = len(ids), []
    # the hash of ids[a:b] is sums[b] - sums[a], and a lag further on the same times powers[lag]
    powers = np.full(m + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.zeros(m + 1, np.uint64)
    np.cumsum(mix64(ids.astype(np.uint64) + np.uint64(1)) * powers[:m], out=sums[1:])
    reach = np.zeros(m, np.int64)  # where the run that starts no later than here and ends last does end
    low, most = 1, m // times
    while low <= most:
        high = min(most, low * _LAGS)
        lags = np.arange(low, high + 1)
        sizes = (np.maximum(shortest, times * lags) - lags + 1) // 2
        fit = np.maximum(0, (m - lags) // sizes)
        if fit.sum() > _PAIRS:  # as many lags as have so many blocks, one at least
            keep = max(1, int(np.searchsorted(np.cumsum(fit), _PAIRS)))
            lags, sizes, fit = lags[:keep], sizes[:keep], fit[:keep]
        low = int(lags[-1]) + 1
        lag, size = np.repeat(lags, fit), np.repeat(sizes, fit)
        at = (np.arange(len(lag)) - np.repeat(np.cumsum(fit) - fit, fit)) * size
        same = (sums[at + size] - sums[at]) * powers[lag] == sums[at + lag + size] - sums[at + lag]
        same &= reach[at] < at + lag + size
        for q in np.unique(lag[same]).tolist():
            here = same & (lag == q)
            found, length = at[here], int(size[here][0])
            done = 0
            for a in found[reach[found] < found + q + length].tolist():
                if a < done or not np.array_equal(ids[a : a + length], ids[a + q : a + q + length]):
                    continue
                start, end = _stretch(ids, q, a, length)
                done = end - q
                if end - start >= max(shortest, times * q) and reach[start] < end:
                    out.append((start, end - start, q))
                    reach[start:end] = np.maximum(reach[start:end], end)
    return out


def runs_of(words: list[bytes], shortest: int = SHORTEST, times: int = TIMES) -> list[Run]:
    """The runs of a text as (start, length, period), by start, then period."""
    if len(words) < shortest:
        return []
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    found = [(a + s, n, q) for a, b in segments(ids, shortest, times) for s, n, q in scan(ids[a:b], shortest, times)]
    return sorted(found, key=lambda run: (run[0], run[2]))


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that are in no run, or in the first period of each run they are in."""
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """For each row of ``docs``: ``doc_id``, ``runs`` (start, length, period, numbered by words from 0) and ``collapsed``.

    Words are what ASCII white space separates. ``collapsed`` is the text's words outside the repetitions, one space between two:
    of a run the first period stays, unless another run drops it.

    - A null text is an empty one: no runs, and an empty text collapsed. A null ``doc_id`` stays null.
    - Equal texts have equal runs; repeated rows come as often as they are. Other columns are not looked at.
    - Whole texts are scanned, in memory a few times that of the text and time about n log n in its words.
    - An empty table gives an empty one.
    """
    if times < 3:
        raise ValueError("a run has three periods at least")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("runs", run_type), ("collapsed", pa.string())])

    def scanned(batches):
        for batch in slices(batches):
            runs, left = [], []
            for text in batch.column("text").to_pylist():
                words = text.encode("utf-8").split()  # bytes split at ASCII white space only
                found = runs_of(words, shortest, times)
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                left.append(b" ".join(kept_words(words, found) if found else words).decode("utf-8"))
            columns = [pa.array(runs, run_type), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=schema)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return plain.mapInArrow(scanned, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest_repeat(runs: Column) -> Column:
    """The run with the greatest length for its period, compared exactly; of equal ones the first, then that of smaller period."""

    def order(a: Column, b: Column) -> Column:
        by_exponent = b["length"] * a["period"] - a["length"] * b["period"]
        gap = F.when(by_exponent != 0, by_exponent).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])
        return F.signum(gap).cast("int")

    return F.get(F.array_sort(runs, order), 0)


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, the words of every tenth document or so repeating themselves from some place to the end.

    With h the CRC-32 of the decimal ``doc_id`` and g = floor(h / 10), a text of n words is changed where h % 10 = 0 and n > 0: each
    word i from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.crc32(F.col("doc_id").cast("string"))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), hashed.alias("h"))
    split = split.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("g", F.floor(F.col("h") / 10))
    placed = split.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    places = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))),
    )
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.concat_ws(" ", places)).otherwise(F.col("text")).alias("text"))
