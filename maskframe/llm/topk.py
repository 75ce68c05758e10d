"""Exact top-k by inner product, over buckets of vectors of similar length.

Vectors are put into buckets by their length and packed into blocks of bounded size, longest first. A query's scores
in the block of the longest vectors give a lower bound of its k-th score, which rises with what is found. Against any other block
that bound and the block's greatest length ask for a cosine t (after Teflioudi, Gemulla and Mykytiuk, "LEMP", 2015):

- t over 1: nothing in the block can do it.
- t from ``COORDINATE_FROM`` on: coordinate pruning. Where q has its largest coordinates, a unit vector with a cosine of at
  least t to q lies between t q_f - r and t q_f + r, r = sqrt((1 - t^2) (1 - q_f^2)); up to 1 where q_f >= t, as the axis
  itself is that close to q, and down to -1 where q_f <= -t.
- else, or if a sample of the block says that it would leave many: length pruning, as a vector must be at least bound / |q| long.

What is left is verified by its integer product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import new_folder
from .common import written
from .store import opened

SCALE, EVERY, TOP = 256, 50, 5
BLOCK, QUERY_BLOCK, FOCUS, COORDINATE_FROM = 1024, 256, 4, 0.3
SAMPLE, FEW = 32, 0.1  # vectors of a block that are looked at first, and the share of them that is few
RATIO = 1.1  # of the greatest to the least length in a bucket
_EPS = 1e-9


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``dim``, ``bucket`` and ``numbers``, little-endian 64-bit integers floor(scale * x), of the vectors that take part."""
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("bucket", pa.int32()), ("numbers", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for number, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if number is None or vector is None or None in vector:
                    continue
                x = np.floor(scale * np.asarray(vector, np.float64))
                if not np.isfinite(x).all():
                    continue
                if np.abs(x).max(initial=0) >= 2.0**62:
                    raise ValueError(f"a component of vector {number} does not fit a 64-bit integer")
                length = float(np.sqrt((x * x).sum()))
                bucket = int(np.floor(np.log(length) / np.log(RATIO))) if length else -1
                rows.append({"vec_id": number, "dim": len(x), "bucket": bucket, "numbers": x.astype("<i8").tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return plain.mapInArrow(run, "vec_id long, dim int, bucket int, numbers binary").dropDuplicates(["vec_id", "numbers"])


def _blocks(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Rows packed by ``keys`` into blocks of about ``most``: ``dim``, ``n``, ``longest``, ``ids`` and ``numbers``, longest first."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    dealt = rows.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("vec_id", "numbers"), F.col("parts")))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        dim = int(frame["dim"].iloc[0])
        numbers = np.array([np.frombuffer(b, "<i8") for b in frame["numbers"]], np.int64).reshape(len(frame), dim)
        ids = frame["vec_id"].to_numpy(np.int64)
        lengths = _lengths(numbers)
        order = np.lexsort((ids, -lengths))
        return pd.DataFrame({
            "dim": [dim], "n": [len(ids)], "longest": [float(lengths.max())],
            "ids": [ids[order].astype("<i8").tobytes()], "numbers": [numbers[order].astype("<i8").tobytes()],
        })

    chosen = dealt.select("dim", "vec_id", "numbers", *[k for k in keys if k != "dim"], "part")
    return chosen.groupBy(*keys, "part").applyInPandas(packed, "dim int, n long, longest double, ids binary, numbers binary")


def _lengths(numbers: np.ndarray) -> np.ndarray:
    x = numbers.astype(np.float64)
    return np.sqrt((x * x).sum(1))


def _open(ids: bytes, numbers: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, "<i8")
    return found, np.frombuffer(numbers, "<i8").reshape(len(found), dim)


def products(numbers: np.ndarray, query: np.ndarray, safe: bool) -> np.ndarray:
    """Exact inner products; in floating point where all sums are below 2^53."""
    if safe:
        return (numbers.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    out = [sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in numbers]
    return np.array(out, np.int64)  # an OverflowError if a score does not fit


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, of equals the smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def survivors(units: np.ndarray, lengths: np.ndarray, query: np.ndarray, size: float, bound: float) -> np.ndarray:
    """Places in a block, longest first, that can reach ``bound``; ``size`` is the query's length."""
    if bound <= 0 or not size or not len(lengths):
        return np.arange(len(lengths)) if bound <= 0 else np.arange(0)
    longest = lengths[0]
    t = bound / (size * longest) - _EPS if longest else np.inf
    if t > 1:
        return np.arange(0)
    long_enough = int(np.searchsorted(-lengths, -(bound / size) * (1 - _EPS), "right"))
    if t < COORDINATE_FROM:
        return np.arange(long_enough)
    unit = query / size
    focus = np.argsort(-np.abs(unit))[:FOCUS]
    reach = np.sqrt(np.maximum(0, (1 - t * t) * (1 - unit[focus] ** 2))) + 1e-7
    # np.inf for 1: units are rounded; 1e-7 as t, size and unit are rounded too
    low = np.where(unit[focus] <= -t + 1e-7, -np.inf, t * unit[focus] - reach)
    high = np.where(unit[focus] >= t - 1e-7, np.inf, t * unit[focus] + reach)
    part = units[:long_enough, focus]
    return np.flatnonzero(((part >= low) & (part <= high)).all(1))


def _few_left(sample: np.ndarray, asked: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each unit query whether coordinate pruning leaves few of a sample of unit vectors, with the intervals of ``survivors``."""
    focus = np.argsort(-np.abs(asked), axis=1)[:, :FOCUS]
    own, t = np.take_along_axis(asked, focus, 1), t[:, None]
    reach = np.sqrt(np.maximum(0, (1 - t * t) * (1 - own**2)))
    part = sample[:, focus]
    inside = ((part >= t * own - reach) | (own <= -t)) & ((part <= t * own + reach) | (own >= t))
    return inside.all(2).mean(0) <= FEW


def _score(found: list, bounds: np.ndarray, q_ids: np.ndarray, asked: np.ndarray, ids: np.ndarray, numbers: np.ndarray, k: int) -> None:
    """Put those of a block that are among the best into ``found``, ids and scores for each query; ``bounds`` rise with them.

    As in LEMP a sample of the block tells how a query prunes it: by coordinates if that leaves few, else by length
    alone. Products of the latter are made for all such queries at once.
    """

    def merge(i: int, places: np.ndarray, scores: np.ndarray) -> None:
        others = ids[places] != q_ids[i]
        those, scores = np.concatenate([found[i][0], ids[places][others]]), np.concatenate([found[i][1], scores[others]])
        at = best(scores, those, k)
        found[i] = those[at], scores[at]
        if len(at) == k:
            bounds[i] = max(bounds[i], float(scores[at[-1]]))

    lengths, sizes = _lengths(numbers), _lengths(asked)
    safe = lengths.max(initial=0) * sizes.max(initial=0) < 2.0**52
    most = sizes * lengths[0]
    t = np.where(bounds <= 0, -np.inf, np.where(most > 0, bounds / np.where(most > 0, most, 1) - _EPS, np.inf))
    alone = np.flatnonzero((t <= 1) & ((t >= COORDINATE_FROM) | (not safe)))
    if safe and len(alone):
        sample = numbers[:: max(1, len(numbers) // SAMPLE)], lengths[:: max(1, len(numbers) // SAMPLE)]
        unit = asked[alone] / sizes[alone][:, None]
        alone = alone[_few_left(sample[0] / np.maximum(sample[1], 1)[:, None], unit, t[alone])]
    if len(alone):
        units = np.asfortranarray(numbers / np.maximum(lengths, 1)[:, None])
        for i in alone:
            left = survivors(units, lengths, asked[i], sizes[i], bounds[i])
            if len(left):
                merge(i, left, products(numbers[left], asked[i], safe))
    together = np.setdiff1d(np.flatnonzero(t <= 1), alone)
    if not len(together):
        return
    least = np.where(bounds[together] > 0, bounds[together] / np.maximum(sizes[together], _EPS), -np.inf)
    enough = int(np.searchsorted(-lengths, -least.min() * (1 - _EPS), "right"))  # for the query that asks for the shortest
    scores = asked[together].astype(np.float64) @ numbers[:enough].astype(np.float64).T
    reached = scores >= bounds[together][:, None]
    for j in np.flatnonzero(reached.any(1)):
        places = np.flatnonzero(reached[j])
        merge(together[j], places, scores[j, places].astype(np.int64))


def _kept(blocks: DataFrame, label: str) -> tuple[str, int]:
    """The folder blocks are written to, each in a row group of its own, so that it can be read alone; and how many there are."""
    folder = new_folder(blocks.sparkSession, label)
    blocks.write.option("parquet.block.row.count.limit", 1).parquet(folder)
    return folder, blocks.sparkSession.read.schema(blocks.schema).parquet(folder).count()


def _places(folder: str) -> list[tuple[pq.ParquetFile, int, int]]:
    """Where the blocks in a folder are, by table, row group and row, in an order that is the same for all tasks."""
    files, path = opened(folder)
    found = sorted(f.path for f in files.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-"))
    tables = [pq.ParquetFile(name, filesystem=files) for name in found]
    groups = [(table, group) for table in tables for group in range(table.num_row_groups)]
    return [(table, group, row) for table, group in groups for row in range(table.metadata.row_group(group).num_rows)]


def _row(place: tuple[pq.ParquetFile, int, int], *columns: str) -> list:
    table, group, row = place
    found = table.read_row_group(group, list(columns), use_threads=False)
    return [found.column(c)[row].as_py() for c in columns]


def _search(spark: SparkSession, queries: tuple[str, int], blocks: str, k: int) -> DataFrame:
    """The best of all blocks for each query: a task for each query block, which opens the blocks of its dimension, longest first."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches):
        for number in (n for batch in batches for n in batch.column("id").to_pylist()):
            dim, *row = _row(_places(queries[0])[number], "dim", "ids", "numbers")
            q_ids, asked = _open(*row, dim)
            sizes, none = _lengths(asked), np.array([], np.int64)
            bounds, found = np.full(len(q_ids), -np.inf), [(none, none)] * len(q_ids)
            sized = [(*_row(place, "dim", "longest"), place) for place in _places(blocks)]
            for _, longest, place in sorted((x for x in sized if x[0] == dim), key=lambda x: -x[1]):
                if (bounds * (1 - 2 * _EPS) > sizes * longest).all() and (bounds > 0).all():
                    break  # the others are shorter
                _score(found, bounds, q_ids, asked, *_open(*_row(place, "ids", "numbers"), dim), k)
            answers = [np.repeat(q_ids, [len(v) for v, _ in found]), *(np.concatenate(x) for x in zip(*found, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in answers], schema=schema)

    return spark.range(0, queries[1], 1, max(1, queries[1])).mapInArrow(search, "query_id long, vec_id long, score long")


def top_products(vectors: DataFrame, every: int = EVERY, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score``: the ``k`` best others of each vector whose id is divisible by ``every``.

    Equal scores go to the smaller ``vec_id``. A query with fewer others gets all of them.

    - Vectors that are null, hold nulls or non-finite components, or have a null id take no part.
    - Vectors of different dimensions are not compared. Rows that repeat an id and a vector are one; a row with
      the query's id is never its answer.
    - A component beyond 2^62 after scaling, or a score beyond 64 bits, is an error.
    - Other columns are not looked at. An empty table gives an empty one.
    - Blocks meet without a join: a query block is a task, which opens the blocks in the shared folder one after the other
      and holds one at a time. No row is repeated for it, and what is shuffled of the answers is ``k`` rows a query.
    """
    spark = vectors.sparkSession
    rows = written(whole_vectors(vectors, scale), "vectors")
    blocks, _ = _kept(_blocks(rows, ["dim", "bucket"], BLOCK), "blocks")
    asked = rows.where(F.col("vec_id") % every == 0).select("dim", "vec_id", "numbers")
    # As many queries a block as keep all tasks of a shuffle busy; every block reads all vectors of its dimension.
    most = min(QUERY_BLOCK, max(16, -(-asked.count() // max(32, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    found = _search(spark, _kept(_blocks(asked, ["dim"], most), "queries"), blocks, k)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
