"""Raw values that stand anywhere in scrubbed tables: in other columns, other tables, inside longer text.

All protected values are looked for in one pass over the text. A value of up to ``PIECE`` bytes is one piece; a longer one is cut
into pieces of ``PIECE`` bytes, the last of which ends where it ends. A task hashes the windows of every length that
pieces have, all places of a batch at once, and keeps those whose hashes are set in a bitmap of all pieces, at four places for
each. The bitmap's size is bounded; what it lets through is compared by 128-bit hashes in joins. For a longer value its rarest piece leads: only where that one stands are
its other pieces asked for, at their distances. Nothing is cut off: a bitmap that is too full for its pieces costs time and loses nothing.

Windows are of UTF-8 bytes, so what is found is a stretch of characters. Only hashes and places are shuffled, not values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import CharType, StringType, VarcharType

from ..functions.transforms import source_column
from ..workspace import kept
from .reports import union_all

PIECE = 32  # bytes; a text of this many is unlikely to stand in two places by chance
BATCH_BYTES, SCAN_BYTES = 4 << 20, 1 << 20  # texts taken together, and places of them whose windows are hashed at once
BITMAP_BITS = (16, 29)  # least and greatest exponent of the bitmap's size: 8 KB to 64 MB
BITS_PER_PIECE = 32  # four of which are set: fewer than one window in 5,000 gets through that is no piece, up to 16 million pieces
_BLOCK = 1 << 15  # bits in one value of bitmap_construct_agg

_PIECES = "source string, value binary, pieces int, at int, size int, h1 long, h2 long"
_HITS = "target string, part int, row long, at long, size int, h1 long, h2 long"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _words(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there on as a number; zeros follow the data."""
    wide = np.concatenate([data, np.zeros(PIECE + 8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(wide) - 7, np.uint64)
    for i in range(8):
        out |= wide[i : len(out) + i] << np.uint64(8 * i)
    return out


def _hashed(word: Callable[[int], np.ndarray], count: int, size: int, seed: int) -> np.ndarray:
    """The hashes of so many windows of ``size`` bytes; ``word`` has the eight bytes from a distance on, for all of them."""
    h = np.full(count, (size << 8) + seed, np.uint64)
    for i in range(0, size, 8):
        part = word(i)
        if size - i < 8:
            part = part & np.uint64((1 << 8 * (size - i)) - 1)
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + part)
    return h


def _cuts(size: int) -> list[int]:
    """Where the pieces of a value of so many bytes start."""
    return [0] if size <= PIECE else [*range(0, size - PIECE, PIECE), size - PIECE]


def _slices(batches, column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + BATCH_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column one after the other, and where each starts; the last entry is the end."""
    texts = pc.fill_null(column, "").cast(pa.large_binary())
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = b"".join(texts.to_pylist())
    return np.frombuffer(joined, np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType | VarcharType | CharType)]


def _texts(frames: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """(name, text) of the named columns, in one pass over each table; a name is ``table.column``."""
    parts = []
    for table, names in columns.items():
        if names:
            cells = [F.struct(F.lit(f"{table}.{c}").alias("name"), source_column(c).cast("string").alias("text")) for c in names]
            parts.append(frames[table].select(F.inline(F.array(*cells))).where("text <> ''"))
    spark = next(iter(frames.values())).sparkSession
    return union_all(parts) if parts else spark.createDataFrame([], "name string, text string")


def value_pieces(values: DataFrame) -> DataFrame:
    """The pieces of distinct values, given as (name, text): which value, how many it has, where in it, and their hashes."""
    schema = pa.schema(
        [("source", pa.string()), ("value", pa.binary()), ("pieces", pa.int32()), ("at", pa.int32()), ("size", pa.int32())]
        + [("h1", pa.int64()), ("h2", pa.int64())]
    )

    def run(batches):
        for batch in _slices(batches, "text"):
            data, starts = _bytes_of(batch.column("text"))
            cuts = [_cuts(int(n)) for n in np.diff(starts)]
            counts = np.array([len(c) for c in cuts], np.int64)
            row = np.repeat(np.arange(batch.num_rows), counts)
            at = np.concatenate([np.array(c, np.int64) for c in cuts]) if cuts else np.zeros(0, np.int64)
            size = np.minimum(np.diff(starts)[row], PIECE)
            hashes = [np.zeros(len(row), np.uint64) for _ in range(2)]
            places = np.minimum((starts[row] + at)[:, None] + np.arange(PIECE), max(len(data) - 1, 0))
            for n in np.unique(size).tolist():
                here = size == n
                words = data[places[here]].view("<u8")
                for seed, out in enumerate(hashes):
                    out[here] = _hashed(lambda i: words[:, i // 8], len(words), n, seed)  # noqa: B023
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("name").take(taken), batch.column("value").take(taken), pa.array(counts[row], pa.int32()),
                 pa.array(at, pa.int32()), pa.array(size, pa.int32()), _signed(hashes[0]), _signed(hashes[1])],
                schema=schema,
            )

    named = values.select("name", "text", F.unhex(F.md5("text")).alias("value"))
    return named.mapInArrow(run, _PIECES)


def _bitmap(pieces: DataFrame) -> tuple[int, bytes]:
    """Its exponent, and bits that are set for the top and the low bits of each piece's hashes; at most 64 MB whatever there is."""
    count = pieces.count()
    exponent = min(max(BITMAP_BITS[0], (count * BITS_PER_PIECE).bit_length()), BITMAP_BITS[1])
    places = [place for h in ("h1", "h2") for place in (F.shiftrightunsigned(h, 64 - exponent), F.col(h).bitwiseAND((1 << exponent) - 1))]
    slots = pieces.select(F.explode(F.array(*places)).alias("slot"))
    blocks = slots.groupBy(F.expr(f"slot div {_BLOCK}").alias("block")).agg(
        F.bitmap_construct_agg(F.col("slot") % _BLOCK).alias("bits")
    )
    out = bytearray((1 << exponent) // 8)
    for row in blocks.toLocalIterator():
        start = row["block"] * _BLOCK // 8
        out[start : start + _BLOCK // 8] = row["bits"]
    return exponent, bytes(out)


def _set(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Which of the slots are set."""
    return bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 != 0


def _hits(texts: DataFrame, pieces: DataFrame) -> DataFrame:
    """Where windows of the texts have the hash of a piece, as far as the bitmap can tell; of short ones a place in a row is enough."""
    spark = texts.sparkSession
    sizes = sorted(r["size"] for r in pieces.select("size").distinct().collect())  # at most PIECE numbers
    exponent, packed = _bitmap(pieces)
    shared = spark.sparkContext.broadcast(packed)
    schema = pa.schema(
        [("target", pa.string()), ("part", pa.int32()), ("row", pa.int64()), ("at", pa.int64()), ("size", pa.int32())]
        + [("h1", pa.int64()), ("h2", pa.int64())]
    )

    def run(batches):
        bits, part, before = np.frombuffer(shared.value, np.uint8), TaskContext.get().partitionId(), 0
        top, low_bits = np.uint64(64 - exponent), np.uint64((1 << exponent) - 1)
        for batch in _slices(batches, "text"):
            data, starts = _bytes_of(batch.column("text"))
            for low in range(0, len(data), SCAN_BYTES):
                words = _words(data[low : low + SCAN_BYTES + PIECE])
                for size in sizes:
                    count = min(SCAN_BYTES, len(data) - low - size + 1)
                    if count <= 0:
                        continue
                    h = _hashed(lambda i: words[i : count + i], count, size, 0)  # noqa: B023
                    here = np.flatnonzero(_set(bits, h >> top))
                    here = here[_set(bits, h[here] & low_bits)]
                    second = _hashed(lambda i: words[here + i], len(here), size, 1)  # noqa: B023
                    known = _set(bits, second >> top) & _set(bits, second & low_bits)
                    here, second = here[known], second[known]
                    row = np.searchsorted(starts, here + low, "right") - 1
                    inside = here + low + size <= starts[row + 1]
                    here, row, second = here[inside], row[inside], second[inside]
                    if size < PIECE:
                        _, one = np.unique(np.stack([row.astype(np.uint64), h[here]]), axis=1, return_index=True)
                        here, row, second = here[one], row[one], second[one]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("name").take(pa.array(row)), pa.array(np.full(len(row), part, np.int32)), pa.array(row + before),
                         pa.array(here + low - starts[row]), pa.array(np.full(len(row), size, np.int32)), _signed(h[here]), _signed(second)],
                        schema=schema,
                    )
            before += batch.num_rows

    return texts.mapInArrow(run, _HITS)


def residues(
    raw: Mapping[str, DataFrame], protected: Mapping[str, Sequence[str]], scrubbed: Mapping[str, DataFrame],
    shortest: int = 1,
) -> DataFrame:
    """``source``, ``value`` (its MD5), ``target``, ``part``, ``row``: which raw value stands in which text, once for each.

    ``protected`` names columns of the ``raw`` tables; their values, NULL and empty ones and those of under ``shortest`` bytes left
    out, are looked for in all text columns of all ``scrubbed`` tables. ``part`` and ``row`` number texts, for counting them.
    """
    values = _texts(raw, protected).where(F.octet_length("text") >= shortest).distinct()
    pieces = kept(value_pieces(values), "leak-pieces")
    hits = kept(_hits(_texts(scrubbed, {t: text_columns(df) for t, df in scrubbed.items()}), pieces), "leak-hits")
    key, place = ["h1", "h2", "size"], ["target", "part", "row"]
    whole = hits.join(pieces.where("pieces = 1").select(*key, "source", "value"), key).select("source", "value", *place)

    long = pieces.where("pieces > 1")
    counted = long.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    leading = long.join(counted, key).groupBy("source", "value").agg(F.min(F.struct("n", "at", *key)).alias("lead"))
    leading = leading.select("source", "value", F.col("lead.at").alias("offset"), *[F.col(f"lead.{k}").alias(k) for k in key])
    begun = hits.where(f"size = {PIECE}").join(leading, key).withColumn("start", F.col("at") - F.col("offset")).where("start >= 0")
    asked = begun.select("source", "value", *place, "start").join(long.withColumnRenamed("at", "offset"), ["source", "value"])
    asked = asked.withColumn("at", F.col("start") + F.col("offset"))
    stands = asked.join(hits, [*place, "at", *key], "left_semi").groupBy("source", "value", *place, "start", "pieces").count()
    cut = stands.where("count = pieces").select("source", "value", *place)
    return whole.unionByName(cut).distinct()


def audit_leak_anywhere(
    raw: Mapping[str, DataFrame], protected: Mapping[str, Sequence[str]], scrubbed: Mapping[str, DataFrame],
    shortest: int = 1,
) -> DataFrame:
    """For each protected column and each text column of the output: how many raw values stand in it, and in how many of its texts.

    ``audit_leak`` compares whole values of one column; this one finds a value that a rule moved to another column or table,
    or left inside a longer text. Pairs without a leak are reported with 0.
    """
    found = kept(residues(raw, protected, scrubbed, shortest), "leaks")
    values = found.select("source", "target", "value").distinct().groupBy("source", "target").agg(F.count(F.lit(1)).alias("leaked_values"))
    rows = found.select("source", "target", "part", "row").distinct().groupBy("source", "target").agg(F.count(F.lit(1)).alias("leaked_rows"))
    pairs = [
        (f"{t}.{c}", f"{u}.{d}")
        for t, names in protected.items() for c in names for u, df in scrubbed.items() for d in text_columns(df)
    ]
    spark = next(iter(scrubbed.values())).sparkSession
    every = spark.range(0, 1, 1, 1).select(F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("target")) for s, t in pairs])))
    joined = every.join(values, ["source", "target"], "left").join(rows, ["source", "target"], "left")
    return joined.fillna(0, ["leaked_values", "leaked_rows"])
