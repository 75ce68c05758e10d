"""Token sequences of a fixed window, filled by minimum bin slack.

A document's ids are cut into whole windows and one remainder below a window. All that packing needs to know of
remainders is how many there are of each length, at most ``window - 1`` numbers, so the plan is made once
from these counts and is as small for any number of documents. The longest remaining length is placed, and a
bitset holds which sums the other lengths, each as often as it is left, can reach: bit s is set if some multiset
sums to s. The best reachable fill is traced back to the multiset behind it, and the same
multiset is used as often as the counts allow, until some length has fewer pieces left than the fill takes of
it. That happens to a length n at most ``window / n`` times, so there are at most about ``window * ln(window)`` fills, whatever
the number of documents. Documents then take the places of their length in the plan by their rank in it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .tokens import encoder

WINDOW, END_ID = 4096, 2
ROWS_PER_BLOCK = 50_000


def full(size: int, window: int) -> int:
    """The padding of a sequence of this size: a whole window or a power of two needs none."""
    return 0 if size & (size - 1) == 0 else window - size


def best_fill(counts: dict[int, int], first: int, window: int) -> list[int]:
    """The multiset of lengths, ``first`` among them, with the least padding, and of these the largest."""
    room = window - first
    reach, layers = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left = min(counts[length] - (length == first), room // length)
        part = 1
        while left > 0 and not reach >> room & 1:
            take = min(part, left)
            layers.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    sums, rest = [], reach
    while rest:
        low = rest & -rest
        sums.append(low.bit_length() - 1)
        rest ^= low
    best = min(sums, key=lambda s: (full(first + s, window), -s))
    chosen = [first]
    for length, take, before in reversed(layers):
        if not before >> best & 1:
            best -= take * length
            chosen += [length] * take
    return chosen


@dataclass
class Plan:
    """For every fill: its lengths and how many sequences use it; ``places`` by length for ranks to look up."""

    fills: list[tuple[list[int], int]]
    lengths: np.ndarray
    first_rank: np.ndarray
    per_sequence: np.ndarray
    first_sequence: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, counts: dict[int, int], window: int) -> Plan:
        counts = {n: c for n, c in counts.items() if c}
        fills, rows, sequence = [], [], 0
        used = dict.fromkeys(counts, 0)
        while counts:
            chosen = sorted(best_fill(counts, max(counts), window), reverse=True)
            each = {n: chosen.count(n) for n in set(chosen)}
            times = min(counts[n] // k for n, k in each.items())
            offset = 0
            for n in sorted(each, reverse=True):
                rows.append((n, used[n], each[n], sequence, offset))
                used[n] += times * each[n]
                offset += n * each[n]
                counts[n] -= times * each[n]
                if not counts[n]:
                    del counts[n]
            fills.append((chosen, times))
            sequence += times
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        return cls(fills, *[table[:, i].copy() for i in range(5)])

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.fills)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and the offset of the piece with each rank, from 0, among those of its length."""
        big = np.int64(1) << np.int64(48)
        at = np.searchsorted(self.lengths * big + self.first_rank, length * big + rank, "right") - 1
        inside = rank - self.first_rank[at]
        return (
            self.first_sequence[at] + inside // self.per_sequence[at],
            self.offset[at] + inside % self.per_sequence[at] * length,
        )


_PIECE = "struct<start:long,length:long,ids_crc32:long{}>"


def cut(docs: DataFrame, tokenizer: str, window: int, end_id: int, keep_ids: bool) -> DataFrame:
    """``doc_id``, ``doc_tokens`` and ``pieces``: whole windows, then the remainder, if there is one."""
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    piece = pa.struct(fields)
    schema = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("pieces", pa.list_(piece))])

    def pieces_of(ids: bytes) -> list[dict]:
        out = []
        for at in range(0, len(ids), 4 * window):
            part = ids[at : at + 4 * window]
            out.append({"start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)})
            if keep_ids:
                out[-1]["ids"] = np.frombuffer(part, "<i4")
        return out

    def run(batches):
        encode = encoder(tokenizer)
        end = end_id.to_bytes(4, "little")
        for batch in slices(batches, most=4 << 20):
            ids = [encode.ids(text) + end for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(pieces_of, ids), pa.list_(piece))],
                schema=schema,
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = _PIECE.format(",ids:array<int>" if keep_ids else "")
    return plain.mapInArrow(run, f"doc_id long, doc_tokens long, pieces array<{kind}>")


def ranked(pieces: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The pieces with ``rank``, gapless from 0 within each length.

    Pieces are numbered within blocks of a bounded number of rows, and a block's numbers start after those of the
    blocks before it, so a length that a third of all documents have is ranked by many tasks.
    """
    n = pieces.count()
    blocks = max(1, -(-n // rows_per_block))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)))
    sizes = dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    numbered = dealt.withColumn("rank", F.row_number().over(within) - 1)
    return numbered.join(starts, ["length", "block"]).withColumn("rank", (F.col("rank") + F.col("base")).cast("long")).drop("block", "base")


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most ``window`` ids.

    A row for each piece: ``doc_id``, ``start`` (ids of its document before it), ``length``, ``ids_crc32`` (of its ids as
    little-endian unsigned 32-bit integers), ``doc_tokens``, ``sequence_id``, ``offset``; with ``keep_ids`` also ``ids``.
    Sequence ids are gapless from 0, and so are the offsets in a sequence.

    - A null or empty text is the end id alone. Rows that repeat a document are packed each by itself.
    - A null ``doc_id`` is kept as null. Other columns are not looked at. An empty table gives an empty one.
    - Long documents are cut every ``window`` ids; nothing is dropped.
    """
    made = written(cut(docs, tokenizer, window, end_id, keep_ids), "cut")
    names = ["start", "length", "ids_crc32"] + ["ids"] * keep_ids
    pieces = made.select("doc_id", "doc_tokens", F.explode("pieces").alias("p")).select(
        "doc_id", "doc_tokens", *[F.col(f"p.{c}") for c in names]
    )
    lengths = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most window rows
    plan = Plan.of(dict(zip(lengths["length"].tolist(), lengths["n"].tolist(), strict=True)), window)

    def place(batches):
        for frame in batches:
            sequence, offset = plan.place(frame["length"].to_numpy(np.int64), frame["rank"].to_numpy(np.int64))
            yield frame.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    shape = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    placed = ranked(pieces).select("doc_id", "doc_tokens", *names, "rank")
    placed = placed.mapInPandas(place, f"{shape}, sequence_id long, offset long")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id`` and its ``ids`` in order, of pieces made with ``keep_ids``; a sequence holds a window at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: ``n_sequences``, ``tokens`` and ``padded``, the ids that fill up the sequences."""
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("size"))
    whole = F.col("size").bitwiseAND(F.col("size") - 1) == 0
    return sizes.agg(
        F.count(F.lit(1)).alias("n_sequences"), F.sum("size").alias("tokens"),
        F.sum(F.when(whole, 0).otherwise(window - F.col("size"))).alias("padded"),
    )
