"""MinHash fingerprints of documents and of edited ones.

Every five-word shingle is a 64-bit hash x. Permutation k is a_k x + b_k modulo 2^64 with odd a_k,
and place k of a fingerprint is the top 16 bits of the least value over a text's shingles. Two texts
agree at a place with probability equal to their shingles' Jaccard similarity (two different values agree by chance once in 65,536).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, slices, written
from .near_dedup import near_components, sketched_by
from .shingles import shingle_hashes

WIDTH, PLACES, CHUNK = 5, 128, 1 << 15
BANDS, BAND_PLACES = 24, 5  # for links from 0.8 on: one in 1.4e4 at 0.8 is missed, at 0.9 one in 1e9

_WORDS = mix64(np.arange(1, 2 * PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = _WORDS[:PLACES] | np.uint64(1), _WORDS[PLACES:]


def minima(shingles: Iterable[np.ndarray]) -> np.ndarray:
    """For each array of hashes its least value under each permutation: arrays x ``PLACES``; of an empty one all ones."""
    out: list[np.ndarray] = []
    parts, owners, held = [], [], 0

    def flush() -> None:
        nonlocal held
        if parts:
            x = np.concatenate(parts)
            starts = np.cumsum([0, *map(len, parts[:-1])])
            least, work = np.empty((PLACES, len(parts)), np.uint64), np.empty_like(x)
            for k in range(PLACES):
                np.multiply(x, _A[k], out=work)
                np.add(work, _B[k], out=work)
                np.minimum.reduceat(work, starts, out=least[k])
            for i, owner in enumerate(owners):
                np.minimum(out[owner], least[:, i], out=out[owner])
        parts.clear()
        owners.clear()
        held = 0

    for hashes in shingles:
        out.append(np.full(PLACES, np.uint64(0xFFFFFFFFFFFFFFFF)))
        for at in range(0, len(hashes), CHUNK):
            parts.append(hashes[at : at + CHUNK])
            owners.append(len(out) - 1)
            held += len(parts[-1])
            if held >= CHUNK:
                flush()
    flush()
    return np.array(out, np.uint64).reshape(-1, PLACES)


def fingerprints(texts: list[str | None], width: int = WIDTH) -> np.ndarray:
    """Texts x ``PLACES`` of 16 bits."""
    return (minima(shingle_hashes(t, width) for t in texts) >> np.uint64(48)).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of places that agree, row by row."""
    return (a == b).mean(1)


def edited(text: str, following: str) -> str:
    """The last third of the text's characters replaced by as many first ones of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third] if third else text


def _rows(ids: list, texts: list[str], following: list[str], prints: np.ndarray, next_prints: np.ndarray) -> dict:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    own = fingerprints(changed)
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": [p.tobytes() for p in prints], "edited_fingerprint": [p.tobytes() for p in own],
        "near_edited": likeness(prints, own), "near_next": likeness(prints, next_prints),
    }


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_EDGES = "part int, edge string, text string"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string()),
])


def _in_order(docs: DataFrame) -> DataFrame:
    """The results of all rows whose next row is in their partition; the first and the last of each with their texts."""

    def run(batches):
        part = TaskContext.get().partitionId()
        ids, texts, prints = [], [], np.zeros((0, PLACES), "<u2")  # the row that waits for the next one

        def edge(name: str, doc_id, text: str, own: np.ndarray) -> pa.RecordBatch:
            row = {"doc_id": doc_id, "fingerprint": own.tobytes(), "part": part, "edge": name, "text": text}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in slices(batches, most=4 << 20):
            fresh = batch.column("text").to_pylist()
            numbers, found = batch.column("doc_id").to_pylist(), fingerprints(fresh)
            if not texts:
                yield edge("first", numbers[0], fresh[0], found[0])
            ids, texts, prints = ids + numbers, texts + fresh, np.concatenate([prints, found])
            if len(texts) > 1:
                rows = _rows(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
                more = {"part": [None] * (len(texts) - 1), "edge": [None] * (len(texts) - 1), "text": [None] * (len(texts) - 1)}
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((rows | more).values(), _ARROW, strict=True)], schema=_ARROW)
            ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]
        if texts:
            yield edge("last", ids[0], texts[0], prints[0])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    placed = plain.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.mapInArrow(run, f"{_RESULT}, {_EDGES}")


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and their likeness; a row for each row of ``docs``.

    The edited text ends in the start of the next document's, in descending ``doc_id`` order; after the last
    document comes the first. ``fingerprint`` and ``edited_fingerprint`` are hexadecimal.

    - A null text is an empty one. Texts without words have one fingerprint, all ones.
    - Null ids come last. Rows that repeat an id follow each other in the order of a hash of their texts.
    - A single row is its own next one. An empty table gives an empty one. Other columns are not looked at.
    - Rows are sorted by range in as many tasks as there are; only the first and last texts of
      partitions meet in a join, a row of each for each partition.
    """
    made = written(_in_order(docs), "fingerprints")
    whole = made.where("edge is null").select(*[f.name for f in _ARROW][:7])
    edges = made.where("edge is not null").select("doc_id", "fingerprint", "part", "edge", "text")
    last = edges.where("edge = 'last'")
    parts = last.select("part")
    after = Window.orderBy("part")  # a row for each partition
    top = parts.agg(F.min("part")).first()[0]
    turned = parts.select("part", F.coalesce(F.lead("part").over(after), F.lit(top)).cast("int").alias("next"))
    first = edges.where("edge = 'first'").select(
        F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print")
    )

    def close(frames):
        for frame in frames:
            prints, following = (
                np.array([np.frombuffer(p, "<u2") for p in frame[c]]).reshape(-1, PLACES) for c in ("fingerprint", "next_print")
            )
            ids = frame["doc_id"].astype("Int64")
            yield pd.DataFrame(_rows(ids, frame["text"].tolist(), frame["next_text"].tolist(), prints, following))

    closed = last.join(turned, "part").join(first, "next").select("doc_id", "text", "next_text", "fingerprint", "next_print")
    out = whole.union(closed.mapInPandas(close, _RESULT))
    for c in ("fingerprint", "edited_fingerprint"):
        out = out.withColumn(c, F.lower(F.hex(c)))
    return out


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    def sketches(sets: list[np.ndarray]) -> list[np.ndarray | None]:
        least = minima(sets) >> np.uint64(32)
        return [m if len(s) else None for s, m in zip(sets, least, strict=True)]

    return sketched_by(docs, width, sketches, BANDS, BAND_PLACES)


def alike(docs: DataFrame, width: int = WIDTH, percent: int = 80) -> DataFrame:
    """Documents whose fingerprints share a band, joined in Spark and verified by the Jaccard similarity of their whole sets.

    One row for each row of ``docs``, with what :func:`near_components` returns and its rules for unusual rows; the bands
    are of MinHash places instead of a similarity sketch's.
    """
    return near_components(docs, width, percent, sketched=_signatures, places=PLACES)
