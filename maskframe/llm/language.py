"""Language of a text: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, and whatever is not a letter is one space between words. Its features are all
runs of 1 to ``LONGEST`` characters of what is left, hashed to ``BUCKETS`` numbers. Training adds up, over every labelled
document, how often a language has each number: a table of languages x ``BUCKETS`` at most, which is also what is
broadcast. Scoring looks the numbers of a batch of texts up in the matrix of log probabilities and adds them by text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BUCKETS, LONGEST, SMOOTHING, MOST_LANGUAGES = 1 << 15, 4, 0.5, 500
STRETCH, MOST_HELD = 1 << 20, 1 << 21
UNKNOWN = "und"

_SPACE = np.uint32(32)


@cache
def _letters() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a mark that belongs to one, else 0."""
    kinds = (unicodedata.category(chr(c))[0] for c in range(0x110000))
    return np.array([2 if k == "L" else 1 if k == "M" else 0 for k in kinds], np.uint8)


def normal(text: str) -> np.ndarray:
    """Code points of the words, a space around each; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _letters()[codes]
    if not len(kinds) or kinds.max() < 2:
        return codes[:0]
    keep = kinds > 0
    codes = np.concatenate([[_SPACE], np.where(keep, codes, _SPACE), [_SPACE]]).astype(np.uint32)
    first = np.append(True, (codes[1:] != _SPACE) | (codes[:-1] != _SPACE))
    return codes[first]


def buckets(codes: np.ndarray) -> np.ndarray:
    """The hashed numbers of all n-grams, with repeats."""
    out = []
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint32(0x01000193)
        h = h ^ (h >> np.uint32(15))
        out.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32) & (BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def stretches(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a very long text, overlapping so that every n-gram of the longest kind is in one of them."""
    for at in range(0, max(1, len(codes)), STRETCH):
        yield codes[at : at + STRETCH + LONGEST - 1]


def text_buckets(text: str | None) -> Iterator[np.ndarray]:
    codes = normal(text or "")
    if len(codes):
        yield from map(buckets, stretches(codes))


def _plain(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def held_out(doc_id) -> F.Column:
    """Documents that are never learned from: a third, by the checksum of the id as text. Of a null id: no."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """Languages in alphabetical order, log priors, and log probabilities, buckets x languages."""

    def __init__(self, languages: list[str], documents: np.ndarray, counts: np.ndarray) -> None:
        self.languages = languages
        self.prior = np.log(documents / max(1, documents.sum())) if len(languages) else documents
        smooth = counts + SMOOTHING
        self.logs = np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T)

    def _totals(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log joint probabilities of sparse rows (buckets, counts), none of them empty: rows x languages."""
        at, n = (np.concatenate(part) for part in zip(*rows, strict=True))
        starts = np.cumsum([0, *(len(b) for b, _ in rows[:-1])])
        return self.prior + np.add.reduceat(self.logs[at] * n[:, None], starts, axis=0)

    def predict(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """The best language of each text and its posterior probability; of equals, the first by name."""
        out: list[tuple[str, float]] = []
        places, rows, held = [], [], 0

        def score() -> None:
            nonlocal held
            if rows:
                totals = self._totals(rows)
                best = totals.argmax(1)
                gap = np.minimum(totals - totals[np.arange(len(rows)), best][:, None], 0)
                for place, lang, p in zip(places, best, 1 / np.exp(gap).sum(1), strict=True):
                    out[place] = (self.languages[lang], float(p))
            places.clear()
            rows.clear()
            held = 0

        for text in texts:
            out.append((UNKNOWN, 0.0))
            seen = None
            for ids in text_buckets(text):
                n = np.bincount(ids, minlength=BUCKETS)
                seen = n if seen is None else seen + n
            if seen is not None and self.languages:
                at = np.flatnonzero(seen)
                places.append(len(out) - 1)
                rows.append((at, seen[at].astype(np.float64)))
                held += len(at) * len(self.languages)
                if held >= MOST_HELD:
                    score()
        score()
        return out


def train(docs: DataFrame) -> Model:
    """Learned from the text and non-null ``lang`` of every document that is not held out.

    The driver gets languages x ``BUCKETS`` sums. More than ``MOST_LANGUAGES`` distinct values are an error, as then
    the column does not hold languages.
    """
    rows = _plain(docs, F.col("lang").cast("string").alias("lang")).where("lang is not null").where(~held_out(F.col("doc_id")))
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                own = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                own[BUCKETS] += 1
                for ids in text_buckets(text):
                    own[:BUCKETS] += np.bincount(ids, minlength=BUCKETS)
            if len(sums) > MOST_LANGUAGES:
                raise ValueError(f"over {MOST_LANGUAGES} distinct values in lang")
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], schema=schema
            )

    sums = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()
    languages = sorted(found["lang"].unique())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} distinct values in lang")
    counts = np.zeros((len(languages), BUCKETS + 1))
    row = found["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy(np.int64)
    counts[row, found["bucket"].to_numpy(np.int64)] = found["n"]
    return Model(languages, counts[:, BUCKETS], counts[:, :BUCKETS])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """For each row: ``doc_id``, ``lang_pred``, ``score`` (posterior of the prediction, 0 to 1).

    - A text that is null or has no letter is ``und`` with score 0; so is every text if nothing could be learned.
    - Texts are used whole. Repeated rows get equal answers. ``lang``, ``source`` and ``doc_id`` play no part.
    - A null ``doc_id`` is kept. Other columns are not looked at. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in slices(batches):
            found = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                schema=schema,
            )

    return _plain(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, languages: list[str] | None = None) -> DataFrame:
    """The documents, all columns, whose language is known with a posterior of ``least`` and, if given, is one of ``languages``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        found = shared.value.predict(text)
        return pd.Series([x != UNKNOWN and s >= least and (languages is None or x in languages) for x, s in found], dtype=bool)

    return docs.where(good(F.col("text").cast("string")))
