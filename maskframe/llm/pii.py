"""Personal data: patterns find it, and what the corpus says about the words beside it finds the rest.

Base spans are email, ip, card and phone. Strings that hold letters and digits and ``SECRET_BITS`` of information or more are spans too,
of kind secret. Each value is a protected entity e. Its information is IC(e) = log2(N / df(e)), over all N documents. A word t
within ``WINDOW`` words of e tells PMI(e, t) = IC(e) + log2 P(e | t) bits of it. P(e | t) is estimated from df(e, t) of df(t)
documents, those with t in a window of e of those with t anywhere, by the lower end of its one-sided 95 % confidence interval (Wilson,
1927): a word that was seen once does not tell all of e only because there is no second document to say otherwise. The share PMI / IC is
near 1 where t occurs only with e, in several documents, and near or below 0 for words that occur everywhere.

Words whose share reaches ``REMOVE_AT`` are removed and those that reach ``GENERALISE_AT`` are replaced by their class (after the
disclosure criterion of Sanchez and Batet, "C-sanitized", 2016): in every document of the corpus, with or without e, as they tell e
wherever they stand. Where only one document has both, that is all the evidence there is: such words are generalised at most, and only in
documents that hold e.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("removed", "generalised", "secret")
WINDOW, REMOVE_AT, GENERALISE_AT = 8, 0.9, 0.7
SECRET_BITS, SECRET_BITS_A_CHARACTER = 64.0, 2.8
CERTAINTY = 1.645  # standard deviations: one-sided 95 %
FILTER_BITS = 22

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\w+")
_DIGITS = re.compile(r"[0-9]")
_STRING = re.compile(r"[A-Za-z0-9_+/-]{16,}")


def _emails(text: str) -> list[tuple[int, int]]:
    """Found from each @ outwards: the local part cannot hold one, so this is linear in long runs too."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, by kind as in ``KINDS``, then by start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def _bits(value: str) -> float:
    """The information of a string: its length times the entropy of its characters."""
    n = len(value)
    return sum(k * math.log2(n / k) for k in Counter(value).values())


def secret_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Keys, tokens and the like, outside the base spans: letters and digits with more information than words or numbers have."""
    free, out = _outside(base), []
    for m in _STRING.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and free(*m.span()):
            if (bits := _bits(value)) >= SECRET_BITS and bits >= SECRET_BITS_A_CHARACTER * len(value):
                out.append(("secret", *m.span()))
    return out


def all_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans, then secrets: the values that stand for entities."""
    base = base_spans(text)
    return base + secret_spans(text, base)


def entity(kind: str, value: str) -> bytes:
    """What stands for a value in tables: a digest, so values are not copied about."""
    plain = value.lower() if kind in ("email", "ip", "secret") else "".join(_DIGITS.findall(value))
    return hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=16).digest()


def _outside(spans: list[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """Whether a stretch of text meets none of the spans."""
    taken = sorted((a, b) for _, a, b in spans)
    starts = np.array([a for a, _ in taken], np.int64)
    ends = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else starts

    def free(start: int, end: int) -> bool:
        i = int(np.searchsorted(starts, end, "left"))  # spans that start before the word ends
        return i == 0 or ends[i - 1] <= start

    return free


def neighbours(text: str, spans: list[tuple[str, int, int]], window: int) -> list[tuple[bytes, str, int, int]]:
    """``(entity, term, start, end)`` for the words within ``window`` words of each span, outside all spans."""
    words = list(_WORD.finditer(text))
    starts = np.array([m.start() for m in words], np.int64)
    ends = np.array([m.end() for m in words], np.int64)
    free, out = _outside(spans), []
    for kind, a, b in spans:
        before, after = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        who = entity(kind, text[a:b])
        for m in words[max(0, before - window) : before] + words[after : after + window]:
            if free(m.start(), m.end()):
                out.append((who, m[0].lower(), m.start(), m.end()))
    return out


_SPAN = "struct<kind:string,start:long,end:long>"
_NEAR = "struct<entity:binary,term:string>"
_PLACE = "struct<start:long,end:long>"


def _plain(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _key(doc_id, text) -> list:
    """Rows with equal keys have equal texts, so equal spans."""
    return [F.coalesce(doc_id, F.lit(-1)).alias("k1"), F.xxhash64(text).alias("k2")]


def found(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``k1``, ``k2``, ``base`` spans, ``secrets``, the entities that are their ``owners`` and the words ``near`` each, a
    row for each row of ``docs``."""
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    near_type = pa.list_(pa.struct([("entity", pa.binary()), ("term", pa.string())]))
    keys = [("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())]
    lists = [("base", span_type), ("secrets", span_type), ("owners", pa.list_(pa.binary())), ("near", near_type)]
    schema = pa.schema([*keys, *lists])

    def run(batches):
        for batch in slices(batches):
            columns = base, secrets, owners, near = [], [], [], []
            for text in batch.column("text").to_pylist():
                spans = all_spans(text)
                for kept, secret in ((base, False), (secrets, True)):
                    kept.append([{"kind": k, "start": a, "end": b} for k, a, b in spans if (k == "secret") == secret])
                words = neighbours(text, spans, window) if spans else []
                owners.append(sorted({entity(k, text[a:b]) for k, a, b in spans}))
                near.append([{"entity": e, "term": t} for e, t in sorted({(e, t) for e, t, _, _ in words})])
            found = [pa.array(c, kind) for c, (_, kind) in zip(columns, lists, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n, _ in keys), *found], schema=schema)

    plain = _plain(docs)
    keyed = plain.select("doc_id", "text", *_key(plain["doc_id"], plain["text"]))
    types = f"base array<{_SPAN}>, secrets array<{_SPAN}>, owners array<binary>, near array<{_NEAR}>"
    return keyed.mapInArrow(run, f"doc_id long, k1 long, k2 long, {types}")


def _slot(term: str) -> int:
    """The top bits of the hash that ``xxhash64`` gives a string in Spark."""
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), seed=42) >> (64 - FILTER_BITS)


def _bitmap(terms: DataFrame) -> Broadcast:
    """A fixed 2^22 slots that tell a pass over texts which words can be among the terms; a join has to drop the others."""
    slots = terms.select(F.shiftrightunsigned(F.xxhash64("term"), 64 - FILTER_BITS).cast("int").alias("slot")).distinct()
    wanted = np.zeros(1 << FILTER_BITS, np.bool_)
    wanted[slots.toPandas()["slot"].to_numpy(np.int64)] = True
    return terms.sparkSession.sparkContext.broadcast(np.packbits(wanted).tobytes())


def term_documents(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term`` and ``df``, the number of documents that contain it, for the given terms.

    Counts are added up in each batch before they are shuffled.
    """
    shared = _bitmap(terms)
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def run(batches):
        may = np.unpackbits(np.frombuffer(shared.value, np.uint8))
        for batch in slices(batches):
            counts = Counter()
            for text in batch.column("text").to_pylist():
                counts.update(set(_WORD.findall(text.lower())))
            kept = [(t, n) for t, n in counts.items() if may[_slot(t)]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], schema=schema
            )

    counted = _plain(docs).select("text").mapInArrow(run, "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("df")).join(terms, "term", "left_semi")


def _least_share(own: F.Column, both: F.Column, df: F.Column, total: float) -> F.Column:
    """The share of IC(e) that t tells, with P(e | t) at the lower end of its interval; null where e tells nothing itself."""
    z2, p = CERTAINTY**2, both / df
    low = (p + z2 / (2 * df) - CERTAINTY * F.sqrt(p * (1 - p) / df + z2 / (4 * df * df))) / (1 + z2 / df)
    information = F.log2(F.lit(total) / own)
    return F.when(information > 0, 1 + F.log2(low) / information)


def disclosing(
    docs: DataFrame, seen: DataFrame, remove_at: float = REMOVE_AT, generalise_at: float = GENERALISE_AT
) -> DataFrame:
    """``entity``, ``term``, ``kind``, ``both``, ``own`` and ``df`` of the pairs whose share of the entity's information reaches a threshold."""
    per_row = seen.select(F.explode("near").alias("p"))
    pairs = per_row.groupBy("p.entity", "p.term").agg(F.count(F.lit(1)).alias("both"))
    pairs = written(pairs, "pairs")
    holders = seen.select(F.explode("owners").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("own"))
    total = seen.agg(F.count(F.lit(1)).cast("double").alias("total")).first()["total"]
    words = term_documents(docs, pairs.select("term").distinct())
    scored = pairs.join(holders, "entity").join(words, "term", "left").withColumn("df", F.greatest("df", "both"))
    share = _least_share(F.col("own"), F.col("both"), F.col("df"), total)
    kind = F.when((share >= remove_at) & (F.col("both") > 1), "removed").when(share >= generalise_at, "generalised")
    return scored.select("entity", "term", kind.alias("kind"), "both", "own", "df").where("kind is not null")


def occurrences(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``term`` and its ``places``: where documents hold words that can be among the terms.

    The whole text counts, without its own spans; a text counts once. In documents without spans only terms count that more than
    one document speaks for.
    """
    here, wide = _bitmap(pairs.select("term").distinct()), _bitmap(pairs.where("both > 1").select("term").distinct())
    place_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("term", pa.string()), ("places", place_type)])

    def run(batches):
        filters = {spans: np.unpackbits(np.frombuffer(f.value, np.uint8)) for spans, f in ((True, here), (False, wide))}
        for batch in slices(batches):
            rows = []
            for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text")), strict=True):
                spans = all_spans(text)
                may = filters[bool(spans)]
                terms = {t for t in set(_WORD.findall(text.lower())) if may[_slot(t)]}
                if not terms:
                    continue
                free, places = _outside(spans), defaultdict(list)
                for m in _WORD.finditer(text):
                    if (t := m[0].lower()) in terms and free(*m.span()):
                        places[t].append({"start": m.start(), "end": m.end()})
                rows += [{"k1": k1, "k2": k2, "term": t, "places": at} for t, at in places.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    plain = _plain(docs)
    keyed = plain.select("text", *_key(plain["doc_id"], plain["text"]))
    return keyed.mapInArrow(run, f"k1 long, k2 long, term string, places array<{_PLACE}>").dropDuplicates(["k1", "k2", "term"])


def term_spans(docs: DataFrame, seen: DataFrame, pairs: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``terms``: the spans of disclosing words, a word once.

    Words that several documents speak for are marked wherever they stand, the others in all documents that hold their entities. Of
    the latter a pair meets the documents of its entity or those of its term, whichever are fewer, so a value that stands in
    very many documents beside a different word each time does not bring every word to every document.
    """
    words = written(occurrences(docs, pairs), "words")
    keys, columns = words.select("k1", "k2", "term"), ["k1", "k2", "term", "kind"]
    # removed comes after generalised in the alphabet, and wins
    everywhere = keys.join(pairs.where("both > 1").groupBy("term").agg(F.max("kind").alias("kind")), "term")
    holders = seen.select("k1", "k2", F.explode("owners").alias("entity")).distinct()
    once = pairs.where("both = 1")
    by_entity = once.where("own <= df").join(holders, "entity")
    by_term = once.where("own > df").join(keys, "term").join(holders, ["k1", "k2", "entity"], "left_semi")
    found = everywhere.select(*columns).unionByName(by_entity.select(*columns)).unionByName(by_term.select(*columns))
    kinds = found.groupBy("k1", "k2", "term").agg(F.max("kind").alias("kind"))
    hits = words.join(kinds, ["k1", "k2", "term"]).select("k1", "k2", "kind", F.explode("places").alias("at"))
    return hits.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("kind", "at.start", "at.end"))).alias("terms"))


def private_spans(docs: DataFrame, **thresholds) -> DataFrame:
    """For each row of ``docs``: ``doc_id``, ``k1``, ``k2``, ``base`` and ``terms``, lists of (kind, start, end).

    ``terms`` holds secrets and disclosing words. Offsets are in code points, ends exclusive.

    - A null text is an empty one and has no spans. A null ``doc_id`` does not matter.
    - Equal texts have equal spans; repeated rows count in the statistics as often as they occur.
    - Other columns are not looked at. An empty table gives an empty one.
    - Patterns are matched in time linear in a text, whatever it holds.
    """
    seen = written(found(docs), "found")
    pairs = written(disclosing(docs, seen, **thresholds), "disclosing")
    terms = written(term_spans(docs, seen, pairs), "terms")
    none = F.array().cast(f"array<{_SPAN}>")
    joined = seen.select("doc_id", "k1", "k2", "base", "secrets").join(terms, ["k1", "k2"], "left")
    return joined.select("doc_id", "k1", "k2", "base", F.concat("secrets", F.coalesce("terms", none)).alias("terms"))


def _class_of(word: str) -> str:
    if word[0].isdigit():
        return "[NUMBER]"
    return "[NAME]" if word[0].isupper() else "[WORD]"


def redacted(text: str, spans: list[dict]) -> str:
    """The text with its spans replaced; of spans that overlap, the earlier and then longer one names the place."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        a, b = s["start"], s["end"]
        if a >= done:
            out.append(text[done:a])
            if s["kind"] == "generalised":
                out.append(_class_of(text[a:b]))
            elif s["kind"] != "removed":
                out.append(f"[{s['kind'].upper()}]")
        done = max(done, b)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """The documents, all rows and columns, with private spans replaced in ``text``, and ``n_chars`` after it.

    Rows without spans are as they were, null texts included; repeated rows stay repeated and are treated alike. An empty table
    gives an empty one.
    """
    seen = written(private_spans(docs, **thresholds), "private")
    spans = seen.where(F.size("base") + F.size("terms") > 0)
    spans = spans.groupBy("k1", "k2").agg(F.first(F.concat("base", "terms")).alias("spans"))
    k1, k2 = _key(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    columns = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), k1, k2)
    joined = keyed.join(spans, ["k1", "k2"], "left")

    @F.pandas_udf("string")
    def replaced(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else redacted(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)

    changed = F.col("spans").isNotNull()
    text = F.coalesce(replaced(F.when(changed, F.col("row.text").cast("string")), F.col("spans")), F.col("row.text").cast("string"))
    joined = joined.withColumn("new", text)
    out = {c: F.col(f"row.`{c}`") for c in columns} | {"text": F.col("new")}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(changed, F.char_length("new").cast(kind)).otherwise(out["n_chars"])
    return joined.select(*[col.alias(c) for c, col in out.items()])
