"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document's set is its distinct word shingles. Its sketch (Dahlgaard, Knudsen and Thorup,
"Fast Similarity Sketching", 2017) has ``COORDINATES`` places. Round i throws every element into one
place by a hash of its own and i; a place keeps the first round's least value, so a large set is done
after one round and a small one after enough of them; after ``COORDINATES`` random rounds place i
of round i takes every element, so no place stays empty. Two sketches agree at a place with
probability equal to the sets' similarity, and the agreements are concentrated as those of independent hashes.

Bands of ``ROWS`` places are keys. Two sets of similarity 0.8 share none of the 48 keys with a
probability of 5e-7; sets of 0.3 share one with 3 in a hundred. A pair that shares a key is verified unless its sketches
disagree in so many places that, by their concentration, it cannot reach the similarity: five standard deviations,
so pairs below 0.72 mostly go and one in 3e6 of those at 0.8.

Sets that are equal are one class from the start. Then there are three rounds of comparing whole sets, and components are
merged after each. First a random member of each bucket meets the others in it, so a set meets a pivot for each of its
keys, and what has many copies becomes one component. Then some, and at last all, of the sets that are still outside
the largest component of a bucket meet all members of their buckets that are in other components. After each round
pivots leave their buckets, and buckets that are down to one component are done. So a bucket of n copies costs about
n comparisons, not n squared, yet every pair in a bucket is compared or already connected.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, release, slices, written, written_to
from .components import components
from .shingles import shingle_set

BANDS, ROWS = 48, 6
COORDINATES = 1024  # the first BANDS * ROWS make the keys, all of them the comparison of sketches
DEVIATIONS = 5
SOME = 8  # of the pivots of the last round, one in so many go first
FILTER_BITS = 24

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(items: np.ndarray, places: int = COORDINATES) -> np.ndarray:
    """The fast similarity sketch of a non-empty array of distinct 64-bit hashes."""
    out = np.full(places, _UNSET)
    step = max(1, int(places * 6 / len(items)))
    for start in range(0, places, step):
        rounds = np.arange(start, min(places, start + step), dtype=np.uint64)[:, None]
        h = mix64(items[None, :] + (rounds + np.uint64(1)) * _GOLDEN)
        place = ((h >> np.uint64(32)) * np.uint64(places)) >> np.uint64(32)
        value = (rounds << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(out, place.ravel().astype(np.intp), value.ravel())
        if (out != _UNSET).all():
            return out
    for place in np.flatnonzero(out == _UNSET):
        h = mix64(items + np.array([places + int(place) + 1], np.uint64) * _GOLDEN)
        out[place] = (np.uint64(places + int(place)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)).min()
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band; bands at different positions never share a key but by chance."""
    parts = signature.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN
    for column in parts.T:
        key = mix64(key * np.uint64(3) + column)
    return key.view(np.int64)


def agreement_bits(signature: np.ndarray) -> np.ndarray:
    """The two lowest bits of every place, 32 places in a word."""
    low = (signature & np.uint64(3)).astype(np.uint8)
    bits = np.packbits(np.stack([low >> 1, low & 1], axis=1).ravel())
    return np.pad(bits, (0, -len(bits) % 8)).view("<i8")


def _disagreements(a: str, b: str, places: int) -> str:
    words = -(-places // 32)
    return " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(words))


def _most_disagreements(places: int, percent: int) -> int:
    """Sketches of two sets of this similarity disagree in more bits only beyond ``DEVIATIONS`` standard deviations.

    A place that differs has two random bits: of n bits, 0.5 are expected to differ and 0.375 is the mean square.
    """
    apart = 1 - percent / 100
    spread = 2 * (places * (0.375 * apart - (0.5 * apart) ** 2)) ** 0.5
    return int(places * apart + DEVIATIONS * spread)


def set_digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.astype("<u8").tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``digest`` of the set, ``bands`` and ``bits``; the last three null for an empty set."""
    return sketched_by(docs, width, lambda sets: [sketch(s) if len(s) else None for s in sets], BANDS, ROWS)


def sketched_by(docs: DataFrame, width: int, sketches, bands: int, rows: int) -> DataFrame:
    """The table of signatures by a function from sets to sketches, None for an empty set; ``bands`` of ``rows`` places are keys."""
    words = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", words), ("bits", words)])

    def run(batches):
        for batch in slices(batches, most=4 << 20):
            sets = [shingle_set(text, width) for text in batch.column("text").to_pylist()]
            found = sketches(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if f is None else band_keys(f[: bands * rows], bands) for f in found], words),
                    pa.array([None if f is None else agreement_bits(f) for f in found], words),
                ],
                schema=schema,
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>")


def _slot(doc_id: F.Column) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id), 64 - FILTER_BITS)


def _filter_of(ids: DataFrame) -> Broadcast:
    """2^24 bits that tell a pass over texts which documents can be among those with this ``node``."""
    slots = ids.select(_slot(F.col("node")).alias("slot"))
    blocks = slots.groupBy(F.expr("slot div 32768").alias("block")).agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits"))
    out = bytearray((1 << FILTER_BITS) // 8)
    for row in blocks.toLocalIterator():
        out[row["block"] * 4096 : (row["block"] + 1) * 4096] = row["bits"]
    return ids.sparkSession.sparkContext.broadcast(bytes(out))


def _full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``digest`` and ``items`` of the sets of the documents among ``nodes``, and of a few more.

    Texts stay where they are read: tasks look ids up in a filter. A set comes once from a task.
    """
    shared = _filter_of(nodes)
    schema = pa.schema([("digest", pa.binary()), ("items", pa.list_(pa.int64()))])

    def run(batches):
        bits, seen = np.frombuffer(shared.value, np.uint8), set()
        for batch in slices(batches):
            slot = batch.column("slot").to_numpy().astype(np.int64)
            wanted = bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
            found = {}
            for text in batch.column("text").filter(pa.array(wanted.astype(bool))).to_pylist():
                items = shingle_set(text, width)
                if len(items) and (digest := set_digest(items)) not in seen:
                    seen.add(digest)
                    found[digest] = items.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), schema.field("items").type)], schema=schema
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = plain.where("doc_id is not null").select("text", _slot(F.col("doc_id")).alias("slot"))
    return known.mapInArrow(run, "digest binary, items array<long>")


_MEMBER = ("sid", "node", "n", "comp")


def _active(members: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component."""
    live = members.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    return members.join(live.select("band"), "band")


def _outside(members: DataFrame) -> DataFrame:
    """The members that are not in their bucket's largest component: pairs across components have an end among them."""
    sizes = members.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("size", "comp")).alias("l")).select("band", F.col("l.comp").alias("main"))
    return members.join(largest, "band").where("comp <> main").drop("main")


def _band_pivots(members: DataFrame) -> DataFrame:
    """One member of each bucket, chosen anew for each, so a set meets different pivots in its buckets."""
    turn = F.xxhash64("sid", "band").alias("turn")
    chosen = _outside(members).groupBy("band").agg(F.min(F.struct(turn, *_MEMBER)).alias("p"))
    return chosen.select("band", *[F.col(f"p.{c}").alias(c) for c in _MEMBER])


def _node_pivots(members: DataFrame, one_in: int) -> DataFrame:
    """One in so many of the sets that are outside a largest component somewhere, in all their buckets."""
    sets = _outside(members).select("sid").distinct().where(F.pmod(F.xxhash64("sid"), F.lit(one_in)) == 0)
    return members.join(sets, "sid", "left_semi").select("band", *_MEMBER)


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, sketched=signatures, places: int = COORDINATES) -> DataFrame:
    """For each row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked where 100 * |A and B| >= ``percent`` * |A or B| of their sets of ``width``-word shingles
    (of all words as one, where there are fewer); a component is what links reach, named by its least
    ``doc_id``. The key widths are chosen for 80 percent; lower values lose links. ``sketched`` makes the table of
    signatures, of so many ``places``.

    - A null, empty or blank text has an empty set, ``n_shingles`` 0, and is its own component.
    - Equal texts are linked; rows that repeat one ``doc_id`` are judged by their own texts, each as a row.
    - A null ``doc_id`` takes part in nothing: ``component_id`` is null and ``kept`` true.
    - Other columns of ``docs`` are not looked at. An empty table gives an empty one.
    - Very long texts cost memory in proportion to one of them, in one task.
    """
    spark = docs.sparkSession
    sigs, old = written_to(sketched(docs, width), "signatures")
    valid = sigs.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # One row for each set. Its number stands for it in buckets, as one doc_id may have several.
    per_set = valid.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")
    )
    classes = written(per_set.withColumn("sid", F.monotonically_increasing_id()), "classes")
    sigs, _ = written_to(sigs.select("doc_id", "n_shingles", "digest"), "sizes")
    release(spark, old)

    # Buckets of one set are most of them, and go before anything but a key and a number is shuffled.
    keys = classes.select(F.explode("bands").alias("band"), "sid")
    shared = keys.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("band"))).where("sets > 1").drop("sets")
    members = shared.join(classes.select("sid", "node", "n"), "sid").withColumn("comp", F.col("node"))
    members, folder = written_to(members.select("band", *_MEMBER), "members")
    release(spark)
    sketches = classes.select("sid", "bits")
    sets, sets_folder = written_to(_full_sets(docs, members.select("node").distinct(), width), "sets")
    merged = merged_folder = None  # (node, component) of all nodes with links so far
    turn = 0
    apart = _disagreements("own.bits", "p.other.bits", places)
    x, y = (classes.select(F.col("sid").alias(n), F.struct("node", "digest").alias(s)) for n, s in (("x", "p"), ("y", "q")))
    while not members.isEmpty():
        pivots = _band_pivots(members) if not turn else _node_pivots(members, SOME if turn == 1 else 1)
        # A pair of sets meets in every bucket that both are in; after the first round the first of them speaks for all.
        buckets = members.groupBy("sid").agg(F.sort_array(F.collect_set("band")).alias("keys"))
        known = sketches.join(buckets, "sid")
        mine, theirs = (known.select("sid", F.struct("bits", "keys").alias(k)) for k in ("own", "other"))
        sketched_pivots = pivots.join(theirs, "sid").select("band", F.struct(*_MEMBER, "other").alias("p"))
        once = F.expr("array_min(array_intersect(own.keys, p.other.keys)) = band") if turn else F.lit(True)
        met = members.join(mine, "sid").join(sketched_pivots, "band").where(f"{apart} <= {_most_disagreements(places, percent)}").where(once)
        pairs = (
            met.where("comp <> p.comp")
            .where(f"100 * least(n, p.n) >= {percent} * greatest(n, p.n)")
            .select(F.greatest("sid", "p.sid").alias("x"), F.least("sid", "p.sid").alias("y"))
            .distinct()
        )
        alike = pairs.join(x, "x").join(y, "y")
        alike, alike_folder = written_to(
            alike.select(F.col("p.digest").alias("dx"), F.col("q.digest").alias("dy"), F.col("p.node").alias("a"), F.col("q.node").alias("b")), "alike"
        )
        # What the sketches took to meet is given back before whole sets are shuffled, so the disk holds one of the two.
        del buckets, known, mine, theirs, sketched_pivots, met, pairs
        release(spark)
        left = sets.select(F.col("digest").alias("dx"), F.col("items").alias("xs"))
        right = sets.select(F.col("digest").alias("dy"), F.col("items").alias("ys"))
        both = F.size(F.array_intersect("xs", "ys"))
        linked = (
            alike.join(left, "dx").join(right, "dy")
            .where(100 * both >= percent * (F.size("xs") + F.size("ys") - both))
            .select("a", "b")
        )
        links, links_folder = written_to(linked.distinct(), "links")
        moved = members
        if not links.isEmpty():
            # What earlier links reach is stars by now; only these meet the new links.
            every = links if merged is None else links.union(merged.select("node", "component"))
            was = merged_folder
            merged, merged_folder = written_to(components(every), "merged")
            moved = members.drop("comp").join(merged, "node", "left").select(
                "band", "sid", "node", "n", F.coalesce("component", "node").alias("comp")
            )
            release(spark, *[was] if was else [])
        done = pivots.select("band", "sid")
        rest = moved.join(done, ["band", "sid"], "left_anti")
        before = folder
        members, folder = written_to(_active(rest), "members")
        del alike, linked, links, moved, rest, pivots, done, left, right
        release(spark, before, alike_folder, links_folder)
        turn += 1
    release(spark, sets_folder)
    result = sigs.join(classes.select("digest", "node"), "digest", "left")
    component = F.coalesce("node", "doc_id")
    if merged is not None:
        result = result.join(merged, "node", "left")
        component = F.coalesce("component", "node", "doc_id")
    return result.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, without those that are near copies of one with a smaller ``doc_id``.

    Rows that repeat both ``doc_id`` and text come down to one. Of a ``doc_id`` with several texts all stay if
    one does. Rows without ``doc_id`` stay.
    """
    found = near_components(docs, width, percent)
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("any")).where("not any").select("doc_id")
    gone = written(gone, "gone")
    rest = docs.join(gone, "doc_id", "left_anti")
    return rest.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).union(rest.where("doc_id is null"))
