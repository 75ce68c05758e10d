import itertools
import random

import pytest

from maskframe.llm import packing
from maskframe.llm.queries import QUERIES
from maskframe.llm.tokens import tokenizer_file

from . import brute
from .conftest import SF, texts

TOKENIZER = "word_bpe_49k.json"


@pytest.mark.parametrize("seed", range(30))
def test_best_fill_is_the_best_of_all(seed):
    rnd = random.Random(seed)
    window = rnd.choice([10, 13, 16])
    lengths = [rnd.randint(1, window - 1) for _ in range(rnd.randint(1, 8))]
    counts = {n: lengths.count(n) for n in lengths}
    first = max(lengths)
    chosen = packing.best_fill(counts, first, window)
    assert first in chosen and sum(chosen) <= window and all(chosen.count(n) <= counts[n] for n in chosen)
    rest = sorted(lengths)
    rest.remove(first)
    sums = {first + sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k)}
    fits = [s for s in sums if s <= window]
    assert sum(chosen) == min(fits, key=lambda s: (packing.full(s, window), -s))


def test_plan_uses_every_piece_once():
    rnd = random.Random(1)
    lengths = [min(63, int(rnd.lognormvariate(2.5, 1)) + 1) for _ in range(3000)]
    plan = packing.Plan.of({n: lengths.count(n) for n in lengths}, 64)
    assert sum(len(f) * times for f, times in plan.fills) == len(lengths)
    assert len(plan.fills) <= sum(64 // n for n in range(1, 64))
    assert sum(packing.full(sum(f), 64) * times for f, times in plan.fills) < 0.01 * sum(lengths)


def checked(rows, docs, path, window=4096):
    """Every id of every document in one piece, sequences gapless; returns their sizes."""
    ids = {i: brute.library_ids(path, t) + [2] for i, t in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids.keys()
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == brute.crc32(ids[i][at : at + r["length"]])
            at += r["length"]
        assert at == len(ids[i])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return [sum(r["length"] for r in parts) for parts in by_sequence.values()]


def test_query(spark):
    rows = QUERIES["op2_packing"](spark, SF).collect()
    sizes = checked(rows, texts(spark.read.parquet(f"{SF}/documents.parquet")), tokenizer_file(TOKENIZER))
    assert sum(packing.full(s, 4096) for s in sizes) < 0.03 * sum(sizes)


def test_ranks_of_a_hot_length_come_from_many_blocks(spark):
    rows = [(i, 7 if i % 3 else i % 50 + 1, 0, 0) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, length long, start long, ids_crc32 long")
    found = {}
    for r in packing.ranked(pieces, rows_per_block=100).collect():
        found.setdefault(r["length"], []).append(r["rank"])
    assert all(sorted(ranks) == list(range(len(ranks))) for ranks in found.values())


def test_sequences_hold_the_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 30")
    pieces = packing.pack(docs, tokenizer_file(TOKENIZER), window=512, keep_ids=True)
    held = {r["sequence_id"]: r["ids"] for r in packing.sequences(pieces).collect()}
    for r in pieces.collect():
        assert held[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    sizes = [len(x) for x in held.values()]
    row = packing.padding(pieces, 512).first()
    assert (row["n_sequences"], row["tokens"], row["padded"]) == (len(sizes), sum(sizes), sum(packing.full(s, 512) for s in sizes))


def test_unusual_rows(odd, with_clashes, empty):
    for df in (odd, with_clashes):
        rows = packing.pack(df, tokenizer_file(TOKENIZER)).collect()
        once = {}
        for r in rows:
            once.setdefault((r["doc_id"], r["start"]), []).append(r)
        assert len(once[5, 0]) == 2  # a repeated row is packed twice
        assert once[1, 0][0]["doc_tokens"] == 1 == once[2, 0][0]["doc_tokens"]
    assert packing.pack(empty, tokenizer_file(TOKENIZER)).count() == 0
