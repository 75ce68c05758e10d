import hashlib

import numpy as np

from maskframe.llm import fingerprints
from maskframe.llm.queries import QUERIES

from . import brute
from .conftest import SF, texts


def neighbours(rows):
    order = sorted(rows, key=lambda r: -r[0])
    return {a[0]: (a[1] or "", b[1] or "") for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_query(spark):
    found = {r["doc_id"]: r for r in QUERIES["op7_fingerprints"](spark, SF).collect()}
    rows = texts(spark.read.parquet(f"{SF}/documents.parquet"))
    prints = {i: fingerprints.fingerprints([t])[0] for i, t in rows}
    assert found.keys() == prints.keys()
    after = {a: b for a, b in zip(sorted(prints, reverse=True), sorted(prints, reverse=True)[1:] + [max(prints)], strict=True)}
    errors = []
    for i, (text, following) in neighbours(rows).items():
        r, third = found[i], len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == prints[i].tobytes().hex()
        own = fingerprints.fingerprints([changed])[0]
        assert r["edited_fingerprint"] == own.tobytes().hex()
        assert r["near_edited"] == (own == prints[i]).mean() and r["near_next"] == (prints[after[i]] == prints[i]).mean()
        a, b = brute.shingles(text, 5), brute.shingles(changed, 5)
        errors.append(r["near_edited"] - len(a & b) / max(1, len(a | b)))
    assert np.abs(errors).max() < 0.25 and abs(np.mean(errors)) < 0.02


def test_chunks_do_not_change_a_fingerprint(monkeypatch):
    batch = [" ".join(f"w{i * k % 97}" for i in range(400)) for k in range(1, 9)] + ["", None, "a"]
    whole = fingerprints.fingerprints(batch)
    monkeypatch.setattr(fingerprints, "CHUNK", 16)
    assert (fingerprints.fingerprints(batch) == whole).all()


def test_unusual_rows(spark, odd, with_clashes, empty):
    for df in (odd, with_clashes):
        rows = fingerprints.neighbour_fingerprints(df).collect()
        assert len(rows) == df.count()
        own = {}
        for r in rows:
            own.setdefault(r["doc_id"], r["fingerprint"])
        assert own[4] == own[5] and own[1] == own[2] == own[3]
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints.neighbour_fingerprints(empty).count() == 0
    one = fingerprints.neighbour_fingerprints(odd.where("doc_id = 4")).collect()
    assert [r["near_next"] for r in one] == [1.0]
    null_id = spark.createDataFrame([(None, "a b c"), (1, "d e f g h i")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.neighbour_fingerprints(null_id).collect()}
    assert got[1]["edited_sha256"] == hashlib.sha256(b"d e f g a b").hexdigest()
    assert got[None]["edited_sha256"] == hashlib.sha256(b"a b d").hexdigest()
