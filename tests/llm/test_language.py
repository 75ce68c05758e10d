import zlib

import numpy as np

from maskframe.llm import language
from maskframe.llm.queries import QUERIES

from .conftest import SF, texts

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = {r["doc_id"]: r for r in docs.collect()}
    found = QUERIES["op3_language"](spark, FOLDER).collect()
    assert len(found) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held]) > 0.93


def counted(text):
    out = np.zeros(language.BUCKETS)
    for ids in language.text_buckets(text):
        for i in ids:
            out[i] += 1
    return out


def test_scores_are_those_of_a_plain_naive_bayes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 3000")
    rows = {r["doc_id"]: r for r in docs.collect()}
    sums, n = {}, {}
    for i, r in rows.items():
        if zlib.crc32(str(i).encode()) % 3 != 1:
            sums[r["lang"]] = sums.get(r["lang"], 0) + counted(r["text"])
            n[r["lang"]] = n.get(r["lang"], 0) + 1
    names = sorted(sums)
    logs = np.array([np.log((sums[x] + language.SMOOTHING) / (sums[x] + language.SMOOTHING).sum()) for x in names])
    prior = np.log(np.array([n[x] for x in names]) / sum(n.values()))
    for r in language.identify(docs, language.train(docs)).collect():
        c = counted(rows[r["doc_id"]]["text"])
        if not c.sum():
            assert r["lang_pred"] == "und"
            continue
        total = prior + logs @ c
        p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert r["lang_pred"] == names[int(total.argmax())]
        assert abs(r["score"] - p.max()) < 1e-6


def test_stretches_give_the_same_counts(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog " * 40
    whole = counted(text)
    monkeypatch.setattr(language, "STRETCH", 37)
    parts = sum(1 for _ in language.text_buckets(text))
    assert parts > 10
    # overlaps repeat the shorter n-grams of at most three characters a stretch
    assert np.abs(counted(text) - whole).sum() <= 9 * parts


def test_unusual_rows(odd, with_clashes, empty):
    model = language.train(odd)
    learned = {r["lang"] for r in odd.collect() if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    assert language.train(with_clashes).languages == model.languages == sorted(learned)
    found = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1, 2, 3, 11))
    kept = language.accepted(with_clashes, model, least=0.0)
    assert kept.columns == with_clashes.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(4, 15)) - {11}
    nothing = language.train(empty)
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0
    assert len(texts(odd)) == language.identify(odd, model).count()
