import io

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskframe.llm import tokencounts, tokenfiles
from maskframe.llm.queries import QUERIES
from maskframe.llm.tokens import tokenizer_file
from maskframe.workspace import new_folder

from . import brute
from .conftest import SF, texts

TOKENIZER = "byte_bpe_50k.json"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**32), st.integers(0, 2**64 - 1), st.just(0)), max_size=700))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, escaped = tokenfiles.encode_block(ids)
    assert (tokenfiles.decode_block(words, escaped, len(ids)) == ids).all()
    assert (escaped >= 2**60).all()


def test_packing_density():
    words, _ = tokenfiles.encode_block(np.zeros(2400, np.uint64))
    assert len(words) == 10
    words, _ = tokenfiles.encode_block(np.full(3000, 50_000, np.uint64))
    assert len(words) == 1000


class Sink(io.BytesIO):
    def close(self):
        self.whole = self.getvalue()


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def test_files_round_trip(monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK_IDS", 100)
    rnd = np.random.default_rng(1)
    docs = [(i if i else None, rnd.integers(0, 50_257, n).astype("<u4")) for i, n in enumerate([3, 0, 250, 1, 99, 100, 1000, 1])]
    sink = Sink()
    out = tokenfiles.Writer(sink)
    for d, ids in docs:
        out.add(d, ids)
    out.close()
    got = list(tokenfiles.read_file(Source(sink.whole)))
    assert [d for d, _ in got] == [d for d, _ in docs]
    assert all((a == b).all() and len(a) == len(b) for (_, a), (_, b) in zip(got, docs, strict=True))
    with pytest.raises(ValueError):
        tokenfiles.footer_of(Source(sink.whole[:-1]))


def test_query_over_files(spark):
    rows = sorted(QUERIES["op8_token_files"](spark, SF).collect(), key=lambda r: r["doc_id"])
    start, path = 0, tokenizer_file(TOKENIZER)
    for r, (i, text) in zip(rows, sorted(texts(spark.read.parquet(f"{SF}/documents.parquet"))), strict=True):
        ids = brute.library_ids(path, text) + [0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), brute.crc32(ids))
        start += len(ids)


def test_many_small_files_keep_the_order(spark, folder):
    docs = spark.createDataFrame([(i * 7 % 101, f"text number {i} " * (i % 5)) for i in range(101)], "doc_id long, text string")
    listed = tokenfiles.write_ids(docs, folder + "/ids", tokenizer_file(TOKENIZER), file_ids=20)
    assert listed.count() > 10
    rows = sorted(tokenfiles.read_ids(listed, folder + "/ids", with_ids=True).collect(), key=lambda r: r["doc_id"])
    start, by_id = 0, dict(texts(docs))
    for r in rows:
        assert r["ids"] == brute.library_ids(tokenizer_file(TOKENIZER), by_id[r["doc_id"]]) + [0]
        assert r["start"] == start
        start += r["n_tokens"]


def test_unusual_rows(odd, with_clashes, empty):
    for df in (odd, with_clashes):
        rows = tokenfiles.stored_ids(df, tokenizer_file(TOKENIZER)).collect()
        assert len(rows) == df.count()
        assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert tokenfiles.stored_ids(empty, tokenizer_file(TOKENIZER)).count() == 0


def test_counts(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op6_token_counts"](spark, SF).collect()}
    for i, text in texts(spark.read.parquet(f"{SF}/documents.parquet")):
        n = len(brute.library_ids(tokenizer_file(TOKENIZER), text))
        r = rows.pop(i)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((text or "").encode()), n, n > 512)
    assert not rows


def test_cache_is_used_and_grows_by_what_it_lacks(spark, odd):
    cache = new_folder(spark, "cache")
    path = tokenizer_file(TOKENIZER)
    version = tokencounts.tokenizer_digest(path)
    first = tokencounts.token_counts(odd.where("doc_id < 8"), path, cache).collect()
    distinct = odd.where("doc_id < 8").selectExpr("coalesce(text, '')").distinct().count()
    assert tokencounts.cached(spark, cache, version).count() == distinct
    # what the cache says is believed, so a changed count shows that nothing is encoded again
    stored = tokencounts.cached(spark, cache, version).collect()
    fake = new_folder(spark, "cache")
    rows = [(bytes(r["content"]), r["n_tokens"] + 1000, version) for r in stored]
    spark.createDataFrame(rows, "content binary, n_tokens long, tokenizer string").write.partitionBy("tokenizer").parquet(fake)
    again = tokencounts.token_counts(odd, path, fake).collect()
    assert len(again) == odd.count()
    assert {(r["doc_id"], r["n_tokens"] + 1000) for r in first} == {(r["doc_id"], r["n_tokens"]) for r in again if r["doc_id"] < 8}
    assert tokencounts.cached(spark, fake, version).count() == odd.selectExpr("coalesce(text, '')").distinct().count()
    assert tokencounts.cached(spark, fake, "another").count() == 0


def test_counts_of_unusual_rows(spark, with_clashes, empty):
    path = tokenizer_file("piece_bpe_32k.model")
    assert tokencounts.token_counts(with_clashes, path, new_folder(spark, "cache")).count() == with_clashes.count()
    assert tokencounts.token_counts(empty, path, new_folder(spark, "cache")).count() == 0


