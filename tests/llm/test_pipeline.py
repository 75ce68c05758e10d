"""The pipeline beside a version of it by brute force."""

import corpus_pipeline
from maskframe.llm import language, packing
from maskframe.llm.tokens import tokenizer_file
from maskframe.llm.queries import QUERIES

from . import brute
from .conftest import SF, clashing, texts
from .test_packing import checked


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    known = [(r["doc_id"], r["text"]) for r in docs.collect() if (p := model.predict([r["text"]])[0])[0] != "und" and p[1] >= 0.5]
    first = {i for i, (_, c) in brute.components(known, 5).items() if i == c}
    kept = sorted((i, t) for i, t in known if i in first)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted({r["doc_id"] for r in rows}) == [i for i, _ in kept]
    whole = corpus_pipeline.private_data_replaced(spark, spark.createDataFrame(kept, "doc_id long, text string"), SF)
    clean = texts(whole)
    for i, text in clean:
        before = dict(kept)[i]
        marks = ("[NAME]", "[WORD]", "[NUMBER]", "[SECRET]")  # a word that tells of a value is generalised where the value is not, too
        assert (text == before) or brute.base_spans(before) or any(text.count(m) > before.count(m) for m in marks)
        assert not [s for s in brute.base_spans(text) if s[0] == "email"]
    sizes = checked(rows, clean, tokenizer_file("word_bpe_49k.json"))
    assert sum(packing.full(s, 4096) for s in sizes) < 0.05 * sum(sizes)


def test_stages_keep_the_columns(spark):
    docs = clashing(spark.read.parquet(f"{SF}/documents.parquet"))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    assert "doc_id" in corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns


def test_empty_and_unusual_documents(spark, odd, empty):
    for df, left in ((odd, {4, 7, 9, 10, 12, 13, 14}), (empty, set())):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
        assert {r["doc_id"] for r in df.collect()} <= left


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
