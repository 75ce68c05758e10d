import hashlib
import random

import pytest
import sentencepiece

from maskframe.llm import pieces
from maskframe.llm.tokens import tokenizer_file

from . import brute
from .conftest import SF, texts

PATH = tokenizer_file("piece_bpe_32k.model")
WORDS = ["▁the", "▁naïve", "☃", "▁日本", "abcdefghijklmnopqrstuvwxyz" * 3, "▁", "▁▁▁", "a", "é́", "\U0001F600", "tion", "▁internationalisation"]


def by_hand(word):
    """The best of all segmentations, scores added from the left, by trying them all from the front with memory."""
    table = pieces.table_of(PATH)
    best = {0: (0.0, [])}
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            hit = table.pieces.get(word[start:end]) or ((None, table.unknown_score) if end - start == 1 else None)
            if hit:
                ids = [hit[0]] if hit[0] is not None else [table.byte_ids[b] for b in word[start:end].encode()]
                options.append((best[start][0] + hit[1], -start, best[start][1] + ids))
        score, _, ids = max(options, key=lambda o: o[:2])
        best[end] = (score, ids)
    return best[len(word)][1]


def test_fold_finds_the_best_path(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    table = pieces.table_of(PATH)
    words = sorted({w for _, t in texts(docs) for w in pieces.words_of(table, t)} | set(WORDS))
    got = {r["word"]: r["ids"] for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), PATH).collect()}
    assert got == {w: by_hand(w) for w in words}
    assert got == {w: pieces.best_path(table, w) for w in words}


def test_words_beyond_the_fold_take_the_same_path(spark, monkeypatch):
    df = spark.createDataFrame([(w,) for w in WORDS], "word string")
    folded = {r["word"]: r["ids"] for r in pieces.encode_words(df, PATH).collect()}
    monkeypatch.setattr(pieces, "LONGEST_WORD", 2)
    assert {r["word"]: r["ids"] for r in pieces.encode_words(df, PATH).collect()} == folded


def unigram_library():
    """The library over the same pieces and scores as a unigram model: the file with its model type set to 1.

    Its n-best search finds the path of the highest sum; its plain ``encode`` prefers others here.
    """
    data = open(PATH, "rb").read()
    at = data.index(b"\x18\x02 \x80\xfa\x01")  # model_type 2 (BPE), then vocab_size 32000, in the trainer's part
    return sentencepiece.SentencePieceProcessor(model_proto=data[:at] + b"\x18\x01" + data[at + 2 :])


def test_paths_are_those_of_the_library_s_lattice(spark):
    table, library = pieces.table_of(PATH), unigram_library()
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1500")
    words = {w for _, t in texts(docs) for w in pieces.words_of(table, t) if w[0] == "▁" and len(w) > 1}
    for w in sorted(words)[:2000]:
        found, best = pieces.best_path(table, w), library.nbest_encode(w[1:], nbest_size=2, out_type=int)[0]
        score = lambda ids: sum(library.get_score(i) for i in ids)
        assert found == best or score(found) == score(best), w


def test_documents_are_their_words_in_a_row_and_decode(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1500")
    table = pieces.table_of(PATH)
    rows = {r["doc_id"]: r for r in pieces.encode(docs, PATH, with_ids=True).collect()}
    assert len(rows) == docs.count()
    for i, text in texts(docs):
        assert rows[i]["ids"] == [x for w in pieces.words_of(table, text) for x in pieces.best_path(table, w)]
        assert rows[i]["n_pieces"] == len(rows[i]["ids"]) and rows[i]["ids_crc32"] == brute.crc32(rows[i]["ids"])
        assert rows[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_texts_are_not_shuffled_and_blocks_read_by_parts_are_whole(spark, folder, capsys, monkeypatch):
    rnd = random.Random(4)
    names = ["".join(rnd.choice("abcdefgh☃é日") for _ in range(rnd.randint(1, 12))) for _ in range(300)]
    made = [(i, " ".join(rnd.choice(names) for _ in range(rnd.randint(0, 60))) if i % 17 else None) for i in range(400)]
    spark.createDataFrame(made, "doc_id long, text string").coalesce(3).write.option("parquet.block.size", 4096).parquet(f"{folder}/docs")
    docs, table = spark.read.parquet(f"{folder}/docs"), pieces.table_of(PATH)
    # Words, edges, pairs and blocks of a row are taken a few at a time, blocks have some 20 rows, and tasks read parts of them.
    for name, few in (("MOST_WORDS", 40), ("MOST_EDGES", 50), ("MOST_PAIRS", 30), ("SHELF", 2), ("TASK_LETTERS", 100)):
        monkeypatch.setattr(pieces, name, few)
    for place in (pieces.FILE_PLACE, None):
        small = {"spark.sql.files.maxPartitionBytes": "12k", "spark.sql.files.openCostInBytes": "1k"}
        for key, value in small.items():
            spark.conf.set(key, value)
        try:
            assert spark.read.parquet(f"{folder}/docs").rdd.getNumPartitions() > 6
            found = pieces.encode(docs, PATH, block_bytes=5_000, with_ids=True, place=place)
        finally:
            for key in small:
                spark.conf.unset(key)
        found.explain()  # and the last reading is by other parts than the first
        assert "hashpartitioning" not in capsys.readouterr().out
        rows = {r["doc_id"]: r for r in found.collect()}
        assert len(rows) == len(made)
        for i, text in made:
            assert rows[i]["ids"] == [x for w in pieces.words_of(table, text) for x in by_hand(w)], i
            assert rows[i]["n_pieces"] == len(rows[i]["ids"]) and rows[i]["ids_crc32"] == brute.crc32(rows[i]["ids"])
            assert rows[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_blocks_are_small_where_long_texts_stand_together(spark, tmp_path):
    from pyspark.sql import functions as F

    made = [(i, "ab " * (2 if i < 4000 else 2000)) for i in range(4200)]
    spark.createDataFrame(made, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    placed, most = pieces._placed(spark.read.parquet(f"{tmp_path}/docs"), 50_000, pieces.FILE_PLACE)
    blocks = placed.groupBy("block").agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("rows")).collect()
    assert sum(b["rows"] for b in blocks) == 4200 and len(blocks) <= most
    assert max(b["size"] for b in blocks) <= 100_000


def test_a_task_of_the_lattice_has_few_letters(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    words = spark.range(60_000).select(F.concat(F.lit("▁"), F.translate(F.hex(F.xxhash64("id")), "0123456789ABCDEF", "etaoinshrdlucmfw")).alias("word"))
    docs = words.select(F.col("word").alias("text"), F.xxhash64("word").alias("doc_id"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/docs")
    most, encode_words = [], pieces.encode_words

    def seen(words, path):
        letters = words.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sum(F.char_length("word")).alias("letters"))
        most.append(letters.agg(F.max("letters")).first()[0])
        return encode_words(words, path)

    monkeypatch.setattr(pieces, "encode_words", seen)
    assert pieces.encode(spark.read.parquet(f"{tmp_path}/docs"), PATH, place=pieces.FILE_PLACE).count() == 60_000
    assert most[0] < 1.5 * pieces.TASK_LETTERS  # all 1,020,000 letters or a great part of them, if Spark chooses the tasks


def test_many_ids_decode_as_one_text_s_do():
    import numpy as np

    rnd, table = random.Random(6), pieces.table_of(PATH)
    mark, usable = next(i for i, t in enumerate(table.texts) if t == "▁"), [i for i, t in enumerate(table.texts) if t != ""]
    in_bytes = [table.byte_ids[b] for b in "▁☃é".encode()]
    made = [[], [mark], [mark, mark], in_bytes, in_bytes[:2], [in_bytes[0], mark], [table.unknown, mark], [mark, *in_bytes, mark, in_bytes[1]]]
    made += [[rnd.choice(usable + in_bytes * 3000) for _ in range(rnd.randint(1, 40))] for _ in range(300)]
    ends = np.cumsum([len(ids) for ids in made])
    found = pieces._decoded_texts(PATH, np.array([i for ids in made for i in ids], "<u4"), ends)
    assert found == [pieces.decoded(table, ids).encode() for ids in made]


def test_decoding_is_the_library_s(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    made = [(i, library.encode(t or "")) for i, t in texts(docs)] + [(-1, []), (-2, None), (-3, [0, 5, 300, 1, 2])]
    got = {r["doc_id"]: r["text"] for r in pieces.decode(spark.createDataFrame(made, "doc_id long, ids array<int>"), PATH).collect()}
    assert got == {i: None if ids is None else library.decode(ids) for i, ids in made}


def test_unusual_rows(odd, with_clashes, empty):
    for df in (odd, with_clashes):
        rows = pieces.encode(df, PATH, block_bytes=50_000).collect()
        assert len(rows) == df.count()
        by_id = {r["doc_id"]: r for r in rows}
        assert by_id[1]["n_pieces"] == by_id[2]["n_pieces"] == 0
        for i, text in texts(df):
            assert by_id[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest(), i
    assert pieces.encode(empty, PATH).count() == 0


@pytest.mark.parametrize("text", ["", "a", "  a  b ", "a▁b", "日本 ☃ x"])
def test_words_join_to_the_normalised_text(text):
    table = pieces.table_of(PATH)
    assert "".join(pieces.words_of(table, text)) == table.model.normalize(text)
