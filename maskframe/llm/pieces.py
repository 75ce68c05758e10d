"""Encoding and decoding with a SentencePiece table: a lattice of pieces for each word, and the best path through it.

All substrings of a distinct word, up to the longest piece's length, are exploded and joined to the piece table; the matches are the
edges of the word's lattice. They are grouped by word, and the end positions are walked from left to right, those of all
words of a batch at once, keeping the best score and its last edge for each (Viterbi). A character that no piece starts and ends with gets an edge
of its own, worse than any piece by ``UNKNOWN_PENALTY``, and becomes its UTF-8 bytes' pieces.

Words here are the stretches no piece can cross: a text is cut between two characters that stand side by
side in no piece of the table, so the best path of the text is the words' best paths in a row.

Texts stay where they are read. Rows that stand together in a file are a block; only a block's distinct words travel, to be encoded
once for all blocks, and come back as the block's own small dictionary, a file that tasks open when they reach the block.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import new_folder
from .common import release, slices, written, written_to
from .store import opened

BLOCK_BYTES, UNKNOWN_PENALTY = 16 << 20, 10.0
LONGEST_WORD = 256  # longer words take the same path search by themselves; their edges would be one large row
FILE_PLACE = ("_metadata.file_path", "_metadata.row_index")  # where a row of a table of files stands, however it is read
SHELF, MOST_WORDS, MOST_EDGES, MOST_PAIRS = 512, 1 << 20, 1 << 20, 1 << 20  # blocks in one row; words, edges and pairs held by a task
TASK_LETTERS = 200_000  # of distinct words in a task of the lattice, whose edges take some 300 times the room while they are sorted
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass
class Table:
    """What a model file says: the pieces that encode, the bytes' ids, and where texts may be cut."""

    model: object
    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int] | None
    unknown: int
    unknown_score: float
    longest: int
    classes: np.ndarray
    together: np.ndarray
    texts: list[str | bytes]
    scores: np.ndarray


@cache
def table_of(path: str) -> Table:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, in_bytes, texts = {}, {}, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        found = _BYTE.fullmatch(piece) if model.is_byte(i) else None
        if found:
            in_bytes[int(found[1], 16)] = i
            texts.append(bytes([int(found[1], 16)]))
        elif model.is_control(i):
            texts.append("")
        elif model.is_unknown(i) or model.is_unused(i):
            texts.append(" ⁇ " if model.is_unknown(i) else piece)
        else:
            pieces[piece] = (i, model.get_score(i))
            texts.append(piece)
    letters = sorted({c for p in pieces for c in p})
    classes = np.zeros(0x110000, np.int32)
    for i, c in enumerate(letters, 1):
        classes[ord(c)] = i
    together = np.zeros((len(letters) + 1, len(letters) + 1), np.bool_)
    for p in pieces:
        codes = classes[[ord(c) for c in p]]
        together[codes[:-1], codes[1:]] = True
    scores = np.zeros(len(texts) + 1)
    for i, s in pieces.values():
        scores[i] = s
    worst = scores[-1] = min(s for _, s in pieces.values()) - UNKNOWN_PENALTY
    return Table(
        model, pieces, [in_bytes[b] for b in range(256)] if len(in_bytes) == 256 else None, model.unk_id(),
        worst, max(map(len, pieces)), classes, together, texts, scores,
    )


def words_of(table: Table, text: str | None) -> list[str]:
    """The normalised text, cut wherever no piece can cross."""
    plain = table.model.normalize(text or "")
    codes = table.classes[np.frombuffer(plain.encode("utf-32-le"), np.uint32)]
    cuts = (np.flatnonzero(~table.together[codes[:-1], codes[1:]]) + 1).tolist()
    return [plain[a:b] for a, b in zip([0, *cuts], [*cuts, len(plain)], strict=True)] if plain else []


def _bytes_of(table: Table, letter: str) -> list[int]:
    if table.byte_ids is None:
        return [table.unknown]
    return [table.byte_ids[b] for b in letter.encode()]


def best_path(table: Table, word: str) -> list[int]:
    """Viterbi over one word, for words beyond the fold's length; of equal scores the longer last piece."""
    best: list[tuple[float, int, int]] = [(0.0, 0, -1)]
    for end in range(1, len(word) + 1):
        found = None
        for start in range(max(0, end - table.longest), end):
            hit = table.pieces.get(word[start:end])
            if hit is None and start == end - 1:
                hit = (-1, table.unknown_score)
            if hit and (found is None or best[start][0] + hit[1] > found[0]):
                found = (best[start][0] + hit[1], start, hit[0])
        best.append(found)
    out, at = [], len(word)
    while at:
        _, start, piece = best[at]
        out.append([piece] if piece >= 0 else _bytes_of(table, word[start:at]))
        at = start
    return [i for part in reversed(out) for i in part]


def _best_paths(table: Table, lattices: pa.RecordBatch) -> pa.ListArray:
    """Viterbi over the edges of many words, an end position of all of them at a time; of equal scores the longer last piece."""
    words, edges = lattices.column("word").to_pylist(), lattices.column("edges")
    sizes, packed = np.array([len(w) for w in words], np.int64), edges.flatten().to_numpy()
    row = np.repeat(np.arange(len(words)), pc.list_value_length(edges).to_numpy())
    start = (packed >> 48) - (packed >> 32 & 0xFFFF)
    order = np.argsort(((packed >> 48) * len(words) + row) * sizes.max(initial=0) + start)
    start, row, packed = start[order], row[order], packed[order]
    end, ids = packed >> 48, (packed & 0xFFFFFFFF) - 1
    score = table.scores[ids]  # that of -1 is the last
    base = np.cumsum(sizes + 1) - sizes - 1  # where a word's positions begin, its front being the first of them
    best, last, piece = (np.zeros(int((sizes + 1).sum()), t) for t in (np.float64, np.int64, np.int32))
    levels = np.searchsorted(end, np.arange(1, int(sizes.max(initial=0)) + 2))
    for a, b in zip(levels[:-1], levels[1:], strict=True):
        here, reached = row[a:b], best[base[row[a:b]] + start[a:b]] + score[a:b]
        first = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
        most = np.maximum.reduceat(reached, first)
        hits = np.flatnonzero(reached == np.repeat(most, np.diff(np.r_[first, b - a])))
        taken = hits[np.r_[True, here[hits][1:] != here[hits][:-1]]]  # edges of a word stand by start, so the first hit is the longest
        at = base[here[taken]] + end[a]
        best[at], last[at], piece[at] = most, start[a:b][taken], ids[a:b][taken]
    on_path, at, of = np.zeros(len(best), np.bool_), sizes.copy(), np.arange(len(words))
    while len(of):
        place = base[of] + at
        on_path[place], at = True, last[place]
        of, at = of[at > 0], at[at > 0]
    path = np.flatnonzero(on_path)
    of = np.searchsorted(base, path, "right") - 1
    found, counts = piece[path], np.ones(len(path), np.int64)
    unknown = np.flatnonzero(found < 0)
    letters = [_bytes_of(table, words[of[i]][path[i] - base[of[i]] - 1]) for i in unknown.tolist()]
    counts[unknown] = [len(x) for x in letters]
    ends = np.cumsum(counts)
    values = np.repeat(found, counts)
    for i, letter in zip(unknown.tolist(), letters, strict=True):
        values[ends[i] - len(letter) : ends[i]] = letter
    offsets = np.r_[0, ends][np.r_[0, np.cumsum(np.bincount(of, minlength=len(words)))]]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """``piece``, ``id``, ``score``: a row for each piece that can encode, as many as the file has."""
    rows = pd.DataFrame([(p, i, s) for p, (i, s) in table_of(path).pieces.items()], columns=["piece", "id", "score"])
    return spark.createDataFrame(rows, "piece string, id int, score double")


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """``word`` and ``ids`` for a table of distinct words, by the lattice and the fold."""
    spark, table = words.sparkSession, table_of(path)
    # The table has a fixed number of rows, so every task may hold it.
    known = F.broadcast(piece_table(spark, path).select("piece", "id"))
    short = words.where(F.char_length("word") <= LONGEST_WORD).select("word")
    n = F.char_length("word")
    starts = short.select("word", F.explode(F.sequence(F.lit(1), n)).alias("at"))
    ends = starts.select("word", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(table.longest), n - F.col("at") + 1))).alias("size"))
    spans = ends.select("word", "at", "size", F.expr("substr(word, at, size)").alias("piece"))
    edges = spans.join(known, "piece", "left").where("id is not null or size = 1")
    # An edge is one number, as a struct takes five times the room while edges are grouped. Its score goes by its id.
    end = (F.col("at") + F.col("size") - 1).cast("long")
    edge = F.shiftleft(end, 48) + F.shiftleft(F.col("size").cast("long"), 32) + F.coalesce("id", F.lit(-1)) + 1
    grouped = edges.groupBy("word").agg(F.collect_list(edge).alias("edges"))
    found_in = pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))])

    def walked(batches):
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("edges")).to_numpy())
            start = 0
            while start < batch.num_rows:
                base = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + MOST_EDGES, "right")))
                own = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([own.column("word"), _best_paths(table_of(path), own)], schema=found_in)
                start = stop

    folded = grouped.mapInArrow(walked, "word string, ids array<int>")

    def long_words(frames):
        for frame in frames:
            yield frame.assign(ids=[best_path(table_of(path), w) for w in frame["word"]])

    rest = words.where(F.char_length("word") > LONGEST_WORD).select("word")
    return folded.union(rest.mapInPandas(long_words, "word string, ids array<int>"))


def _placed(docs: DataFrame, block_bytes: int, place: tuple[str, str] | None) -> tuple[DataFrame, int]:
    """``doc_id``, ``text`` and ``block``, the same at every reading, and about how many blocks there are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    own = [F.col("doc_id").cast("long").alias("doc_id"), text]
    if place is None:
        docs, place = written(docs.select(*own), "texts"), FILE_PLACE
    plain = docs.select(*own, F.col(place[0]).alias("file"), F.col(place[1]).alias("row"))
    total, rows, files = plain.agg(F.sum(F.octet_length("text")), F.count(F.lit(1)), F.approx_count_distinct("file")).first()
    total = total or 0
    together = max(1, block_bytes * rows // max(total, 1))
    plain = plain.withColumn("stretch", F.xxhash64("file", F.floor(F.col("row") / together)))
    # Where long texts stand together a stretch is cut; these are at most one for twice ``block_bytes`` of text, so every task may hold them.
    sizes = plain.groupBy("stretch").agg(F.sum(F.octet_length("text")).alias("size")).where(F.col("size") > 2 * block_bytes)
    heavy = written(sizes.select("stretch", F.ceil(F.col("size") / block_bytes).alias("parts")), "heavy")
    part = F.floor(F.col("row") % together * F.coalesce("parts", F.lit(1)) / together)
    block = F.xxhash64("stretch", part).alias("block")
    return plain.join(F.broadcast(heavy), "stretch", "left").select("doc_id", "text", block), files + rows // together + total // block_bytes


def _block_words(docs: DataFrame, path: str) -> DataFrame:
    """``block`` and ``word``: the distinct words of each block; more than once where a block is read by parts."""
    schema = pa.schema([("block", pa.int64()), ("word", pa.string())])

    def rows(block, words):
        own = sorted(words)
        for i in range(0, len(own), 8192):
            part = own[i : i + 8192]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.array(part, pa.string())], schema=schema)

    def run(batches):
        table, at, found = table_of(path), None, set()
        for batch in slices(batches):
            for block, text in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if block != at or len(found) > MOST_WORDS:
                    yield from rows(at, found)
                    at, found = block, set()
                found.update(words_of(table, text))
        yield from rows(at, found)

    return docs.select("block", "text").mapInArrow(run, "block long, word string")


def _dealt(encoded: DataFrame) -> DataFrame:
    """``block`` and ``words``: parts of the blocks' dictionaries, from rows of ``word``, ``blocks`` and ``ids``."""
    schema = pa.schema([("block", pa.int64()), ("words", pa.binary())])
    entry = pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))])

    def parts(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = rows.column("blocks").combine_chunks()
        blocks = lists.flatten().to_numpy()
        order = np.argsort(blocks, kind="stable")
        of, blocks = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy())[order], blocks[order]
        cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1], True])
        words, out = rows.select(["word", "ids"]).cast(entry), []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, entry, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(words.take(pa.array(of[a:b])))
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(blocks[cuts[:-1]]), pa.array(out, pa.binary())], schema=schema)

    def run(batches):
        held, pairs = [], 0
        for batch in batches:
            held.append(batch)
            pairs += pc.sum(pc.list_value_length(batch.column("blocks"))).as_py() or 0
            if pairs >= MOST_PAIRS:
                yield parts(held)
                held, pairs = [], 0
        if pairs:
            yield parts(held)

    return encoded.select("word", "blocks", "ids").mapInArrow(run, "block long, words binary")


def _dictionary(folder: str, block: int) -> dict[str, bytes]:
    """Each word of a block with its ids, little-endian unsigned 32-bit."""
    files, path = opened(folder)
    known: dict[str, bytes] = {}
    for found in files.get_file_info(fs.FileSelector(f"{path}/block={block}", allow_not_found=True)):
        if not found.base_name.startswith("part-"):
            continue
        with files.open_input_file(found.path) as f:
            dealt = pq.ParquetFile(f).read(columns=["words"]).column("words")
        for part in dealt:
            with pa.ipc.open_stream(part.as_buffer()) as stream:
                rows = stream.read_all().combine_chunks()
            lists = rows.column("ids").combine_chunks()
            flat, ends = lists.values.to_numpy().astype("<u4").tobytes(), (lists.offsets.to_numpy() * 4).tolist()
            known.update(zip(rows.column("word").to_pylist(), [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], strict=True))
    return known


def decoded(table: Table, ids) -> str:
    """The text of ids: pieces in a row, runs of bytes as UTF-8, the space mark as a space, without the one put in front."""
    out, run, begun = [], b"", False
    for i in ids:
        text = table.texts[i]
        if isinstance(text, bytes):
            run, begun = run + text, True
            continue
        if run:
            out.append(run.decode("utf-8", "replace"))
            run = b""
        out.append(text if begun else text.removeprefix("▁"))
        begun = begun or bool(text)
    if run:
        out.append(run.decode("utf-8", "replace"))
    return "".join(out).replace("▁", " ")


@cache
def _raw(path: str) -> pa.Array:
    return pa.array([t if isinstance(t, bytes) else t.encode() for t in table_of(path).texts], pa.large_binary())


def _decoded_texts(path: str, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """As :func:`decoded`, in UTF-8, for the ids of many texts in a row; none of the ids may be a control's."""
    table, taken = table_of(path), _raw(path).take(pa.array(ids))
    at = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1)
    data, out, a = memoryview(taken.buffers()[2] or b""), [], 0
    for b in ends.tolist():
        first = table.texts[ids[a]] if b > a else ""
        skipped = 3 if isinstance(first, str) and first.startswith("▁") else 0
        out.append(bytes(data[at[a] + skipped : at[b]]).decode("utf-8", "replace").replace("▁", " ").encode())
        a = b
    return out


def encode(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES, with_ids: bool = False, place: tuple[str, str] | None = None) -> DataFrame:
    """For each row: ``doc_id``, ``n_pieces``, ``ids_crc32`` (little-endian unsigned 32-bit ids), ``decoded_sha256``; perhaps ``ids``.

    The ids are those of the path with the highest sum of the table's scores, as SentencePiece's lattice finds it for
    unigram models. ``decoded_sha256`` is of the text that the ids decode to (lowercase hex, UTF-8).

    ``place`` names two columns of ``docs``, a file and a row's number in it, that are the same whenever ``docs`` is read: ``FILE_PLACE`` for a
    table just opened. Without it the texts are copied to the shared folder first. Texts are read four times, and never shuffled.

    - A null or empty text has no pieces and decodes to an empty text.
    - Repeated rows get equal answers. A null ``doc_id`` is kept. Other columns are not looked at.
    - A character that is in no piece becomes bytes, or the unknown id if the table has none.
    - An empty table gives an empty one. Very long texts cost memory in proportion to one of them, in one task.
    - A block has as many rows as make ``block_bytes`` on average, or fewer where they are longer; a task holds the distinct words of one
      block and their ids.
    """
    spark = docs.sparkSession
    placed, n_blocks = _placed(docs, block_bytes, place)
    shelf = F.pmod("block", F.lit(n_blocks // SHELF + 1)).alias("shelf")
    pairs = _block_words(placed, path).select("word", "block", shelf).repartition("word", "shelf")
    asked, asked_at = written_to(pairs.groupBy("word", "shelf").agg(F.collect_set("block").alias("blocks")), "block-words")
    release(spark)
    letters = asked.agg(F.sum(F.char_length("word"))).first()[0] or 0
    words = asked.select("word").repartition(letters // TASK_LETTERS + 1, "word").distinct()
    lexicon, lexicon_at = written_to(encode_words(words, path), "lexicon")
    release(spark)
    folder = new_folder(spark, "dictionaries")
    _dealt(asked.join(lexicon, "word")).repartition("block").write.partitionBy("block").parquet(folder)
    release(spark, asked_at, lexicon_at)

    def assembled(batches):
        table, at, known = table_of(path), None, {}
        for batch in slices(batches):
            found = []
            for block, text in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if block != at:
                    known.clear()
                    at, known = block, _dictionary(folder, block)
                found.append(b"".join(map(known.__getitem__, words_of(table, text))))
            ends = np.cumsum([len(x) // 4 for x in found])
            own = np.frombuffer(b"".join(found), "<u4")
            digests = [hashlib.sha256(x).hexdigest() for x in _decoded_texts(path, own, ends)]
            columns = [batch.column("doc_id"), np.diff(np.r_[0, ends]), [zlib.crc32(x) for x in found], digests]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(own.astype(np.int32))))
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string())]
                       + [("ids", pa.list_(pa.int32()))] * with_ids)
    shape = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string" + ", ids array<int>" * with_ids
    return placed.mapInArrow(assembled, shape)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``doc_id`` and ``ids``; null ids give a null text."""

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decoded(table_of(path), x) for x in ids], dtype=object)

    return encoded.select("doc_id", text_of("ids").alias("text"))
