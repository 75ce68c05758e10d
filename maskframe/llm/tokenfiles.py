"""Files of token ids in Simple-8b words (Anh and Moffat, "Index compression using 64-bit words", 2010).

A word's top four bits select how many ids its other 60 bits hold, and of how many bits each. One
selector is 240 zeros in no bits, one is an escape: the id, of 60 bits or more, is in a list behind the block's
words. A file is a magic number, blocks of ``BLOCK_IDS`` ids, and a footer with the documents'
ids and lengths and each block's place, so a reader can decode any block by itself, with numpy, a selector at a time.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import new_folder
from .common import slices, written
from .store import made, opened, own_name
from .tokens import encoder

# Ids in a word and bits of each, for selectors 0 to 15; selector 1 is the escape.
COUNTS = (240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 1
BLOCK_IDS, FILE_IDS = 1 << 16, 1 << 24
MAGIC = b"S8BTOK\x00\x01"


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escaped ids (all uint64) of a block of unsigned 64-bit ids."""
    n = len(ids)
    padded = np.concatenate([ids.astype(np.uint64), np.zeros(COUNTS[0], np.uint64)])
    selector = np.full(n, ESCAPE, np.int8)
    large = np.zeros(len(padded) + 1, np.int32)
    for s in sorted((s for s in range(16) if s != ESCAPE), key=COUNTS.__getitem__):
        np.cumsum(padded >= np.uint64(1 << BITS[s]), dtype=np.int32, out=large[1:])
        np.copyto(selector, np.int8(s), where=large[COUNTS[s] : COUNTS[s] + n] == large[:n])
    step = np.array(COUNTS, np.int64)[selector].tolist()
    places, at = [], 0
    while at < n:
        places.append(at)
        at += step[at]
    places = np.array(places, np.int64)
    chosen = selector[places].astype(np.int64) if n else places
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            firsts, packed = places[mine], words[mine]
            for lane in range(COUNTS[s]):
                packed |= padded[firsts + lane] << np.uint64(lane * BITS[s])
            words[mine] = packed
    return words, padded[places[chosen == ESCAPE]] if n else padded[:0]


def decode_block(words: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS, np.int64)[selector]
    starts = np.cumsum(counts) - counts
    out = np.zeros(n + COUNTS[0], np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            lanes = np.arange(COUNTS[s])
            mask = np.uint64((1 << BITS[s]) - 1)
            out[starts[mine][:, None] + lanes] = (words[mine][:, None] >> (lanes * BITS[s]).astype(np.uint64)) & mask
    out[starts[selector == ESCAPE]] = escaped
    return out[:n]


class Writer:
    """Appends documents to one file."""

    def __init__(self, out) -> None:
        self.out, self.at = out, out.write(MAGIC)
        self.held, self.n_held, self.n_ids = [], 0, 0
        self.documents: list[int | None] = []
        self.lengths: list[int] = []
        self.blocks: list[tuple[int, int, int, int]] = []

    def _block(self, ids: np.ndarray) -> None:
        words, escaped = encode_block(ids)
        data = words.astype("<u8").tobytes() + escaped.astype("<u8").tobytes()
        self.blocks.append((self.at, len(ids), len(words), len(escaped)))
        self.out.write(data)
        self.at += len(data)

    def add(self, document: int | None, ids: np.ndarray) -> None:
        self.documents.append(document)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BLOCK_IDS:
            every = np.concatenate(self.held)
            whole = len(every) - len(every) % BLOCK_IDS
            for at in range(0, whole, BLOCK_IDS):
                self._block(every[at : at + BLOCK_IDS])
            self.held, self.n_held = [every[whole:]], len(every) - whole

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        known = np.array([d is not None for d in self.documents], np.uint8)
        numbers = np.array([d or 0 for d in self.documents], "<i8")
        lengths = np.array(self.lengths, "<i8")
        blocks = np.array(self.blocks, "<i8").reshape(-1, 4)
        footer = struct.pack("<qq", len(numbers), len(blocks)) + numbers.tobytes() + lengths.tobytes() + blocks.tobytes() + known.tobytes()
        self.out.write(footer + struct.pack("<q", len(footer)) + MAGIC)
        self.out.close()


def footer_of(source) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, lengths, and blocks (offset, ids, words, escapes) of an open file."""
    size = source.size()
    tail = source.read_at(16, size - 16)
    if tail[8:] != MAGIC or source.read_at(8, 0) != MAGIC:
        raise ValueError("not a whole file of token ids")
    (length,) = struct.unpack("<q", tail[:8])
    data = source.read_at(length, size - 16 - length)
    n, k = struct.unpack_from("<qq", data)
    numbers = np.frombuffer(data, "<i8", n, 16)
    lengths = np.frombuffer(data, "<i8", n, 16 + 8 * n)
    blocks = np.frombuffer(data, "<i8", 4 * k, 16 + 16 * n).reshape(-1, 4)
    known = np.frombuffer(data, np.uint8, n, 16 + 16 * n + 32 * k)
    return [int(d) if ok else None for d, ok in zip(numbers, known, strict=True)], lengths, blocks


def read_block(source, block: np.ndarray) -> np.ndarray:
    offset, n, words, escaped = map(int, block)
    data = np.frombuffer(source.read_at(8 * (words + escaped), offset), "<u8")
    return decode_block(data[:words], data[words:], n)


def read_file(source):
    """``(document, ids)`` of every document of an open file, a block in memory at a time."""
    documents, lengths, blocks = footer_of(source)
    held, number = np.zeros(0, np.uint64), 0
    for document, length in zip(documents, lengths.tolist(), strict=True):
        parts = [held[:length]]
        missing = length - len(parts[0])
        held = held[length:]
        while missing:
            ids = read_block(source, blocks[number])
            number += 1
            parts.append(ids[:missing])
            held = ids[missing:]
            missing -= len(parts[-1])
        yield document, np.concatenate(parts)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Files in ascending ``doc_id`` order in ``folder`` and their list: ``part``, ``number``, ``file``, ``n_documents``, ``n_ids``.

    ``end_id`` follows each document.

    - A null or empty text is the end id alone. Null ids come first. Rows that repeat an id stand side
      by side, in the order of a hash of their texts.
    - Other columns are not looked at. An empty table gives an empty list and no file.
    """
    made(folder)
    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_documents", pa.int64()), ("n_ids", pa.int64())])

    def run(batches):
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        files, path = opened(folder)
        out, number, name = None, 0, ""

        def done():
            out.close()
            row = {"part": part, "number": number, "file": name, "n_documents": len(out.documents), "n_ids": out.n_ids}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in slices(batches, most=4 << 20):
            for document, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if out is None:
                    name = own_name(part, number, ".s8b")
                    out = Writer(files.open_output_stream(f"{path}/{name}", compression=None))
                out.add(document, np.frombuffer(encode.ids(text) + end, "<u4"))
                if out.n_ids >= file_ids:
                    yield done()
                    out, number = None, number + 1
        if out is not None:
            yield done()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sorted_docs = plain.repartitionByRange(*order).sortWithinPartitions(*order)
    shape = "part int, number int, file string, n_documents long, n_ids long"
    return written(sorted_docs.mapInArrow(run, shape), "ids-list")


def read_ids(listed: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """For each document, from the files: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32``; perhaps ``ids``."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches):
        files, path = opened(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows = []
                with files.open_input_file(f"{path}/{name}") as source:
                    for document, ids in read_file(source):
                        row = {"doc_id": document, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4"))}
                        rows.append(row | {"ids": ids} if with_ids else row)
                        start += len(ids)
                        if len(rows) >= 10_000 or with_ids:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = listed.select("part", "number", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    # Counted from the files: rows that name them are few bytes, and would be put together in one task.
    dealt = placed.repartition(max(1, listed.count()), "file").select("file", "start")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def stored_ids(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """The documents' ids written to files in the shared folder, and what the files hold of each document."""
    folder = new_folder(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, folder, tokenizer, end_id), folder)
