"""WARC archives with an index: where each record is, so that chosen ones are read by byte range.

Writing: a task compresses each record as a gzip member of its own, appends it to its current archive
and notes archive, offset, length, URL and digest. The notes are the index, a table written by the same job, so it names
exactly the archives of tasks that finished. Reading: the index rows wanted are sorted by archive and
offset, neighbours are joined to one range, and each range is one read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import new_folder
from .common import slices, written
from .store import made, opened, own_name

ARCHIVE_BYTES, RANGE_BYTES, GAP_BYTES = 64 << 20, 8 << 20, 64 << 10
READ_TEXT = 4 << 20
DATE = "1970-01-01T00:00:00Z"
# Fixed value: the profile the WARC standard names for a revisit of an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member. A revisit keeps the HTTP head, with the payload's length in it, and no payload."""
    kind = "response" if refers_to is None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Date", date)]
    if page_id is not None:
        headers.append(("WARC-Record-ID", f"<urn:page:{page_id}>"))
    if url is not None:
        headers.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(headers, head + (payload if refers_to is None else b""))


def _info(date: str) -> bytes:
    return _record([("WARC-Type", "warcinfo"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def _head(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    pairs = (line.partition(": ") for line in head.decode().split("\r\n")[1:])
    return {k.lower(): v for k, _, v in pairs}, rest


def _page(value: str | None) -> int | None:
    return int(value.removeprefix("<urn:page:").removesuffix(">")) if value else None


def parsed(member: bytes, with_html: bool = True) -> dict:
    """What one gzip member says of its page; a response's payload is checked against its digest, and decoded if asked for."""
    headers, rest = _head(zlib.decompress(member, 31))
    block = rest[: int(headers["content-length"])]
    http, payload = _head(block)
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response":
        if payload_digest(payload) != digest or len(payload) != int(http["content-length"]):
            raise ValueError(f"the payload of {headers.get('warc-record-id')} does not have its digest or length")
    return {
        "page_id": _page(headers.get("warc-record-id")), "url": headers.get("warc-target-uri"),
        "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": headers["warc-type"],
        "refers_to": _page(headers.get("warc-refers-to")), "html": payload.decode() if with_html and headers["warc-type"] == "response" else None,
    }


_INDEX = "page_id long, url string, payload_digest string, record_type string, archive string, offset long, length long"


def write_archives(pages: DataFrame, folder: str, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives in ``folder`` and their index, a row for each page.

    Of pages with equal ``html`` the one with the least ``page_id`` is written as a response, the others as revisits.

    - A null ``html`` is an empty payload. A null ``url`` leaves the header out; control characters and spaces in one
      are percent-encoded.
    - Rows that repeat the least ``page_id`` of a payload are all responses. A null ``page_id`` is
      a revisit if the payload has any id, else a response without a record id.
    - Other columns are not looked at. An empty table gives an empty index and no archive.
    """
    made(folder)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("text"))
    plain = plain.withColumn("sum", F.unhex(F.sha1(F.col("text").cast("binary"))))
    first = plain.groupBy("sum").agg(F.min("page_id").alias("first"))
    typed = plain.join(first, "sum")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    typed = typed.select("page_id", "url", "text", "sum", refers.alias("refers_to"))
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ])

    def run(batches):
        files, path = opened(folder)
        out, name, number, size, notes = None, "", 0, 0, []

        def listed():
            return pa.RecordBatch.from_pylist(notes, schema=schema)

        for batch in slices(batches):
            for row in batch.to_pylist():
                if out is None:
                    name = own_name(TaskContext.get().partitionId(), number, ".warc.gz")
                    out, size, notes = files.open_output_stream(f"{path}/{name}", compression=None), 0, []
                    size += out.write(_info(date))
                    number += 1
                digest = base64.b32encode(row["sum"]).decode()
                member = record(row["page_id"], row["url"], row["text"].encode(), digest, row["refers_to"], date)
                out.write(member)
                notes.append({
                    "page_id": row["page_id"], "url": row["url"], "payload_digest": digest,
                    "record_type": "response" if row["refers_to"] is None else "revisit",
                    "archive": name, "offset": size, "length": len(member),
                })
                size += len(member)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield listed()
        if out is not None:
            out.close()
            yield listed()

    return written(typed.mapInArrow(run, _INDEX), "warc-index")


def _ranges(rows, most: int, gap: int):
    """Runs of index rows, sorted by archive and offset, that one read covers."""
    run: list[tuple[str, int, int]] = []
    for archive, offset, length in rows:
        if run and (archive != run[0][0] or offset > run[-1][1] + run[-1][2] + gap or offset + length - run[0][1] > most):
            yield run
            run = []
        run.append((archive, offset, length))
    if run:
        yield run


def read_records(index: DataFrame, folder: str, with_html: bool = False, most: int = RANGE_BYTES, gap: int = GAP_BYTES) -> DataFrame:
    """The records that ``index`` rows name, from the archives alone; a revisit has no ``html`` of its own.

    There are as many readers as archives at least, and one for every ``most`` bytes of records. A reader holds a range of
    compressed records and ``READ_TEXT`` of what is in them; a record with a very long payload takes memory in proportion to it.
    """
    fields = [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()),
    ] + [("html", pa.string())] * with_html
    schema = pa.schema(fields)

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True)

    def run(batches):
        files, path = opened(folder)
        current, source = None, None
        for part in _ranges(rows(batches), most, gap):
            archive, start, _ = part[0]
            if archive != current:
                if source is not None:
                    source.close()
                current, source = archive, files.open_input_file(f"{path}/{archive}")
            data = source.read_at(part[-1][1] + part[-1][2] - start, start)
            found, held = [], 0
            for _, offset, length in part:
                page = parsed(data[offset - start : offset - start + length], with_html)
                found.append({k: page[k] for k in schema.names})
                held += len(page["html"] or "") + 256
                if held >= READ_TEXT:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)
                    found, held = [], 0
            yield pa.RecordBatch.from_pylist(found, schema=schema)
        if source is not None:
            source.close()

    wanted = index.select("archive", "offset", "length")
    work = wanted.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.countDistinct("archive").alias("archives")).first()
    # Counted from what is to be read: the rows that name it are few bytes, and would be put together in one task.
    readers = max(1, work["archives"], -(-work["bytes"] // most))
    wanted = wanted.repartitionByRange(readers, "archive", "offset").sortWithinPartitions("archive", "offset")
    shape = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return wanted.mapInArrow(run, shape + ", html string" * with_html)


def archive_pages(pages: DataFrame) -> DataFrame:
    """The pages written to archives in the shared folder and read back from them, all records."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder), folder)
