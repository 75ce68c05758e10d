import base64
import gzip
import hashlib
import os

from maskframe.llm import warc

SCHEMA = "page_id long, url string, html string"


def rows():
    same = "<p>same</p>"
    return [
        (3, "http://a/3", same), (1, "http://a/1", same), (2, "http://a/ 2\r\nX: y", same), (4, None, None), (5, "u", ""), (6, "ü", "tschüß\r\n\r\nb"),
        (None, "n", "no id"), (None, "n", same), (7, "long", "x\n" * 200_000), (8, "r", "twice"), (8, "r", "twice"),
    ]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip_and_index(spark, folder):
    pages = spark.createDataFrame(rows(), SCHEMA).withColumnRenamed("url", "url")
    index = warc.write_archives(pages, folder + "/all", archive_bytes=2000)
    got = sorted((r.asDict() for r in warc.read_records(index, folder + "/all", with_html=True).collect()), key=str)
    assert len(got) == len(rows())
    first = {}
    for i, _, html in rows():
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in rows():
        low = first.get(html or "")
        other = low is not None and i != low
        want.append((i, len((html or "").encode()), digest(html), "revisit" if other else "response", low if other else None, None if other else html or ""))
    assert sorted(want, key=str) == sorted(
        ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["html"]) for r in got), key=str
    )
    noted = {(r["page_id"], r["payload_digest"], r["record_type"]) for r in index.collect()}
    assert noted == {(r["page_id"], r["payload_digest"], r["record_type"]) for r in got}


def test_chosen_records_are_read_by_range(spark, folder):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"page {i}") for i in range(300)], SCHEMA)
    index = warc.write_archives(pages, folder + "/some")
    got = warc.read_records(index.where("page_id % 7 = 0"), folder + "/some", with_html=True, gap=10)
    assert {(r["page_id"], r["html"]) for r in got.collect()} == {(i, f"page {i}") for i in range(0, 300, 7)}


def test_neighbours_share_a_read():
    near = [("a", 0, 10), ("a", 10, 10), ("a", 25, 10), ("a", 500, 10), ("b", 510, 10), ("b", 520, 10_000)]
    assert [len(run) for run in warc._ranges(near, most=5000, gap=5)] == [3, 1, 1, 1]


def test_archives_are_gzip_members_with_standard_heads(spark, folder):
    warc.write_archives(spark.createDataFrame(rows(), SCHEMA), folder + "/heads")
    names = [n for n in os.listdir(folder + "/heads") if n.endswith(".warc.gz")]
    text = b"".join(gzip.open(f"{folder}/heads/{n}").read() for n in names)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert text.count(b"WARC-Type: response") == 7 and text.count(b"WARC-Type: revisit") == 4
    assert b"\r\nX: y\r\n" not in text  # an address cannot add a header


def test_empty_table_and_other_columns(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    assert warc.archive_pages(none).count() == 0
    more = spark.createDataFrame([(1, "u", "h", "x", "y")], SCHEMA + ", digest string, offset string")
    assert warc.archive_pages(more).count() == 1


def test_a_reader_for_every_archive_and_range(spark, folder):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"page {i} " * 50) for i in range(200)], SCHEMA).repartition(5)
    index = warc.write_archives(pages, folder + "/wide")
    archives = index.select("archive").distinct().count()
    read = warc.read_records(index, folder + "/wide")
    assert read.rdd.getNumPartitions() >= archives >= 1
    small = warc.read_records(index, folder + "/wide", most=4096)
    assert small.rdd.getNumPartitions() >= index.agg({"length": "sum"}).first()[0] // 4096 > archives
    assert small.count() == 200
