import datetime
import decimal

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from maskframe.functions.copytext import encode_line, escape, unescape
from maskframe.sources.copyfiles import read_copytext, write_copytext

EDGES = [
    None, "", "\\N", "\\", "\\\\", "\\n", "\\\\n", "a\tb", "a\nb", "a\rb", "\b\f\v", "\\t", "\\\t", "\t\\",
    "tab\\tand\ttab", "ünïcödé 漢字 😀", "trailing\\", "\\.", "{a,b}", "\r\n", "\\\\\\N",
]


def round_trip(spark, df, tmp_path):
    path = str(tmp_path / "copy")
    write_copytext(df, path)
    return read_copytext(spark, path, df.schema)


def test_edge_values(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(EDGES)), "id int, s string")
    assert rows(round_trip(spark, df, tmp_path)) == rows(df)


def test_one_column_tables(spark, tmp_path):
    df = spark.createDataFrame([("",), (None,), ("x",)], "s string")
    assert rows(round_trip(spark, df, tmp_path)) == rows(df)


def test_written_notation(spark):
    df = spark.createDataFrame(
        [(1, None, True, bytearray(b"\x01\xff"), "a\tb\\", [1, None], ['x"y', None, "null"])],
        "a int, b string, c boolean, d binary, e string, f array<int>, g array<string>",
    )
    line = df.select(encode_line(df.schema).alias("v")).first()["v"]
    assert line == '1\t\\N\tt\t\\\\x01ff\ta\\tb\\\\\t{1,NULL}\t{"x\\\\"y",NULL,"null"}'


def test_all_types(spark, tmp_path):
    df = spark.createDataFrame(
        [
            (True, 1, 2**40, 1.5, decimal.Decimal("12.340"), datetime.date(2024, 2, 29),
             datetime.datetime(2024, 1, 1, 12, 30, 15, 250), bytearray(b"\\x\t\n"), [1.25, None, 3.0],
             ["a,b", 'q"\\{}', None, "NULL", ""], [], {"k": 1}),
            (False, -1, 0, float("inf"), None, None, None, None, None, None, None, None),
        ],
        "a boolean, b int, c bigint, d double, e decimal(10,3), f date, g timestamp, h binary, "
        "i array<double>, j array<string>, k array<int>, l map<string,int>",
    )
    got = round_trip(spark, df, tmp_path)
    assert got.dtypes == df.dtypes
    key = F.col("b") == 1
    assert [tuple(r) for r in got.filter(key).collect()] == [tuple(r) for r in df.filter(key).collect()]
    assert rows(got.drop("l")) == rows(df.drop("l"))


def test_nested_arrays_are_refused(spark):
    df = spark.createDataFrame([([[1]],)], "a array<array<int>>")
    with pytest.raises(TypeError, match="one-dimensional"):
        encode_line(df.schema)


def test_a_short_line_is_an_error(spark, tmp_path):
    path = str(tmp_path / "bad")
    spark.createDataFrame([("1\tx",), ("2",)], "value string").coalesce(1).write.text(path)
    df = read_copytext(spark, path, spark.createDataFrame([], "a int, b string").schema)
    with pytest.raises(PySparkException, match="expected 2 fields, found 1"):
        df.collect()


def test_a_backslash_before_an_ordinary_character(spark):
    df = spark.createDataFrame([("\\q\\\\z",), ("\\q\\t\\",)], "s string")
    assert [r[0] for r in df.select(unescape(F.col("s"))).collect()] == ["q\\z", "q\t"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="\\abfnrtvN\t\n\r\b\f\v x", max_size=12), min_size=1, max_size=40))
def test_escape_and_back(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    out = df.select(escape(F.col("s")).alias("e"), unescape(escape(F.col("s"))).alias("d")).collect()
    assert [r["d"] for r in out] == texts
    assert not any(set(r["e"]) & set("\t\n\r\b\f\v") for r in out)


def test_parts_are_bounded_and_compressed(spark, tmp_path):
    path = str(tmp_path / "parts")
    write_copytext(spark.range(0, 1000, 1, 1), path, rows_per_file=100)
    files = [f.name for f in (tmp_path / "parts").iterdir() if f.name.startswith("part-")]
    assert len(files) == 10 and all(f.endswith(".txt.gz") for f in files)


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    """Values with line ends, backslashes and tabs; a split may begin anywhere."""
    made = spark.range(0, 60_000, 1, 1).select(
        "id", F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit("\n\\\t\r")).alias("t"),
        F.when(F.col("id") % 5 == 0, F.lit("")).when(F.col("id") % 5 == 1, "\\N").alias("u"),
    )
    write_copytext(made, str(tmp_path / "b"), compression="bzip2")
    write_copytext(made, str(tmp_path / "g"), rows_per_file=25_000)
    assert len(list((tmp_path / "b").glob("part-*.bz2"))) == 1 and len(list((tmp_path / "g").glob("part-*.gz"))) == 3
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        back = read_copytext(spark, str(tmp_path / "b"), made.schema)
        tasks = back.groupBy(F.spark_partition_id().alias("p")).count().filter("count > 0").count()
        assert tasks >= 3
        assert back.count() == 60_000 and back.exceptAll(made).isEmpty() and made.exceptAll(back).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(ValueError, match="gzip or bzip2"):
        write_copytext(made, str(tmp_path / "z"), compression="zstd")
