from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from maskframe import ForeignKey, TableSpec
from maskframe.operators import audits
from maskframe.operators.profile import table_profile
from maskframe.queries.base import QUERIES, TABLES, open_tables


@pytest.fixture
def skewed(spark):
    """A third of all rows on one key, some keys NULL."""
    key = F.expr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id END")
    return spark.range(6000).select(key.alias("k"), F.col("id").alias("v"))


def test_unique_ignores_nulls(skewed):
    found = rows(audits.duplicate_keys(skewed, ["k"]))
    want = Counter(r["k"] for r in skewed.collect() if r["k"] is not None)
    assert found == sorted(((k, n) for k, n in want.items() if n > 1), key=repr)
    spec = TableSpec.from_df("public.t", skewed, unique=[["k"], ["v"]])
    assert rows(audits.audit_unique(skewed, spec)) == [
        ("public.t", "unique", "k", len(found), "error"), ("public.t", "unique", "v", 0, "error"),
    ]


def test_foreign_key_orphans(spark, skewed):
    parent = spark.range(100, 5000).select(F.col("id").alias("p")).union(spark.range(100, 200))
    fk = ForeignKey(("k",), "public.p", ("p",))
    want = Counter(r["k"] for r in skewed.collect() if r["k"] is not None and not 100 <= r["k"] < 5000)
    assert rows(audits.fk_orphans(skewed, parent, fk)) == sorted(want.items(), key=repr)
    spec = TableSpec.from_df("public.t", skewed, foreign_keys=[fk])
    frames = {"public.t": skewed, "public.p": parent}
    for mode, severity in (("validate", "error"), ("not_valid", "warn")):
        (row,) = audits.audit_fk(spec, frames, mode).collect()
        assert row["violations"] == sum(want.values()) and row["severity"] == severity


def test_composite_foreign_key(spark):
    child = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "c")], "x int, y string")
    parent = spark.createDataFrame([(1, "a"), (3, "c")], "px int, py string")
    fk = ForeignKey(("x", "y"), "public.p", ("px", "py"))
    assert rows(audits.fk_orphans(child, parent, fk)) == [(1, "b", 1)]


def test_row_checks_in_one_scan(spark):
    df = spark.createDataFrame([(1, "abc", 5), (None, "ab", -1), (3, None, None)], "a int, b string, c int")
    spec = TableSpec.from_df(
        "public.t", df, not_null=["a", "b"], max_len={"b": 2}, checks={"positive": "c > 0"}
    )
    report = audits.audit_columns(df, spec)
    assert rows(report.select("check", "subject", "violations")) == [
        ("check", "positive", 1), ("max_len", "b", 1), ("not_null", "a", 1), ("not_null", "b", 1),
    ]
    assert report._jdf.queryExecution().executedPlan().toString().count("Scan") <= 2
    assert audits.audit_columns(df, TableSpec.from_df("public.t", df)) is None


def test_leaks_of_short_and_long_text(spark):
    long = "x" * 5000
    raw = spark.createDataFrame([("a", long), ("b", long + "y"), (None, None)], "s string, t string")
    scrubbed = spark.createDataFrame([("b", "z"), ("zz", long + "y"), ("b", None)], "s string, t string")
    report = audits.audit_leak(raw, scrubbed, ["s", "t"], "public.t")
    assert rows(report.select("subject", "violations")) == [("s", 2), ("t", 1)]


def test_value_key_keeps_texts_apart(spark):
    import hashlib

    long = "x" * 65
    texts = [long, long + "x", "sha256:" + hashlib.sha256(long.encode()).hexdigest(), "x" * 64, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.select(audits.value_key(F.col("t")).alias("k")).distinct().count() == len(texts)


def test_distinct_preserved(spark):
    raw = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "s string")
    cut = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "s string")
    assert audits.audit_distinct_preserved(raw, cut, ["s"], "public.t").first()["violations"] == 1
    assert audits.audit_distinct_preserved(raw, raw, ["s"], "public.t").first()["violations"] == 0


def test_completeness_counts_unknown_as_removed(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "a int")
    row = audits.audit_completeness(df, "public.t", "a > 2").first()
    assert tuple(row) == ("public.t", None, 3, 1, 2, 1, True)
    short = audits.audit_completeness(df, "public.t", "a > 2", exported=df.limit(0)).first()
    assert not short["complete"] and short["exported"] == 0
    for rows_there, complete in ((3, True), (6, False)):
        recorded = spark.createDataFrame([(rows_there,)], "rows bigint")
        row = audits.audit_completeness(df, "public.t", "a > 2", recorded=recorded).first()
        assert (row["recorded"], row["complete"]) == (rows_there, complete)


def test_profile(spark):
    df = spark.createDataFrame([(1, "b", [1]), (2, None, [2]), (2, "a", None)], "a int, b string, c array<int>")
    got = {r["column"]: r for r in table_profile(df, "public.t").collect()}
    assert (got["a"]["min_value"], got["a"]["max_value"], got["a"]["approx_distinct"]) == ("1", "2", 2)
    assert (got["b"]["nulls"], got["b"]["min_value"], got["b"]["max_value"]) == (1, "a", "b")
    assert got["c"]["nulls"] == 1 and got["c"]["min_value"] is None


def test_distinct_counts_cover_all_columns_of_all_tables(spark):
    import maskframe.queries  # noqa: F401

    frames = open_tables(spark, "/root/testdata/sf0.001")
    expected = {(t, c) for t, df in frames.items() for c in df.columns}
    got = QUERIES["table_profile_distinct_all"](spark, "/root/testdata/sf0.001").collect()
    assert {(r["table"], r["column"]) for r in got} == expected and len(got) == len(expected) and len(frames) == len(TABLES)
    assert all(r["near"] for r in got)
