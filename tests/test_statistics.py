import math

from conftest import rows
from pyspark.sql import functions as F

from maskframe.operators.reports import union_all
from maskframe.operators.statistics import RANK_ERROR, column_sketches, merge_sketches, statistics


def figures(df, **options):
    return {r["column"]: r for r in statistics(df, **options).collect()}


def test_parts_add_up_to_the_whole(spark, tmp_path):
    """Sketches of uneven parts, one of them empty, written and merged."""
    n = 20_000
    df = spark.range(n).select(
        "id", ((F.col("id") * 7919) % n).cast("double").alias("spread"), (F.col("id") % 7).cast("string").alias("few"),
        F.when(F.col("id") % 3 == 0, F.lit("x" * 300)).when(F.col("id") % 3 == 1, "short").alias("wide"),
        F.timestamp_micros(F.col("id") * 1000).alias("at"), F.array("id").alias("ids"),
    )
    parts = [df.filter("id < 13"), df.filter("id >= 13 AND id < 15000"), df.filter("id >= 15000"), df.filter("id < 0")]
    for i, part in enumerate(parts):
        column_sketches(part, "public.t").write.parquet(f"{tmp_path}/{i}")
    merged = union_all(spark.read.parquet(f"{tmp_path}/{i}") for i in range(len(parts)))
    found = figures(merge_sketches(merged))
    assert all(r["rows"] == n for r in found.values()) and len(found) == 6
    for name, top in (("id", n - 1), ("spread", n - 1), ("at", (n - 1) * 1000)):
        bounds = found[name]["histogram"]
        assert bounds[0] == 0 and bounds[-1] == top
        assert all(abs(b / top - i / 10) <= 2 * RANK_ERROR for i, b in enumerate(bounds))
    assert abs(found["id"]["approx_distinct"] - n) < 0.03 * n
    assert [(c["value"], c["count"]) for c in found["few"]["common"]] == [
        (str(v), math.ceil((n - v) / 7)) for v in range(7)
    ]
    assert found["few"]["approx_distinct"] == 7 and found["few"]["histogram"] is None
    assert [(c["value"], c["count"]) for c in found["wide"]["common"]] == [("short", 6667)]
    assert found["wide"]["nulls"] == 6666
    assert found["ids"]["approx_distinct"] is None and found["ids"]["common"] == []


def test_nothing_nulls_and_not_a_number(spark):
    nothing = spark.createDataFrame([], "a int, b string, `c.d` double")
    found = figures(column_sketches(nothing, "t"))
    assert {c: (r["rows"], r["approx_distinct"], r["histogram"], r["common"]) for c, r in found.items()} == {
        c: (0, 0, None, []) for c in ("a", "b", "c.d")
    }
    odd = spark.createDataFrame([(None, math.nan), (None, 2.0), (None, None)], "a int, b double")
    found = figures(merge_sketches(column_sketches(odd, "t").union(column_sketches(odd, "t"))), bounds=3)
    assert found["a"]["nulls"] == 6 and found["a"]["histogram"] is None and found["a"]["common"] == []
    assert found["b"]["histogram"] == [2.0, 2.0, 2.0] and found["b"]["nulls"] == 2
    assert [(c["value"], c["count"]) for c in found["b"]["common"]] == [("2.0", 2), ("NaN", 2)]
    assert len(rows(odd)) == 3
