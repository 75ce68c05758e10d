"""Column statistics from sketches of a table's parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import one_row_to_rows, union_all
from ..operators.statistics import RANK_ERROR, column_sketches, merge_sketches, statistics
from ..workspace import kept
from .base import query, table

_MEASURED = ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
_LISTED = ("l_returnflag", "l_linestatus", "l_quantity", "l_discount")


def _merged(df: DataFrame, part: str, values: list[str]) -> DataFrame:
    """Every part sketched by itself, as if it had come later than the one before."""
    parts = [df.filter(F.col(part) == v) for v in values] + [df.filter(~F.col(part).isin(values) | F.col(part).isNull())]
    stored = [kept(column_sketches(p, "public.lineitem"), "sketches") for p in parts]
    return kept(statistics(merge_sketches(union_all(stored))), "statistics")


_TOP = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem
        WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, value LIMIT 10)"""
    for c in _LISTED
)


@query(f'SELECT "column", value, n FROM ({_TOP})')
def statistics_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most common values of some columns, from merged sketches of four parts; exact, as there are few values."""
    df = table(spark, sf_dir, "lineitem").select(*_LISTED)
    found = _merged(df, "l_returnflag", ["A", "N", "R"])
    return found.select("column", F.inline("common")).withColumnRenamed("count", "n")


_COUNTED = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS nulls, true AS distinct_near,
        true AS histogram_near FROM lineitem"""
    for c in _MEASURED
)


@query(f'SELECT "column", CAST("rows" AS BIGINT) AS "rows", CAST(nulls AS BIGINT) AS nulls, distinct_near, histogram_near FROM ({_COUNTED})')
def statistics_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of ten bins and distinct values from merged sketches, held against exact ranks and counts of all rows.

    A bound is near if the rows up to it are at least its share of all and the rows below it at most that, each but
    for twice the error of one sketch.
    """
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", *_MEASURED)
    found = _merged(df, "l_returnflag", ["A", "N", "R"]).filter(F.col("column").isin(*_MEASURED))
    bounds = {r["column"]: r["histogram"] for r in found.select("column", "histogram").collect()}
    measures, out = [], []
    for c in _MEASURED:
        kind = dict(df.dtypes)[c]
        number = F.unix_micros(F.col(c).cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(c) if kind == "date" else F.col(c)
        number = number.cast("double")
        measures += [F.count(number).alias(f"n_{c}"), F.count_distinct(c).alias(f"d_{c}")]
        near = []
        for i, b in enumerate(bounds[c]):
            measures += [F.count_if(number <= b).alias(f"le{i}_{c}"), F.count_if(number < b).alias(f"lt{i}_{c}")]
            share, n = i / (len(bounds[c]) - 1), F.col(f"n_{c}")
            near += [
                F.col(f"le{i}_{c}") >= (share - 2 * RANK_ERROR) * n,
                F.col(f"lt{i}_{c}") <= (share + 2 * RANK_ERROR) * n,
            ]
        all_near = reduce(lambda a, b: a & b, near)
        out.append({"column": F.lit(c), "exact_distinct": F.col(f"d_{c}"), "histogram_near": all_near})
    exact = one_row_to_rows(df.agg(*measures), out)
    close = F.abs(F.col("approx_distinct") - F.col("exact_distinct")) <= 0.05 * F.col("exact_distinct")
    return found.join(exact, "column").select("column", "rows", "nulls", close.alias("distinct_near"), "histogram_near")
