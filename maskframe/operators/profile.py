"""Column statistics collected between load and publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.transforms import source_column
from .reports import one_row_to_rows

_SIZED = (T.ArrayType, T.MapType)
_UNORDERED = (T.MapType, T.VariantType)


def table_profile(df: DataFrame, table: str, distinct: bool = True) -> DataFrame:
    """Per column: rows, nulls, approximate distinct values, smallest and largest as text.

    One pass over the table whatever the number of columns.
    """
    measures, rows = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(df.schema.fields):
        col = source_column(f.name)
        measures.append(F.count_if(col.isNull()).alias(f"nulls{i}"))
        ordered = not isinstance(f.dataType, _UNORDERED)
        if ordered and not isinstance(f.dataType, _SIZED):
            # Zeros of both signs are equal, and which one an extreme returns is chance.
            value = col + F.lit(0).cast(f.dataType) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else col
            measures += [F.min(value).alias(f"min{i}"), F.max(value).alias(f"max{i}")]
            low, high = F.col(f"min{i}").cast("string"), F.col(f"max{i}").cast("string")
        else:
            low = high = F.lit(None).cast("string")
        row = {
            "table": F.lit(table),
            "column": F.lit(f.name),
            "rows": F.col("n"),
            "nulls": F.col(f"nulls{i}"),
            "min_value": low,
            "max_value": high,
        }
        if distinct:
            key = F.to_json(col) if not ordered else col
            measures.append(F.approx_count_distinct(F.xxhash64(key)).alias(f"distinct{i}"))
            row["approx_distinct"] = F.col(f"distinct{i}")
        rows.append(row)
    return one_row_to_rows(df.agg(*measures), rows)


def analyze(spark: SparkSession, table: str) -> None:
    """The optimizer's own statistics, for a table in the catalog."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
