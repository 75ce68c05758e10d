"""Column statistics that can be merged: distinct values, quantiles and most common values as sketches.

Sketches of parts, days or versions of a table add up to those of the whole, so a new part
costs a pass over itself and not over what came before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.transforms import source_column
from .reports import one_row_to_rows

# A rank read from a quantile sketch is off by less than RANK_ERROR of the rows, in 99 of 100 cases.
QUANTILE_SIZE, RANK_ERROR = 800, 0.005
# Counts of values are exact while a column has no more than three quarters of so many values.
TRACKED = 4096
LONGEST_COMMON = 256  # longer values are no candidates for the most common ones
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _number(name: str, kind: T.DataType):
    """A column as a double in the same order; None for what has no distances."""
    col = source_column(name)
    if isinstance(kind, T.NumericType):
        return col.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(kind, _TIMES):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    return None


def column_sketches(df: DataFrame, table: str) -> DataFrame:
    """Per column: rows, nulls and the sketches ``distinct``, ``quantiles`` and ``common``, in one pass.

    Every task holds one sketch of each kind and column, so memory and shuffle follow the columns, not the rows.
    Quantiles are of numbers, dates (days) and timestamps (microseconds); NaN counts as no value.
    Columns of arrays, maps and structs have counts only. An empty table gives sketches of nothing.
    """
    measures, rows = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(df.schema.fields):
        col = source_column(f.name)
        measures.append(F.count_if(col.isNull()).alias(f"nulls{i}"))
        row = {
            "table": F.lit(table), "column": F.lit(f.name), "rows": F.col("n"), "nulls": F.col(f"nulls{i}"),
            "distinct": F.lit(None).cast("binary"), "quantiles": F.lit(None).cast("binary"),
        }
        simple = isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)
        text = col.cast("string") if simple else F.lit(None).cast("string")
        if simple:
            measures.append(F.hll_sketch_agg(F.xxhash64(text), F.lit(14)).alias(f"distinct{i}"))
            row["distinct"] = F.col(f"distinct{i}")
            number = _number(f.name, f.dataType)
            if number is not None:
                held = F.when(~F.isnan(number), number)
                measures.append(F.kll_sketch_agg_double(held, F.lit(QUANTILE_SIZE)).alias(f"quantiles{i}"))
                row["quantiles"] = F.col(f"quantiles{i}")
        # An absent value enters as one of its own and is taken out again when the sketch is read.
        short = F.when(F.length(text) <= LONGEST_COMMON, text)
        measures.append(F.call_function("approx_top_k_accumulate", short, F.lit(TRACKED)).alias(f"common{i}"))
        rows.append({**row, "common": F.col(f"common{i}")})
    return one_row_to_rows(df.agg(*measures), rows)


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One row per (table, column): what the sketches of all parts say together."""
    return sketches.groupBy("table", "column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        F.when(F.count("distinct") > 0, F.hll_union_agg("distinct")).alias("distinct"),
        F.when(F.count("quantiles") > 0, F.kll_merge_agg_double("quantiles", F.lit(QUANTILE_SIZE))).alias("quantiles"),
        F.call_function("approx_top_k_combine", F.col("common"), F.lit(TRACKED)).alias("common"),
    )


def statistics(sketches: DataFrame, bounds: int = 11, most: int = 10) -> DataFrame:
    """Sketches as figures: approximate distinct values, bounds of equally filled bins, most common values with counts.

    ``histogram`` has ``bounds`` values from the smallest to the largest. ``common`` is ordered by falling count, then value.
    """
    ranks = F.array(*[F.lit(i / (bounds - 1)) for i in range(bounds)])
    counted = F.call_function("approx_top_k_estimate", F.col("common"), F.lit(most + 1))
    values = F.filter(counted, lambda c: c["item"].isNotNull())
    order = F.transform(values, lambda c: F.struct((-c["count"]).alias("n"), c["item"].alias("value")))
    common = F.transform(F.slice(F.array_sort(order), 1, most), lambda c: F.struct(c["value"].alias("value"), (-c["n"]).alias("count")))
    filled = F.coalesce(F.kll_sketch_get_n_double("quantiles"), F.lit(0)) > 0
    return sketches.select(
        "table", "column", "rows", "nulls", F.hll_sketch_estimate("distinct").alias("approx_distinct"),
        F.when(filled, F.kll_sketch_get_quantile_double(F.when(filled, F.col("quantiles")), ranks)).alias("histogram"),
        common.alias("common"),
    )
