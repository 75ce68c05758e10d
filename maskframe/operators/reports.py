"""One shape for every check, so that checks of all kinds can be unioned and gated on."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT_COLUMNS = ["table", "check", "subject", "violations", "severity"]

ERROR = "error"
WARN = "warn"


def one_row_to_rows(aggregated: DataFrame, rows: Iterable[dict[str, Column]]) -> DataFrame:
    """Turn the single row of a whole-table aggregate into one row per measured thing."""
    structs = [F.struct(*[v.alias(k) for k, v in row.items()]) for row in rows]
    return aggregated.select(F.inline(F.array(*structs)))


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def report_row(
    table: str, check: str, subject: str, violations: Column, severity: str = ERROR
) -> dict[str, Column]:
    return {
        "table": F.lit(table),
        "check": F.lit(check),
        "subject": F.lit(subject),
        "violations": violations.cast("bigint"),
        "severity": F.lit(severity),
    }
