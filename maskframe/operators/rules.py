"""Rules that no longer apply to anything, found for a whole fleet at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale_rules(rules: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Rules that would silently not apply, each with the reason.

    ``rules``: (database, table, column); column NULL for a rule on the whole table.
    ``tables``: (database, table, kind). ``columns``: (database, table, column, generated).
    """
    # A table has 1,600 columns at most, so neither key needs more than adaptive execution.
    keyed = rules.join(tables.select("database", "table", "kind"), ["database", "table"], "left")
    known = columns.select("database", "table", "column", "generated")
    checked = keyed.join(known, ["database", "table", "column"], "left")
    reason = (
        F.when(F.col("kind").isNull(), "no such table")
        .when(F.col("kind") == "p", "partitioned parent")
        .when(F.col("column").isNotNull() & F.col("generated").isNull(), "no such column")
        .when(F.col("generated"), "generated column")
    )
    return (
        checked.withColumn("reason", reason).filter(F.col("reason").isNotNull())
        .select("database", "table", "column", "reason")
    )
