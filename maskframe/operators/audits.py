"""Constraint and scrub-quality checks.

A database enforces these when constraints are rebuilt after a load. Here each
is a frame of violations. Whatever groups by a user's key counts per key before
it shuffles or joins, so a key that holds a large share of the rows travels as
one row per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import source_column
from ..plans.config import FK_NOT_VALID, FK_VALIDATE
from ..plans.specs import ForeignKey, TableSpec
from .reports import ERROR, WARN, one_row_to_rows, report_row, union_all

SHORT_TEXT = 64


def _measures(spec: TableSpec) -> list[tuple[str, str, Column]]:
    out = []
    for c in spec.columns:
        if c.not_null:
            out.append(("not_null", c.name, F.count_if(source_column(c.name).isNull())))
    for c in spec.columns:
        if c.max_len is not None:
            too_long = F.char_length(source_column(c.name)) > c.max_len
            out.append(("max_len", c.name, F.count_if(too_long)))
    for name in sorted(spec.checks):
        # A check passes on NULL: only a definite false violates it.
        out.append(("check", name, F.count_if(~F.expr(spec.checks[name]))))
    return out


def row_measures(spec: TableSpec) -> dict[str, Column]:
    """The per-row checks as aggregates to observe in a pass that is made anyway."""
    return {f"m{i}": value for i, (_, _, value) in enumerate(_measures(spec))}


def audit_columns(
    df: DataFrame, spec: TableSpec, kinds: Iterable[str] = ("not_null", "max_len", "check")
) -> DataFrame | None:
    """All per-row checks of a table in one scan, one row per check."""
    wanted = [m for m in _measures(spec) if m[0] in set(kinds)]
    if not wanted:
        return None
    counted = df.agg(*[value.alias(f"m{i}") for i, (_, _, value) in enumerate(wanted)])
    return one_row_to_rows(
        counted,
        [report_row(spec.qualified, k, s, F.col(f"m{i}")) for i, (k, s, _) in enumerate(wanted)],
    )


def audit_not_null(df: DataFrame, spec: TableSpec) -> DataFrame | None:
    return audit_columns(df, spec, ["not_null"])


def audit_max_len(df: DataFrame, spec: TableSpec) -> DataFrame | None:
    return audit_columns(df, spec, ["max_len"])


def audit_check(df: DataFrame, spec: TableSpec) -> DataFrame | None:
    return audit_columns(df, spec, ["check"])


def _counted_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each key value without a NULL, and its rows; a column's name may hold any character."""
    whole = df
    for c in key:
        whole = whole.filter(source_column(c).isNotNull())
    return whole.groupBy(*[source_column(c).alias(c) for c in key]).agg(F.count(F.lit(1)).alias("rows"))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with how many. NULLs never collide."""
    return _counted_keys(df, key).filter(F.col("rows") > 1)


def audit_unique(df: DataFrame, spec: TableSpec) -> DataFrame | None:
    """Per declared key: how many key values are not unique."""
    frames = [
        one_row_to_rows(
            duplicate_keys(df, key).agg(F.count(F.lit(1)).alias("n")),
            [report_row(spec.qualified, "unique", ",".join(key), F.col("n"))],
        )
        for key in spec.unique
    ]
    return union_all(frames) if frames else None


def fk_orphans(
    child: DataFrame, parent: DataFrame, fk: ForeignKey, parent_unique: bool = False
) -> DataFrame:
    """Child key values with no parent, and how many child rows hold each.

    Both sides are reduced to distinct keys before they meet. A caller that knows
    the parent key is unique saves the parent that step.
    """
    places = [f"k{i}" for i in range(len(fk.columns))]
    child_keys = _counted_keys(child, fk.columns).select(
        *[source_column(c).alias(k) for c, k in zip(fk.columns, places, strict=True)], "rows"
    )
    parent_keys = parent.select(*[source_column(p).alias(k) for p, k in zip(fk.parent_columns, places, strict=True)])
    if not parent_unique:
        parent_keys = parent_keys.distinct()
    return child_keys.join(parent_keys, places, "left_anti").select(
        *[F.col(k).alias(c) for c, k in zip(fk.columns, places, strict=True)], "rows"
    )


def audit_fk(
    spec: TableSpec, frames: Mapping[str, DataFrame], fk_mode: str = FK_VALIDATE
) -> DataFrame | None:
    """Orphaned rows per foreign key; ``not_valid`` reports them without refusing the load."""
    severity = WARN if fk_mode == FK_NOT_VALID else ERROR
    out = []
    for fk in spec.foreign_keys:
        orphans = fk_orphans(frames[spec.qualified], frames[fk.parent], fk)
        out.append(
            one_row_to_rows(
                orphans.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")),
                [
                    report_row(
                        spec.qualified, "foreign_key",
                        f"{','.join(fk.columns)}->{fk.parent}", F.col("n"), severity,
                    )
                ],
            )
        )
    return union_all(out) if out else None


def value_key(value: Column) -> Column:
    """Equal exactly when the texts are: short texts as they are, long ones by their SHA-256.

    A short text cannot look like a digest here, because a marked digest is longer.
    """
    text = value.cast("string")
    digest = F.concat(F.lit("sha256:"), F.sha2(text, 256))
    return F.when(F.octet_length(text) <= SHORT_TEXT, text).otherwise(digest)


def column_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every distinct value of several columns in one pass: (column, value, rows)."""
    pairs = [
        F.struct(F.lit(c).alias("column"), value_key(source_column(c)).alias("value"))
        for c in columns
    ]
    return (
        df.select(F.inline(F.array(*pairs)))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    )


def audit_leak(
    raw: DataFrame, scrubbed: DataFrame, columns: Sequence[str], table: str
) -> DataFrame:
    """Rows of a scrubbed column that still are a value the raw column has anywhere.

    Whole values of one column only; ``leaks.audit_leak_anywhere`` looks into all text of all tables.
    """
    seen = column_values(raw, columns).select("column", "value", F.lit(True).alias("leaked"))
    per_column = (
        column_values(scrubbed, columns)
        .join(seen, ["column", "value"], "left")
        .groupBy("column")
        .agg(F.sum(F.when(F.col("leaked"), F.col("rows")).otherwise(0)).alias("n"))
    )
    return _per_column_report(per_column, columns, table, "leak")


def audit_distinct_preserved(
    raw: DataFrame, scrubbed: DataFrame, columns: Sequence[str], table: str
) -> DataFrame:
    """How many distinct values scrubbing lost, per column."""

    def counts(df: DataFrame, sign: int) -> DataFrame:
        found = column_values(df, columns).groupBy("column")
        return found.agg((F.count(F.lit(1)) * sign).alias("n"))

    lost = counts(raw, 1).unionByName(counts(scrubbed, -1))
    per_column = lost.groupBy("column").agg(F.sum("n").alias("n"))
    return _per_column_report(per_column, columns, table, "distinct_preserved")


def _per_column_report(
    counted: DataFrame, columns: Sequence[str], table: str, check: str
) -> DataFrame:
    """A column without a single value has no group; it is reported as 0 all the same."""
    zero = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(0).cast("bigint").alias("n")) for c in columns])
    spark = counted.sparkSession
    all_columns = spark.range(0, 1, 1, 1).select(F.inline(zero))
    return (
        counted.select("column", F.col("n").cast("bigint").alias("n"))
        .unionByName(all_columns)
        .groupBy("column").agg(F.sum("n").alias("n"))
        .select(
            F.lit(table).alias("table"), F.lit(check).alias("check"),
            F.col("column").alias("subject"), F.col("n").alias("violations"),
            F.lit(ERROR).alias("severity"),
        )
    )


def audit_completeness(
    source: DataFrame, table: str, where: str = "", exported: DataFrame | None = None,
    recorded: DataFrame | None = None,
) -> DataFrame:
    """Source rows must equal kept plus removed, and what was exported must equal kept.

    All three counts of the source come from one read, so a read that is short as a whole fits them.
    ``recorded`` is a count from elsewhere, the sum of its ``rows``: of the pinned files, or of a manifest.
    """
    keep = F.expr(where) if where else F.lit(True)
    counted = source.agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(keep).alias("kept"),
        F.count_if(~F.coalesce(keep, F.lit(False))).alias("removed"),
    )
    if exported is None:
        counted = counted.withColumn("exported", F.col("kept"))
    else:
        written = exported.agg(F.count(F.lit(1)).alias("exported"))
        counted = counted.unionByName(written, allowMissingColumns=True)
    known = counted.sparkSession.createDataFrame([], "recorded bigint") if recorded is None else recorded.agg(
        F.sum("rows").cast("bigint").alias("recorded")
    )
    counted = counted.unionByName(known, allowMissingColumns=True).agg(
        *[F.sum(c).alias(c) for c in ("recorded", "source_rows", "kept", "removed", "exported")]
    )
    return counted.select(
        F.lit(table).alias("table"), "recorded", "source_rows", "kept", "removed", "exported",
        (
            (F.coalesce("recorded", "source_rows") == F.col("source_rows"))
            & (F.col("source_rows") == F.col("kept") + F.col("removed"))
            & (F.col("exported") == F.col("kept"))
        ).alias("complete"),
    )


def table_reports(
    spec: TableSpec, frames: Mapping[str, DataFrame], fk_mode: str = FK_VALIDATE, rows_checked: bool = False
) -> list[DataFrame]:
    """Every declared constraint of one table, as independent reports; ``rows_checked`` leaves the per-row ones out."""
    df = frames[spec.qualified]
    found = [None if rows_checked else audit_columns(df, spec), audit_unique(df, spec), audit_fk(spec, frames, fk_mode)]
    return [f for f in found if f is not None]


def audit_table(
    spec: TableSpec, frames: Mapping[str, DataFrame], fk_mode: str = FK_VALIDATE
) -> DataFrame | None:
    """The same as one report."""
    found = table_reports(spec, frames, fk_mode)
    return union_all(found) if found else None
