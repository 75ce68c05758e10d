"""Loading a snapshot: by name, generated columns last, counts reconciled."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digests import content_measures
from ..functions.transforms import source_column
from ..plans.specs import TableSpec
from ..sources.copyfiles import read_copytext
from ..sources.manifests import Manifest, TableEntry
from ..sources.snapshot import COPYTEXT, PARQUET
from .reports import one_row_to_rows, report_row, union_all

Migration = Callable[[DataFrame], DataFrame]


def read_entry(spark: SparkSession, entry: TableEntry, spec: TableSpec) -> DataFrame:
    """The stored columns of one table as the manifest lists them; a skipped table is empty."""
    if entry.skipped or not entry.file:
        return spark.createDataFrame([], spec.struct(spec.stored))
    if entry.format == COPYTEXT:
        known = {c.name: c.data_type for c in spec.columns}
        schema = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in entry.columns])
        return read_copytext(spark, entry.file, schema)
    return spark.read.parquet(entry.file).select(*[source_column(c) for c in entry.columns])


def align(df: DataFrame, target: TableSpec) -> DataFrame:
    """Columns in the target's order and types, matched by name.

    A target column the snapshot does not have takes its default, or NULL. A
    snapshot column the target does not have is an error: it would be lost.
    """
    extra = [c for c in df.columns if target.column(c) is None]
    if extra:
        raise ValueError(f"{target.qualified}: no place for {', '.join(sorted(extra))}")
    out = []
    for c in target.stored:
        if c.name in df.columns:
            value = source_column(c.name)
        else:
            value = F.lit(None) if c.default is None else F.expr(c.default)
        out.append(value.cast(c.data_type).alias(c.name))
    return df.select(*out)


def recompute_generated(df: DataFrame, target: TableSpec) -> DataFrame:
    """Generated columns from the loaded values, so one made from scrubbed columns is scrubbed."""
    unknown = [c.name for c in target.columns if c.generated == ""]
    if unknown:
        raise ValueError(f"{target.qualified}: no expression for generated {', '.join(unknown)}")
    made = [
        F.expr(c.generated).cast(c.data_type).alias(c.name)
        if c.generated is not None else source_column(c.name)
        for c in target.columns
    ]
    return df.select(*made)


def load(
    spark: SparkSession,
    manifest: Manifest,
    targets: Sequence[TableSpec],
    migrations: Mapping[str, Migration] | None = None,
    observed: dict[str, Observation] | None = None,
) -> dict[str, DataFrame]:
    """Every table of a snapshot, aligned to its target, migrated and completed.

    Lazy: the rows move when the frames are written or audited. ``observed`` takes
    an observation per Parquet table: the content digest of the rows as they are
    read, which is there once the frame has been written.
    """
    migrations = migrations or {}
    by_name = {t.qualified: t for t in targets}
    missing = [e.qualified for e in manifest.tables if e.qualified not in by_name]
    if missing:
        raise ValueError(f"no target for: {', '.join(missing)}")
    out = {}
    for entry in manifest.tables:
        target = by_name[entry.qualified]
        stored = read_entry(spark, entry, target)
        if observed is not None and entry.format == PARQUET:
            observed[entry.qualified] = Observation()
            measures = content_measures(stored.schema)
            stored = stored.observe(
                observed[entry.qualified], *[c.alias(n) for n, c in measures.items()]
            )
        df = recompute_generated(align(stored, target), target)
        migrate = migrations.get(entry.qualified)
        out[entry.qualified] = df if migrate is None else df.transform(migrate)
    return out


def row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows), one row per table, as one job."""
    return union_all(
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in frames.items()
    )


def leaf_counts(parent: DataFrame, leaf: str, table: str) -> DataFrame:
    """(table, rows) of every leaf of a partitioned table, named by its value of ``leaf``, and of the whole.

    One read and one aggregate for any number of leaves.
    """
    name = F.when(F.grouping(leaf) == 1, table).otherwise(F.concat(F.lit(f"{table}_"), F.coalesce(leaf, F.lit("default"))))
    return parent.rollup(leaf).agg(name.alias("table"), F.count(F.lit(1)).alias("rows")).select("table", "rows")


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows per table that were recorded and that were loaded; both frames are (table, rows)."""
    joined = expected.withColumnRenamed("rows", "expected").join(
        actual.withColumnRenamed("rows", "actual"), "table", "full_outer"
    )
    return joined.select(
        "table", "expected", "actual", F.col("expected").eqNullSafe(F.col("actual")).alias("ok")
    )


def reconcile_report(reconciled: DataFrame) -> DataFrame:
    """The same as an audit report, so that a truncated load refuses to publish."""
    off = F.abs(F.coalesce("expected", F.lit(0)) - F.coalesce("actual", F.lit(0)))
    return reconciled.select(
        "table", F.lit("row_count").alias("check"), F.lit("rows").alias("subject"),
        F.when(F.col("ok"), 0).otherwise(F.greatest(off, F.lit(1))).cast("bigint").alias("violations"),
        F.lit("error").alias("severity"),
    )


def count_report(df: DataFrame, table: str, expected: int) -> DataFrame:
    """The reconciliation of one table whose recorded count is at hand: an aggregate, no join."""
    off = F.abs(F.count(F.lit(1)) - F.lit(expected)).alias("off")
    return one_row_to_rows(df.agg(off), [report_row(table, "row_count", "rows", F.col("off"))])
