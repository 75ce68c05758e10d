"""Questions over many snapshots and versions: latest, previous, admissible, drift, retention.

Frames are keyed by (database, ts); ``ts`` is text that sorts in the order of time.
One database may hold most of the rows, so nothing here orders a whole database
in one task: extremes are aggregates that combine partially, and the one ordered
lookup works per day first and across days second.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import (
    MIN_SERVER_MAJOR, is_backup_of, is_staging, number_timestamp, timestamp_number,
)

ARTIFACT_VERSION = 1


def latest(registry: DataFrame, by: Sequence[str] = ("database",)) -> DataFrame:
    """The newest complete snapshot of each database."""
    newest = registry.groupBy(*by).agg(F.max(timestamp_number(F.col("ts"))).alias("n"))
    return newest.select(*by, number_timestamp(F.col("n")).alias("ts"))


def _neighbours(registry: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each snapshot ``n`` with the newest one strictly before it and the oldest one after it.

    Snapshots count seconds, so a day of one database holds at most 86,400 of them,
    and the second window holds one row per day.
    """
    by = list(by)
    number = timestamp_number(F.col("ts")).alias("n")
    taken = registry.select(*by, number).distinct().withColumn("day", F.expr("n DIV 1000000"))
    # Stated here for both uses below; otherwise the join adds it to one of them only,
    # and they no longer read the same shuffle.
    for c in (*by, "n", "day"):
        taken = taken.filter(F.col(c).isNotNull())
    in_day = Window.partitionBy(*by, "day").orderBy("n")
    taken = taken.select(
        "*", F.lag("n").over(in_day).alias("before"), F.lead("n").over(in_day).alias("after")
    )
    edges = taken.filter(F.col("before").isNull() | F.col("after").isNull())
    days = edges.groupBy(*by, "day").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    across = Window.partitionBy(*by).orderBy("day")
    days = days.select(
        *by, "day",
        F.lag("last").over(across).alias("before_day"),
        F.lead("first").over(across).alias("after_day"),
    )
    return taken.join(days, [*by, "day"]).select(
        *by, "n",
        F.coalesce("before", "before_day").alias("previous"),
        F.coalesce("after", "after_day").alias("next"),
    )


def previous(registry: DataFrame, by: Sequence[str] = ("database",)) -> DataFrame:
    """Each snapshot with the newest one strictly before it; the first has NULL."""
    return _neighbours(registry, by).select(
        *by, number_timestamp(F.col("n")).alias("ts"),
        number_timestamp(F.col("previous")).alias("previous_ts"),
    )


def refusal(
    version: Column, scrubbed: Column, source_major: Column, target_major: Column
) -> Column:
    """Why a snapshot may not be loaded, the first reason that applies, or NULL when it may."""
    return (
        F.when(~version.eqNullSafe(F.lit(ARTIFACT_VERSION)), "unknown artifact version")
        .when(~F.coalesce(scrubbed, F.lit(False)), "not scrubbed")
        .when(source_major > target_major, "source is newer than target")
        .when(target_major < MIN_SERVER_MAJOR, "target is not supported")
    )


def admission(manifests: DataFrame, target_major: Column | int) -> DataFrame:
    """Manifests with ``admissible`` and ``reason``."""
    target = target_major if isinstance(target_major, Column) else F.lit(target_major)
    reason = refusal(
        F.col("artifactVersion"), F.col("scrubbed"), F.col("source.serverMajor"), target
    )
    return manifests.withColumn("reason", reason).withColumn(
        "admissible", F.col("reason").isNull()
    )


def columns_added_between(current: DataFrame, before: DataFrame) -> DataFrame:
    """Columns of one snapshot that another lacks, both as (table, column)."""
    qualified = F.concat_ws(".", "table", "column").alias("qualified_column")
    return current.select(qualified).distinct().join(
        before.select(qualified).distinct(), "qualified_column", "left_anti"
    )


def column_changes(columns: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Drift over a whole registry of (database, ts, table, column): what each snapshot changed.

    ``snapshots``: (database, ts) of all complete ones. One that has skipped all its tables has no
    columns, and only this list knows it; without the list every snapshot must have a column.
    A column of a snapshot counts as present there and as expected in the next one.
    The first snapshot of a database has nothing to compare with and is left out.
    Columns are one row each before they meet their snapshot's neighbours.
    """
    qualified = F.concat_ws(".", "table", "column").alias("qualified_column")
    keyed = columns.select("database", timestamp_number(F.col("ts")).alias("n"), qualified).distinct()
    listed = columns if snapshots is None else snapshots
    placed = keyed.join(_neighbours(listed, ["database"]), ["database", "n"])
    here = F.struct(
        F.when(F.col("previous").isNotNull(), F.col("n")).alias("n"), F.lit(True).alias("present")
    )
    following = F.struct(F.col("next").alias("n"), F.lit(False).alias("present"))
    marks = placed.select("database", "qualified_column", F.inline(F.array(here, following)))
    return (
        marks.filter(F.col("n").isNotNull())
        .groupBy("database", "n", "qualified_column")
        .agg(F.bool_or("present").alias("present"), F.bool_or(~F.col("present")).alias("expected"))
        .filter(F.col("present") != F.col("expected"))
        .select(
            "database", number_timestamp(F.col("n")).alias("ts"), "qualified_column",
            F.when(F.col("present"), "added").otherwise("removed").alias("change"),
        )
    )


def columns_added(columns: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Columns that a snapshot has and the one before it had not."""
    return column_changes(columns, snapshots).filter(F.col("change") == "added").drop("change")


def columns_removed(columns: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """The other direction of drift: columns the previous snapshot had."""
    return column_changes(columns, snapshots).filter(F.col("change") == "removed").drop("change")


def expired(versions: DataFrame, keep: int) -> DataFrame:
    """Backups to drop so that the newest ``keep`` of each target stay.

    The kept ones are a top-k per target, which Spark cuts to k rows in every task
    before it shuffles; everything else is expired.
    """
    backups = versions.filter(F.col("role") == "backup").select("target", "name").distinct()
    if keep <= 0:
        return backups
    newest = Window.partitionBy("target").orderBy(F.col("name").desc())
    kept = (
        backups.withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= keep).drop("position")
    )
    return backups.join(kept, ["target", "name"], "left_anti")


def version_roles(databases: DataFrame) -> DataFrame:
    """The role of each (target, name) by its name alone, as a catalog listing shows it."""
    target, name = F.col("target"), F.col("name")
    role = (
        F.when(name == target, "target")
        .when(is_backup_of(target, name), "backup")
        .when(is_staging(name), "staging")
    )
    return databases.withColumn("role", role).filter(F.col("role").isNotNull())


def state(versions: DataFrame) -> DataFrame:
    """Per target: the state a run would find, and what recovery would do about it.

    Derived from which versions exist and from nothing else. A target without a
    version has a row with a NULL role.
    """
    role = F.col("role")
    found = versions.groupBy("target").agg(
        F.coalesce(F.bool_or(role == "target"), F.lit(False)).alias("exists"),
        F.count_if(role == "backup").alias("backups"),
        F.count_if(role == "staging").alias("staging"),
        F.max(F.when(role == "backup", F.col("name"))).alias("newest_backup"),
    )
    name = (
        F.when(F.col("exists") & (F.col("staging") == 0), "idle")
        .when(F.col("exists"), "orphaned_staging")
        .when(F.col("backups") > 0, "crashed_mid_swap")
        .otherwise("missing")
    )
    action = (
        F.when(F.col("state") == "idle", "none")
        .when(F.col("state") == "orphaned_staging", "drop staging")
        .when(
            F.col("state") == "crashed_mid_swap",
            F.concat(F.lit("restore "), F.col("newest_backup")),
        )
        .otherwise("refuse")
    )
    return found.withColumn("state", name).select(
        "target", "state", "backups", "staging", action.alias("action")
    )

