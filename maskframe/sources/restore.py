"""From a snapshot to a published version: select, load, check, publish."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import content_digest, content_sha256
from ..functions.names import MIN_SERVER_MAJOR
from ..operators import audits, load, registry, sequences
from ..operators.profile import table_profile
from ..operators.statistics import column_sketches
from ..plans.specs import TableSpec
from ..workspace import path_exists
from .layout import Layout, path_part
from .manifests import Manifest, read_manifest, read_manifests
from .snapshot import COPYTEXT, changed_digests
from .versions import NEXT_VALUES, SKETCHES, PublishConflict, PublishRefused, Versions

# A run that takes longer than this may be taken for dead by another one on the same target.
ABANDONED_AFTER = timedelta(days=1)


class SnapshotRefused(RuntimeError):
    pass


@dataclass(frozen=True)
class Restored:
    snapshot: str
    version: str
    rows: int
    sequences_applied: int = 0
    sequences_skipped: int = 0


def select_snapshot(
    spark: SparkSession, root: str, database: str, ts: str | None = None,
    target_major: int = MIN_SERVER_MAJOR,
) -> tuple[Layout, Manifest]:
    """The given or the newest complete snapshot, if it may be loaded here."""
    found = read_manifests(spark, root, database)
    if ts is not None:
        found = found.filter(F.col("ts") == ts)
    newest = found.agg(F.max("ts").alias("ts")).first()["ts"]
    if newest is None:
        raise SnapshotRefused(f'no snapshot of "{database}" below {root}')
    judged = registry.admission(found.filter(F.col("ts") == newest), target_major)
    reason = judged.select("reason").first()["reason"]
    if reason is not None:
        raise SnapshotRefused(f"snapshot {newest}: {reason}")
    layout = Layout(root, database, newest)
    return layout, read_manifest(spark, layout)


def _holds_recorded_content(spark: SparkSession, manifest: Manifest, target: TableSpec) -> bool:
    """A second look before a table is refused.

    A migration may shuffle after the observation; when executors are lost, tasks
    before a shuffle can run again and be observed twice.
    """
    entry = manifest.entry(target.qualified)
    found = content_digest(load.read_entry(spark, entry, target)).first()
    return found["content_sha256"] == entry.content_sha256


def restore(
    spark: SparkSession,
    root: str,
    database: str,
    targets: Sequence[TableSpec],
    versions: Versions,
    target: str | None = None,
    *,
    ts: str | None = None,
    target_major: int = MIN_SERVER_MAJOR,
    migrations: Mapping[str, load.Migration] | None = None,
    migrated: Mapping[str, TableSpec] | None = None,
    keep: int = 1,
    workers: int = 4,
    verify_files: bool = False,
    profile: bool = False,
    abandoned_after: timedelta = ABANDONED_AFTER,
) -> Restored:
    """Load a snapshot beside the published version and replace that only if every check passed.

    What an interrupted run left behind is resolved first, and backups beyond ``keep`` go before
    anything is staged. Versions staged less than ``abandoned_after`` ago are left alone: another run may
    be at work on them. If that one publishes first, this one is refused (``PublishConflict``). A failure at any later point drops the staged version and leaves the
    target as it was. Counts and content are those of the rows as loaded; constraints are checked on what
    will be published, after migrations, against the target's spec or, for a table a migration
    gives another shape, its spec in ``migrated``. The content of Parquet tables is checked
    against the manifest while they are loaded. COPY text is checked by the digests of its files, where the snapshot
    has them; ``verify_files`` does the same for all tables and insists on digests. ``profile`` stores
    extremes, counts and sketches of all columns with the version.
    """
    target = target or database
    if versions.state(target) in ("orphaned_staging", "crashed_mid_swap"):
        versions.recover(target, abandoned_after)
    versions.expire(target, keep)
    replaces = versions.published(target)
    layout, manifest = select_snapshot(spark, root, database, ts, target_major)
    _verify(spark, layout, manifest, verify_files)

    migrations = migrations or {}
    migrated = migrated or {}
    by_name = {t.qualified: t for t in targets}
    loaded = load.load(spark, manifest, targets)
    observed: dict[str, Observation] = {}
    checked = load.load(spark, manifest, targets, observed=observed)
    row_checks: dict[str, Observation] = {}

    def published(t: str) -> DataFrame:
        """As it will be written; what concerns single rows is counted on the way."""
        df = checked[t].transform(migrations[t]) if t in migrations else checked[t]
        measures = audits.row_measures(migrated.get(t, by_name[t]))
        if not measures or t not in largest_first:
            return df
        row_checks[t] = Observation()
        return df.observe(row_checks[t], *[c.alias(n) for n, c in measures.items()])

    largest_first = [t.qualified for t in manifest.loadable()]
    written = {t: published(t) for t in [*largest_first, *(n for n in loaded if n not in largest_first)]}
    name = versions.stage(target, written, workers)
    try:
        wrong = [
            t for t, seen in sorted(observed.items())
            if content_sha256(seen.get) != manifest.entry(t).content_sha256
            and not _holds_recorded_content(spark, manifest, by_name[t])
        ]
        if wrong:
            raise SnapshotRefused(f"content differs from the manifest: {', '.join(wrong)}")
        staged = {t: versions.read_version(target, name, t) for t in written}
        # The content of observed tables has been compared, and their count with it.
        reports = [
            load.count_report(loaded[t.qualified], t.qualified, t.row_count)
            for t in manifest.loadable() if t.qualified not in observed
        ]
        for spec in targets:
            if spec.qualified in staged:
                spec = migrated.get(spec.qualified, spec)
                # A task that ran twice may have been counted twice, so what seems wrong is counted again.
                seen = row_checks.get(spec.qualified)
                clean = seen is not None and not any(seen.get.values())
                reports += audits.table_reports(spec, staged, manifest.fk_mode, rows_checked=clean)
        if profile:
            for t, df in staged.items():
                table_profile(df, t).write.parquet(f"{versions.path(target, name)}/_profile/{path_part(t)}")
                column_sketches(df, t).write.parquet(f"{versions.path(target, name)}/{SKETCHES}/{path_part(t)}")
        found = sequences.stored_positions(spark, manifest.sequences)
        sequences.next_values(found).write.parquet(versions.table_path(target, name, NEXT_VALUES))
        versions.publish(target, name, reports, workers, replaces)
    except (PublishRefused, PublishConflict):
        raise
    except Exception:
        versions.discard(target, name)
        raise
    skipped = sum(s["source"] == sequences.UNAVAILABLE for s in manifest.sequences)
    return Restored(layout.ts, name, manifest.total_rows(), len(manifest.sequences) - skipped, skipped)


def _verify(spark: SparkSession, layout: Layout, manifest: Manifest, every: bool) -> None:
    """Refuse a snapshot whose files are not those that were written."""
    tables = [t.qualified for t in manifest.loadable() if every or t.format == COPYTEXT]
    if not tables:
        return
    if not path_exists(spark, layout.digests):
        if every:
            raise SnapshotRefused(f"snapshot {layout.ts} has no file digests")
        return
    changed = changed_digests(spark, layout, tables).groupBy("table").agg(F.count(F.lit(1)).alias("n"))
    broken = [f"{r['table']}: {r['n']} files changed" for r in changed.collect()]
    if broken:
        raise SnapshotRefused("; ".join(sorted(broken)))
