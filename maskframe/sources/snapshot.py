"""Taking a snapshot: every table scrubbed while it is read, the manifest last."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import digests
from ..functions.names import MIN_SERVER_MAJOR, timestamp_name
from ..functions.transforms import new_salt, source_column
from ..operators.registry import columns_added_between
from ..operators.reports import union_all
from ..operators.scrub import apply_plan
from ..operators.sequences import Mark, SequenceRef, manifest_rows, sequence_positions
from ..plans.config import ScrubConfig
from ..plans.specs import TableSpec
from ..plans.tables import PlanError, TablePlan, plan
from ..workspace import data_size, path_exists
from .copyfiles import GZIP, copytext_writer
from .layout import Layout
from .manifests import (
    Manifest, TableEntry, column_entries, read_manifest, read_manifests, table_entries, write_manifest,
)
from .tables import footer_rows, listed, pinned, scanned_files, unpinned

PARQUET = "parquet"
COPYTEXT = "copytext"
DEFAULT_WORKERS = 4


class SourceChanged(RuntimeError):
    """A table would not be read as of one moment."""


class ShortRead(RuntimeError):
    """A table gave other rows than it has, or other rows landed than were written.

    ``tables`` has (recorded, found) by table.
    """

    def __init__(self, what: str, tables: Mapping[str, tuple[int, int]]):
        self.tables = dict(tables)
        super().__init__("; ".join(f"{t}: {what} {found} of {n} rows" for t, (n, found) in sorted(tables.items())))


@dataclass(frozen=True)
class Snapshot:
    layout: Layout
    manifest: Manifest
    columns_added: tuple[str, ...]


def scrubbed_frames(
    tables: Mapping[str, DataFrame], plans: Sequence[TablePlan], salt: str
) -> dict[str, DataFrame]:
    """All scrub projections, analysed but not run; bad SQL in any rule is reported at once."""
    frames, problems = {}, []
    for p in plans:
        name = p.spec.qualified
        if name not in tables:
            problems.append(f"{name}: no such table")
            continue
        try:
            frames[name] = apply_plan(tables[name], p, salt)
        except AnalysisException as e:
            problems.append(f"{name}: {e.getCondition() or 'error'} in a rule or filter")
    if problems:
        raise PlanError(problems)
    return frames


def snapshot(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    specs: Sequence[TableSpec],
    cfg: ScrubConfig,
    root: str,
    database: str,
    *,
    salt: str | None = None,
    ts: str | None = None,
    fmt: str = PARQUET,
    workers: int = DEFAULT_WORKERS,
    server_major: int = MIN_SERVER_MAJOR,
    sequences: Sequence[dict[str, Any]] = (),
    sequence_refs: Sequence[SequenceRef] = (),
    rows_per_file: int | None = None,
    hash_files: bool | None = None,
    recorded: Mapping[str, int] | None = None,
    compression: str = GZIP,
) -> Snapshot:
    """Export all tables and write the manifest.

    ``tables`` must be opened beforehand, all of them, so that they are read as of
    one moment; a source file that changes before the last job ends refuses the snapshot.
    Only counts and digests come back to the driver. ``hash_files`` reads what was
    written once more, for a digest of every file; it is on for COPY text only, unless given. The content digest, which
    a restore checks for Parquet, comes from the pass that writes, and so do the high-water
    marks of ``sequence_refs``. Positions found elsewhere can be given as ``sequences``. ``compression`` is that of
    COPY text; files by ``bzip2`` are read in splits.

    A read that comes out short refuses the snapshot (``ShortRead``): rows kept and rows removed by the filter
    must be as many as ``recorded`` says, or for a plain scan of Parquet files as many as their footers say. Parquet
    that has landed must hold the rows that were observed. Footers are all that is read for it, and the
    columns of a filter, to count what it removes.
    """
    salt = salt or new_salt()
    plans = plan(specs, cfg)
    frames = scrubbed_frames(tables, plans, salt)
    layout = Layout(root, database, ts or timestamp_name())

    hash_files = fmt == COPYTEXT if hash_files is None else hash_files
    exported = [p for p in plans if not p.skipped]
    expected = _expected_rows(spark, {p.spec.qualified: tables[p.spec.qualified] for p in exported}, recorded or {})

    def export(p: TablePlan) -> tuple[TableEntry, list[Mark], int]:
        owned = [r.owned_by for r in sequence_refs if r.owned_by and not r.readable]
        entry, marks = _export_table(frames[p.spec.qualified], p, layout, fmt, rows_per_file, owned, compression)
        removed = _removed_rows(tables[p.spec.qualified], p) if p.spec.qualified in expected else 0
        return _with_files(spark, layout, entry, hash_files), marks, removed

    pins = pinned(spark, frames.values())
    with ThreadPoolExecutor(max_workers=workers) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(export), plans))
    changed = unpinned(spark, pins)
    if changed:
        raise SourceChanged(f"{changed} source files were replaced or removed while the snapshot was taken")
    read = {e.qualified: e.row_count + removed for e, _, removed in done}
    _refuse_short("read", expected, read)
    entries, positions = [e for e, *_ in done], [m for _, marks, _ in done for m in marks]
    if fmt == PARQUET:
        written = {e.qualified: e for e in entries if e.file}
        landed = footer_rows(spark, {t: [e.file] for t, e in written.items()}).collect()
        _refuse_short("landed", {t: e.row_count for t, e in written.items()}, {r["table"]: r["rows"] for r in landed})
    found = manifest_rows(sequence_positions(spark, sequence_refs, positions)) if sequence_refs else list(sequences)

    manifest = Manifest(
        database=database,
        server_major=server_major,
        created_at=datetime.now(timezone.utc).isoformat(),
        config_sha256=cfg.sha256(),
        fk_mode=cfg.fk_mode,
        tables=tuple(entries),
        sequences=tuple(found),
    )
    added = _columns_added(spark, layout, manifest)
    write_manifest(spark, layout, manifest)
    return Snapshot(layout, manifest, added)


def _expected_rows(
    spark: SparkSession, tables: Mapping[str, DataFrame], recorded: Mapping[str, int]
) -> dict[str, int]:
    """How many rows tables have, of those for which something else than a read of them can tell."""
    scans = {t: scanned_files(df) for t, df in tables.items() if t not in recorded}
    files = {t: paths for t, paths in scans.items() if paths is not None}
    known = {t: n for t, n in recorded.items() if t in tables}
    if not files:
        return known
    return known | {r["table"]: r["rows"] for r in footer_rows(spark, files).collect()}  # one row a table


def _removed_rows(df: DataFrame, p: TablePlan) -> int:
    """What the filter takes out, from the columns it names."""
    if not p.rules.where:
        return 0
    return df.filter(~F.coalesce(F.expr(p.rules.where).cast("boolean"), F.lit(False))).count()


def _refuse_short(what: str, recorded: Mapping[str, int], found: Mapping[str, int]) -> None:
    wrong = {t: (n, found[t]) for t, n in recorded.items() if found[t] != n}
    if wrong:
        raise ShortRead(what, wrong)


def _export_table(
    scrubbed: DataFrame, p: TablePlan, layout: Layout, fmt: str, rows_per_file: int | None, owned: Sequence[str],
    compression: str = GZIP,
) -> tuple[TableEntry, list[Mark]]:
    """The table written, and the greatest exported value of each of its columns that owns a sequence."""
    entry = TableEntry(
        schema=p.spec.schema,
        name=p.spec.name,
        skipped=p.skipped,
        where=p.rules.where,
        columns=tuple(p.columns),
        transforms=p.transforms,
    )
    if p.skipped:
        return entry, []
    path = layout.data(p.spec.qualified)
    seen = Observation()
    measures = digests.content_measures(scrubbed.schema)
    prefix = f"{p.spec.qualified}."
    columns = [c for c in (o.removeprefix(prefix) for o in owned if o.startswith(prefix)) if c in scrubbed.columns]
    highest = [F.max(source_column(c)).cast("bigint").alias(f"high{i}") for i, c in enumerate(columns)]
    observed = scrubbed.observe(seen, *[c.alias(n) for n, c in measures.items()], *highest)
    if fmt == COPYTEXT:
        writer = copytext_writer(observed, rows_per_file, compression)
    elif fmt == PARQUET:
        writer = observed.write.format(PARQUET)
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
    else:
        raise ValueError(f'snapshots are written as parquet or copytext, not "{fmt}"')
    writer.mode("error").save(path)

    found = seen.get
    return replace(
        entry,
        row_count=found["rows"],
        file=path,
        format=fmt,
        content_sha256=digests.content_sha256(found),
    ), [(f"{prefix}{c}", found[f"high{i}"]) for i, c in enumerate(columns)]


def _stored_rows(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """The rows of a table's files as they lie there: lines of COPY text, or Parquet rows."""
    if fmt == COPYTEXT:
        return spark.read.option("lineSep", "\n").text(path)
    return spark.read.parquet(path)


def _file_digests(spark: SparkSession, entry: TableEntry) -> DataFrame:
    """(table, file, bytes, sha256) of a table's files: what the store lists, with digests from sums over rows.

    Files are read in splits and sums combine partially, so a file may have any size.
    A file without a row has the digest of no rows.
    """
    found = listed(spark, entry.file)
    if path_exists(spark, f"{entry.file}/part-*"):
        stored = _stored_rows(spark, entry.file, entry.format)
        measures = digests.content_measures(stored.schema)
        by_file = stored.groupBy(F.regexp_extract("_metadata.file_path", r"/([^/]+)$", 1).alias("file")).agg(
            *[c.alias(n) for n, c in measures.items()]
        )
        whole = F.concat_ws(":", "rows", "hash_xor", F.col("hash_sum").cast("string"))
        by_file = by_file.select("file", F.sha2(whole, 256).alias("sha256"))
    else:
        by_file = spark.createDataFrame([], "file string, sha256 string")
    sha = F.coalesce("sha256", F.lit(digests.content_sha256({"rows": 0, "hash_xor": 0, "hash_sum": 0})))
    return found.join(by_file, "file", "left").select(F.lit(entry.qualified).alias("table"), "file", "bytes", sha.alias("sha256"))


def file_digests(spark: SparkSession, layout: Layout) -> DataFrame:
    """(table, file, bytes, sha256) of every data file of a snapshot as it is now."""
    return union_all(_file_digests(spark, e) for e in read_manifest(spark, layout).loadable())


def _with_files(spark: SparkSession, layout: Layout, entry: TableEntry, hash_files: bool) -> TableEntry:
    """What the store lists of a table, and one digest for all its files; digests per file stay beside the data."""
    if not entry.file:
        return entry
    files, size = data_size(spark, entry.file)
    if entry.row_count and not files:
        raise RuntimeError(f"{entry.qualified}: {entry.row_count} rows were written and no file is there")
    if not hash_files:
        return replace(entry, files=files, bytes=size)
    place = layout.table_digests(entry.qualified)
    _file_digests(spark, entry).write.mode("error").parquet(place)
    sums = spark.read.parquet(place).agg(*digests.combine_sha256(F.col("sha256")))
    sha = sums.select(digests.combined_sha256(F.lit(files), F.lit(size)).alias("sha256")).first()["sha256"]
    return replace(entry, files=files, bytes=size, sha256=sha)


def changed_digests(spark: SparkSession, layout: Layout, tables: Collection[str] | None = None) -> DataFrame:
    """Files that are missing, added or different from when the snapshot was taken."""
    found = []
    for entry in read_manifest(spark, layout).loadable():
        if tables is None or entry.qualified in tables:
            then = spark.read.parquet(layout.table_digests(entry.qualified)).withColumnsRenamed(
                {"bytes": "recorded_bytes", "sha256": "recorded_sha256"}
            )
            joined = _file_digests(spark, entry).join(then, ["table", "file"], "full_outer")
            found.append(joined.filter(~F.col("sha256").eqNullSafe(F.col("recorded_sha256"))))
    return union_all(found)


def _columns_added(spark: SparkSession, layout: Layout, manifest: Manifest) -> tuple[str, ...]:
    """Against the newest complete snapshot before this one; the first snapshot adds nothing."""
    earlier = read_manifests(spark, layout.root, layout.database).filter(F.col("ts") < layout.ts)
    newest = earlier.agg(F.max("ts").alias("ts")).first()["ts"]
    if newest is None:
        return ()
    before = column_entries(table_entries(earlier.filter(F.col("ts") == newest)))
    rows = [(t.qualified, c) for t in manifest.tables for c in t.columns]
    now = spark.createDataFrame(rows, "table string, column string")
    added = columns_added_between(now, before).collect()  # at most the columns of one manifest
    return tuple(sorted(r["qualified_column"] for r in added))
