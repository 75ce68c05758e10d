import importlib
import json
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta
from pathlib import Path

import pytest
from conftest import SALT, rows
from pyspark.sql import functions as F

from maskframe import (
    ForeignKey, Layout, Manifest, PlanError, PublishConflict, PublishRefused, ScrubConfig, ShortRead, SnapshotRefused, TableSpec,
    Versions, read_manifest, read_manifests, restore, snapshot,
)
from maskframe.operators import audits, load, registry
from maskframe.operators.sequences import SequenceRef
from maskframe.operators.statistics import merge_sketches, statistics
from maskframe.sources.manifests import column_entries, table_entries
from maskframe.sources.restore import select_snapshot
from maskframe.sources.snapshot import changed_digests, file_digests
from maskframe.sources.tables import (
    changed_files, footer_rows, open_parquet, pinned_files, read_parent, scanned_files,
)
from maskframe.workspace import create_new

taking = importlib.import_module("maskframe.sources.snapshot")
TS = ["20240101T000000Z", "20240102T000000Z", "20240103T000000Z"]
RULES = ScrubConfig.parse({"version": 1, "tables": {
    "public.suppliers": {"columns": {"contact": "email", "tax_no": "null", "remark": "redact"}},
    "public.logs": {"mode": "skip"},
    "public.orders": {"where": "total > 10"},
}})


@pytest.fixture
def tables(spark, suppliers):
    orders = spark.createDataFrame([(10, 4, 5.0), (11, 4, 20.0), (12, 9, 30.0)], "id bigint, suppkey bigint, total double")
    logs = spark.createDataFrame([(1, "secret")], "id bigint, line string")
    return {"public.suppliers": suppliers.drop("label"), "public.orders": orders, "public.logs": logs}


def specs_of(tables, **orders):
    return [
        TableSpec.from_df(n, df, **(orders if n == "public.orders" else {})) for n, df in tables.items()
    ]


def take(spark, tables, root, ts=TS[0], cfg=RULES, **options):
    return snapshot(spark, tables, specs_of(tables), cfg, str(root), "core", ts=ts, salt=SALT, **options)


def test_manifest(spark, tables, tmp_path):
    taken = take(spark, tables, tmp_path, server_major=17, hash_files=True)
    m = read_manifest(spark, taken.layout)
    assert m == Manifest.from_json(taken.manifest.to_json())
    assert [t.qualified for t in m.tables] == ["public.logs", "public.orders", "public.suppliers"]
    assert m.scrubbed and m.server_major == 17 and m.config_sha256 == RULES.sha256()
    assert m.total_rows() == 5 and m.entry("public.orders").where == "total > 10"
    logs = m.entry("public.logs")
    assert logs.skipped and logs.columns == () and logs.file is None and logs.row_count == 0
    suppliers = m.entry("public.suppliers")
    assert suppliers.transforms == {"contact": "email", "tax_no": "null", "remark": "redact"}
    assert suppliers.files > 0 and suppliers.bytes > 0 and len(suppliers.sha256) == 64
    assert {t.qualified for t in m.loadable()} == {"public.orders", "public.suppliers"}
    everything = "".join(p.read_text(errors="replace") for p in Path(taken.layout.folder).rglob("*") if p.is_file())
    assert SALT not in json.dumps(json.loads(taken.manifest.to_json())) and "Mondays" not in everything


def test_unscrubbed_values_never_land(spark, tables, tmp_path):
    taken = take(spark, tables, tmp_path, fmt="copytext")
    text = spark.read.text(taken.layout.data("public.suppliers")).collect()
    assert len(text) == 3 and all("REDACTED" in r[0] and "\\N" in r[0] for r in text)
    assert not any(v in r[0] for r in text for v in ("sales@north-mill.test", "DE-4410-77", "Mondays"))


@pytest.mark.parametrize("fmt", ["parquet", "copytext"])
def test_round_trip(spark, tables, tmp_path, fmt):
    taken = take(spark, tables, tmp_path, fmt=fmt)
    loaded = load.load(spark, read_manifest(spark, taken.layout), specs_of(tables))
    assert rows(loaded["public.orders"]) == [(11, 4, 20.0), (12, 9, 30.0)]
    assert loaded["public.logs"].count() == 0 and loaded["public.logs"].columns == ["id", "line"]
    assert loaded["public.suppliers"].filter("remark = 'REDACTED' AND tax_no IS NULL").count() == 3


def test_unknown_format_and_stale_rules(spark, tables, tmp_path):
    with pytest.raises(ValueError, match='not "csv"'):
        take(spark, tables, tmp_path, fmt="csv")
    stale = ScrubConfig.parse({"version": 1, "tables": {"public.absent": {"mode": "skip"}}})
    with pytest.raises(PlanError, match="public.absent: no such table"):
        take(spark, tables, tmp_path / "x", cfg=stale)
    assert not (tmp_path / "x").exists()


def test_content_digest_ignores_file_layout(spark, tables, tmp_path):
    a = take(spark, tables, tmp_path / "a")
    b = take(spark, {n: df.repartition(3) for n, df in tables.items()}, tmp_path / "b")
    changed = {**tables, "public.orders": tables["public.orders"].withColumn("total", F.col("total") + 1)}
    c = take(spark, changed, tmp_path / "c")
    content = [x.manifest.entry("public.orders").content_sha256 for x in (a, b, c)]
    assert content[0] == content[1] != content[2]


def test_drift_against_the_previous_snapshot(spark, tables, tmp_path):
    assert take(spark, tables, tmp_path, TS[0]).columns_added == ()
    wider = {**tables, "public.orders": tables["public.orders"].withColumn("note", F.lit("x"))}
    assert take(spark, wider, tmp_path, TS[1]).columns_added == ("public.orders.note",)
    full = ScrubConfig()
    added = take(spark, wider, tmp_path, TS[2], cfg=full).columns_added
    assert added == ("public.logs.id", "public.logs.line")
    columns = column_entries(table_entries(read_manifests(spark, str(tmp_path))))
    assert rows(registry.columns_added(columns).select("ts", "qualified_column")) == [
        (TS[1], "public.orders.note"), (TS[2], "public.logs.id"), (TS[2], "public.logs.line"),
    ]


def test_a_snapshot_exists_only_with_its_manifest(spark, tables, tmp_path):
    take(spark, tables, tmp_path, TS[0])
    newest = take(spark, tables, tmp_path, TS[1])
    Path(newest.layout.manifest).rename(tmp_path / "aside")
    found = read_manifests(spark, str(tmp_path))
    assert [r["ts"] for r in registry.latest(found).collect()] == [TS[0]]
    assert read_manifests(spark, str(tmp_path / "nothing")).count() == 0
    with pytest.raises(ValueError, match="not a timestamp"):
        Layout(str(tmp_path), "core", "latest")


def test_changed_and_missing_files_are_found(spark, tables, tmp_path):
    taken = take(spark, tables, tmp_path, hash_files=True)
    assert changed_digests(spark, taken.layout).count() == 0
    assert file_digests(spark, taken.layout).select("table").distinct().count() == 2
    folder = Path(taken.layout.data("public.orders"))
    part = max(folder.glob("part-*"), key=lambda p: p.stat().st_size)
    part.rename(tmp_path / "gone")
    found = changed_digests(spark, taken.layout).collect()
    assert [(r["table"], r["sha256"]) for r in found] == [("public.orders", None)]
    versions = Versions(spark, str(tmp_path / "v"))
    with pytest.raises(SnapshotRefused, match="public.orders: 1 files changed"):
        restore(spark, str(tmp_path), "core", specs_of(tables), versions, verify_files=True)
    with pytest.raises(SnapshotRefused, match="content differs from the manifest: public.orders"):
        restore(spark, str(tmp_path), "core", specs_of(tables), versions)
    assert versions.current().count() == 0
    loaded = load.load(spark, taken.manifest, specs_of(tables))
    counts = spark.createDataFrame([("public.orders", 2)], "table string, rows bigint")
    short = load.row_counts({"public.orders": loaded["public.orders"]})
    (row,) = load.reconcile(counts, short).collect()
    assert not row["ok"] and row["actual"] < row["expected"] == 2
    assert load.reconcile_report(load.reconcile(counts, short)).first()["violations"] > 0


def test_an_added_file_without_rows_is_found(spark, tables, tmp_path):
    taken = take(spark, tables, tmp_path, hash_files=True)
    place = taken.layout.data("public.orders")
    spark.read.parquet(place).filter("id < 0").coalesce(1).write.mode("append").parquet(place)
    (found,) = changed_digests(spark, taken.layout).collect()
    assert found["table"] == "public.orders" and found["bytes"] > 0 and found["recorded_sha256"] is None


def test_a_short_read_refuses_the_snapshot(spark, tmp_path):
    """A broken file that the session is told to skip: the scan gives fewer rows, the footers are an error."""
    place = tmp_path / "t"
    spark.range(0, 40, 1, 4).write.parquet(str(place))
    parts = sorted(place.glob("part-*"))
    whole = spark.read.parquet(str(place))
    specs = [TableSpec.from_df("public.t", whole)]
    rules = ScrubConfig.parse({"version": 1, "tables": {"public.t": {"where": "id > 15"}}})
    taken = snapshot(spark, {"public.t": whole}, specs, rules, str(tmp_path / "s"), "core", ts=TS[0])
    assert taken.manifest.entry("public.t").row_count == 24
    with pytest.raises(ShortRead, match="public.t: read 30 of 40 rows"):
        short = whole.filter("id % 4 > 0")
        snapshot(spark, {"public.t": short}, specs, rules, str(tmp_path / "s"), "core", ts=TS[1], recorded={"public.t": 40})
    parts[0].write_bytes(b"not parquet")
    (place / f".{parts[0].name}.crc").unlink()
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    try:
        frames = {"public.t": spark.read.schema("id bigint").parquet(str(place))}
        assert frames["public.t"].count() == 30
        with pytest.raises(Exception, match="not a Parquet file|FAILED_READ_FILE|CANNOT_READ_FILE_FOOTER"):
            snapshot(spark, frames, specs, rules, str(tmp_path / "s"), "core", ts=TS[2])
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")
    assert [r["ts"] for r in read_manifests(spark, str(tmp_path / "s")).collect()] == [TS[0]]


def test_lost_output_refuses_the_snapshot(spark, tmp_path, monkeypatch):
    real = taking._export_table

    def loses_a_file(*args):
        out = real(*args)
        max(Path(out[0].file).glob("part-*")).rename(tmp_path / "gone")
        return out

    monkeypatch.setattr(taking, "_export_table", loses_a_file)
    df = spark.range(0, 40, 1, 4)
    with pytest.raises(ShortRead, match="public.t: landed 30 of 40 rows"):
        snapshot(spark, {"public.t": df}, [TableSpec.from_df("public.t", df)], ScrubConfig(), str(tmp_path / "s"), "core")
    assert read_manifests(spark, str(tmp_path / "s")).count() == 0


def test_counts_come_from_footers(spark, tmp_path):
    spark.range(0, 40, 1, 4).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    counted = footer_rows(spark, {"public.t": scanned_files(df), "public.none": []})
    assert {r["table"]: r["rows"] for r in counted.collect()} == {"public.t": 40, "public.none": 0}
    assert "PushedAggregation: [COUNT(*)]" in counted._jdf.queryExecution().toString()
    assert scanned_files(df.select(F.col("id") + 1)) == scanned_files(df) and len(scanned_files(df)) == 4
    for other in (df.filter("id > 3"), df.limit(3), df.distinct(), df.union(df), spark.range(3)):
        assert scanned_files(other) is None


def test_file_hashes_are_optional(spark, tables, tmp_path):
    taken = take(spark, tables, tmp_path, hash_files=False)
    entry = taken.manifest.entry("public.orders")
    assert entry.sha256 is None and entry.files > 0 and entry.bytes > 0 and len(entry.content_sha256) == 64
    restore(spark, str(tmp_path), "core", specs_of(tables), Versions(spark, str(tmp_path / "v")))
    with pytest.raises(SnapshotRefused, match="no file digests"):
        restore(spark, str(tmp_path), "core", specs_of(tables), Versions(spark, str(tmp_path / "v")), verify_files=True)


@pytest.mark.parametrize("fmt", ["parquet", "copytext"])
def test_swapped_content_is_found(spark, tables, tmp_path, fmt):
    """Same number of rows, another value: counts agree, the digest does not."""
    taken = take(spark, tables, tmp_path, fmt=fmt)
    folder = Path(taken.layout.data("public.orders"))
    folder.rename(tmp_path / "aside")
    other = {**tables, "public.orders": tables["public.orders"].withColumn("total", F.col("total") + 1)}
    forged = take(spark, other, tmp_path / "forged", fmt=fmt)
    Path(forged.layout.data("public.orders")).rename(folder)
    versions = Versions(spark, str(tmp_path / "v"))
    with pytest.raises(SnapshotRefused, match="public.orders"):
        restore(spark, str(tmp_path), "core", specs_of(tables), versions)


def test_pinned_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    frames = open_parquet(spark, {"public.t": path})
    before = pinned_files(frames["public.t"], "public.t")
    before.write.parquet(str(tmp_path / "pins"))
    spark.range(5).write.mode("append").parquet(path)
    assert frames["public.t"].count() == 10
    pins = spark.read.parquet(str(tmp_path / "pins"))
    assert changed_files(pins, pinned_files(spark.read.parquet(path), "public.t")).count() == 0
    Path(pins.first()["file"].removeprefix("file:")).rename(tmp_path / "moved")
    assert changed_files(pins, pinned_files(spark.read.parquet(path), "public.t")).count() == 1
    with pytest.raises(Exception, match="FILE_NOT_EXIST"):
        frames["public.t"].collect()


def test_partitioned_parent_is_its_leaves(spark):
    a, b = spark.range(3), spark.range(5, 7)
    specs = [TableSpec.from_df("public.a", a, parent="public.p"), TableSpec.from_df("public.b", b, parent="public.p"),
             TableSpec.from_df("public.p", a, kind="partitioned")]
    assert read_parent({"public.a": a, "public.b": b}, specs, "public.p").count() == 5
    with pytest.raises(ValueError, match="no leaf"):
        read_parent({}, specs, "public.q")


def test_alignment(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    target = TableSpec.from_df(
        "public.t", spark.createDataFrame([], "b string, c string, a bigint, d int, g string"),
        defaults={"c": "'dflt'"}, generated={"g": "b || c"},
    )
    out = load.recompute_generated(load.align(df, target), target)
    assert out.dtypes == [("b", "string"), ("c", "string"), ("a", "bigint"), ("d", "int"), ("g", "string")]
    assert tuple(out.first()) == ("x", "dflt", 1, None, "xdflt")
    with pytest.raises(ValueError, match="no place for a, b"):
        load.align(df, TableSpec.from_df("public.t", spark.range(1)))


# --- restore and publish ----------------------------------------------------------------


def with_key(tables):
    key = ForeignKey(("suppkey",), "public.suppliers", ("suppkey",))
    return specs_of(tables, foreign_keys=[key], not_null=["id"], unique=[["id"]])


def test_restore_publishes_and_keeps_backups(spark, tables, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    assert versions.state("core") == "missing"
    with pytest.raises(LookupError):
        versions.read("core", "public.orders")
    names = []
    for ts in TS:
        take(spark, tables, tmp_path, ts)
        names.append(restore(spark, str(tmp_path), "core", with_key(tables), versions, profile=True).version)
        assert versions.state("core") == "idle"
    roles = {r["name"]: r["role"] for r in versions.current().collect()}
    # A run expires before it stages, so the version before last is still there.
    assert roles == {names[0]: "backup", names[1]: "backup", names[2]: "target"}
    assert rows(versions.read("core", "public.orders")) == [(11, 4, 20.0), (12, 9, 30.0)]
    assert spark.read.parquet(f"{versions.path('core', names[2])}/_profile/*").count() == 10


def test_orphans_refuse_unless_not_valid(spark, tables, tmp_path):
    filtered = {"public.suppliers": {"where": "suppkey = 4"}}
    versions = Versions(spark, str(tmp_path / "v"))
    take(spark, tables, tmp_path, TS[0])
    first = restore(spark, str(tmp_path), "core", with_key(tables), versions).version
    take(spark, tables, tmp_path, TS[1], ScrubConfig.parse({"version": 1, "tables": filtered}))
    with pytest.raises(PublishRefused, match="foreign_key suppkey->public.suppliers: 1"):
        restore(spark, str(tmp_path), "core", with_key(tables), versions)
    assert [r["name"] for r in versions.current().collect()] == [first]
    assert versions.read("core", "public.suppliers").count() == 3
    take(spark, tables, tmp_path, TS[2],
         ScrubConfig.parse({"version": 1, "fk_mode": "not_valid", "tables": filtered}))
    restore(spark, str(tmp_path), "core", with_key(tables), versions)
    assert versions.read("core", "public.suppliers").count() == 1


def test_what_a_migration_makes_is_checked_and_a_failure_changes_nothing(spark, tables, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    take(spark, tables, tmp_path)
    moved = {"public.orders": lambda df: df.filter("id = 11").withColumnRenamed("total", "amount")}
    shape = TableSpec.from_df(
        "public.orders", moved["public.orders"](tables["public.orders"]), not_null=["id", "amount"], unique=[["id"]],
        checks={"small": "amount < 50"},
    )
    restore(spark, str(tmp_path), "core", with_key(tables), versions, migrations=moved, migrated={"public.orders": shape})
    assert versions.read("core", "public.orders").columns == ["id", "suppkey", "amount"]
    before = rows(versions.current())

    def boom(df):
        return df.withColumn("x", F.raise_error(F.lit("boom")))

    breaks = {
        "not_null id: 2": lambda df: df.withColumn("id", F.lit(None).cast("bigint")),
        "unique id: 1": lambda df: df.withColumn("id", F.lit(7).cast("bigint")),
        "foreign_key suppkey->public.suppliers: 2": lambda df: df.withColumn("suppkey", F.lit(1).cast("bigint")),
        "boom": boom,
    }
    for message, broken in breaks.items():
        with pytest.raises(Exception, match=message):
            restore(spark, str(tmp_path), "core", with_key(tables), versions, migrations={"public.orders": broken})
        assert rows(versions.current()) == before and versions.state("core") == "idle"
    assert {p.name for p in (tmp_path / "v" / "core").iterdir()} == {"_versions", before[0][1]}


@pytest.mark.parametrize("fmt", ["parquet", "copytext"])
def test_snapshots_can_be_moved_and_names_can_hold_anything(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "`a.b` bigint, note string")
    tables = {f"public.{n}": df for n in ("a[1]", "a/b", "a b", "a%20b", "q")}
    specs = [TableSpec.from_df(n, d, unique=[["a.b"]], not_null=["a.b"], foreign_keys=[ForeignKey(("a.b",), "public.q", ("a.b",))])
             for n, d in tables.items()]
    taken = snapshot(spark, tables, specs, ScrubConfig(), str(tmp_path / "here"), "my db", ts=TS[0], salt=SALT, fmt=fmt, hash_files=True)
    assert all(t.files > 0 and t.bytes > 0 and len(t.sha256) == 64 for t in taken.manifest.tables)
    (tmp_path / "here").rename(tmp_path / "there")
    root, versions = str(tmp_path / "there"), Versions(spark, str(tmp_path / "v"))
    found = read_manifests(spark, root)
    assert [(r["database"], r["ts"]) for r in registry.latest(found).collect()] == [("my db", TS[0])]
    assert all(not r["file"].startswith("/") for r in table_entries(found).collect())
    restore(spark, root, "my db", specs, versions, verify_files=True)
    for n in tables:
        assert rows(versions.read("my db", n)) == [(1, "x"), (2, "y")]


def test_a_key_with_a_dot_is_checked(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "`a.b` bigint")
    key = ForeignKey(("a.b",), "public.p", ("c.d",))
    spec = TableSpec.from_df("public.t", df, unique=[["a.b"]], foreign_keys=[key])
    assert audits.audit_unique(df, spec).first()["violations"] == 1
    parent = spark.createDataFrame([(2,)], "`c.d` bigint")
    assert audits.audit_fk(spec, {"public.t": df, "public.p": parent}).first()["violations"] == 2


def test_a_source_file_that_changes_meanwhile_refuses_the_snapshot(spark, tmp_path, monkeypatch):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    frames = open_parquet(spark, {"public.t": str(tmp_path / "t")})
    real = taking._export_table

    def meanwhile(*args):
        out = real(*args)
        spark.range(20).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "t"))
        return out

    monkeypatch.setattr(taking, "_export_table", meanwhile)
    specs = [TableSpec.from_df("public.t", frames["public.t"])]
    with pytest.raises(taking.SourceChanged, match="1 source files"):
        snapshot(spark, frames, specs, ScrubConfig(), str(tmp_path / "s"), "core", ts=TS[0])
    assert read_manifests(spark, str(tmp_path / "s")).count() == 0


def test_no_data_file_is_read_as_one_row():
    import inspect

    import maskframe.sources.snapshot as module

    assert "binaryFile" not in inspect.getsource(module)
    assert '"content"' not in inspect.getsource(module)


def test_sequences_travel_with_the_tables(spark, tables, tmp_path):
    refs = [
        SequenceRef("public", "orders_id", "public.orders.id"), SequenceRef("public", "read", None, True, 41),
        SequenceRef("public", "fresh", None, True), SequenceRef("public", "lost"), SequenceRef("public", "skipped", "public.logs.id"),
    ]
    taken = take(spark, tables, tmp_path, sequence_refs=refs)
    assert {s["name"]: (s["source"], s["lastValue"], s["isCalled"]) for s in taken.manifest.sequences} == {
        "orders_id": ("max_column", 12, True), "read": ("pg_sequences", 41, True), "fresh": ("pg_sequences", 1, False),
        "lost": ("unavailable", 0, False), "skipped": ("max_column", 1, False),
    }
    versions = Versions(spark, str(tmp_path / "v"))
    done = restore(spark, str(tmp_path), "core", specs_of(tables), versions)
    assert (done.sequences_applied, done.sequences_skipped) == (4, 1)
    assert {r["name"]: r["next_value"] for r in versions.next_values("core").collect()} == {
        "orders_id": 13, "read": 42, "fresh": 1, "skipped": 1,
    }


@pytest.mark.parametrize("keep, left", [(0, 1), (1, 2), (2, 3)])
def test_files_of_expired_versions_go(spark, tables, tmp_path, keep, left):
    versions = Versions(spark, str(tmp_path / "v"))
    take(spark, tables, tmp_path)
    names = [restore(spark, str(tmp_path), "core", specs_of(tables), versions, keep=keep).version for _ in range(4)]
    there = {p.name for p in (tmp_path / "v" / "core").iterdir()} - {"_versions"}
    # What the last run replaced is there whatever ``keep`` is.
    assert there == set(names[-left - 1:]) == {r["name"] for r in versions.current().collect()}


def test_sketches_stay_with_their_version(spark, tables, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    take(spark, tables, tmp_path, fmt="copytext", compression="bzip2")
    names = [restore(spark, str(tmp_path), "core", specs_of(tables), versions, profile=p).version for p in (True, False, True)]
    found = versions.sketches("core", "public.orders")
    # The first version is the second backup; one is kept while a run is at work, and goes with the next.
    assert {r["name"] for r in found.select("name").collect()} <= {names[0], names[2]}
    (total,) = statistics(merge_sketches(found.filter(F.col("name") == names[2]))).filter("column = 'total'").collect()
    assert total["rows"] == 2 and [c["value"] for c in total["common"]] == ["20.0", "30.0"]
    with pytest.raises(LookupError, match="has sketches"):
        versions.sketches("core", "public.nothing")


def test_selecting_a_snapshot(spark, tables, tmp_path):
    take(spark, tables, tmp_path, TS[0], server_major=16)
    take(spark, tables, tmp_path, TS[1], server_major=18)
    assert select_snapshot(spark, str(tmp_path), "core", target_major=18)[0].ts == TS[1]
    assert select_snapshot(spark, str(tmp_path), "core", TS[0], 16)[0].ts == TS[0]
    with pytest.raises(SnapshotRefused, match="newer than target"):
        select_snapshot(spark, str(tmp_path), "core", target_major=16)
    with pytest.raises(SnapshotRefused, match="no snapshot"):
        select_snapshot(spark, str(tmp_path), "other")


def test_recovery(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    frames = {"public.t": spark.range(3)}
    a = versions.stage("core", frames)
    versions.publish("core", a)
    b = versions.stage("core", frames)
    assert versions.state("core") == "orphaned_staging"
    assert versions.recover("core") == "orphaned_staging" and versions.state("core") == "idle"
    assert versions.recover("core") == "idle"
    with pytest.raises(LookupError, match="not a staged version"):
        versions.publish("core", b)
    versions._append("core", [(a, "backup")])
    c = versions.stage("core", frames)
    assert versions.state("core") == "crashed_mid_swap"
    assert versions.recover("core") == "crashed_mid_swap"
    assert [(r["name"], r["role"]) for r in versions.current().collect()] == [(a, "target")]
    versions._append("core", [(a, "dropped"), (c, "dropped")])
    with pytest.raises(LookupError, match="left as found"):
        versions.recover("core")


def test_of_two_interleaved_runs_the_first_to_publish_wins(spark, tables, tmp_path):
    """The second run starts while the first one is staging; neither sees or removes the other's files."""
    versions = Versions(spark, str(tmp_path / "v"))
    take(spark, tables, tmp_path)
    before = restore(spark, str(tmp_path), "core", specs_of(tables), versions).version
    inner = []
    staged = versions.stage("core", {"public.t": spark.range(3)})
    replaces = versions.published("core")
    inner.append(restore(spark, str(tmp_path), "core", specs_of(tables), versions).version)
    assert versions.read_version("core", staged, "public.t").count() == 3
    with pytest.raises(PublishConflict, match=f"published as {inner[0]} meanwhile"):
        versions.publish("core", staged, replaces=replaces)
    assert versions.published("core") == inner[0] != before
    assert {p.name for p in (tmp_path / "v" / "core").iterdir()} - {"_versions"} == {before, inner[0]}

    def late(df):
        """Publishes between this run's look at the target and its own publication."""
        inner.append(restore(spark, str(tmp_path), "core", specs_of(tables), versions, keep=5).version)
        return df

    with pytest.raises(PublishConflict):
        restore(spark, str(tmp_path), "core", specs_of(tables), versions, migrations={"public.orders": late}, keep=5)
    assert versions.published("core") == inner[1]
    assert versions.state("core") == "idle"


def test_a_log_number_is_taken_once(spark, tmp_path):
    """Writers at the same moment: every change is there, one entry each, in some order."""
    versions = Versions(spark, str(tmp_path))
    place = str(tmp_path / "log" / "1.json")
    assert create_new(spark, place, "{}\n") and not create_new(spark, place, "other\n")
    assert Path(place).read_text() == "{}\n" and [p.name for p in Path(place).parent.glob("[!.]*")] == ["1.json"]
    names = [f"v{i}" for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: versions._append("core", [(n, "staging")]), names))
    assert sorted(r["name"] for r in versions.current("core").collect()) == names
    log = tmp_path / "core" / "_versions"
    assert {p.name for p in log.glob("[0-9]*.json")} == {f"{i:020d}.json" for i in range(1, 5)}
    (log / f"{5:020d}.json").write_text("")
    with pytest.raises(RuntimeError, match="entry 5 .* cannot be read"):
        versions._append("core", [("v5", "staging")])


def test_only_abandoned_staging_goes(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    a = versions.stage("core", {"public.t": spark.range(3)})
    versions.publish("core", a)
    b = versions.stage("core", {"public.t": spark.range(4)})
    assert versions.recover("core", timedelta(hours=1)) == "idle"
    assert versions.read_version("core", b, "public.t").count() == 4
    assert versions.recover("core", timedelta(0)) == "orphaned_staging"
    assert not (tmp_path / "core" / b).exists()


@pytest.mark.parametrize("keep, left", [(0, 0), (-1, 0), (1, 1), (2, 2), (9, 3)])
def test_backup_retention(spark, tmp_path, keep, left):
    versions = Versions(spark, str(tmp_path))
    names = ["v1", "v2", "v3", "v4"]
    for n in names:
        versions._append("core", [(n, "staging")])
        versions.publish("core", n)
    versions.expire("core", keep)
    backups = sorted(r["name"] for r in versions.current().filter("role = 'backup'").collect())
    assert backups == names[3 - left:3]
