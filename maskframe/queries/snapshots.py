"""Whole snapshots of the given tables: export, registry, load, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import content_digest
from ..operators import load, registry
from ..operators.reports import union_all
from ..operators.sequences import SequenceRef
from ..plans.config import ScrubConfig
from ..plans.specs import ForeignKey, TableSpec
from ..sources.copyfiles import BZIP2, read_copytext, write_copytext
from ..sources.manifests import (
    column_entries, load_order as ranked_by_size, read_manifest, read_manifests, table_entries,
)
from ..sources.restore import restore
from ..sources.snapshot import COPYTEXT, ShortRead, Snapshot, changed_digests, snapshot
from ..sources.tables import footer_rows, scanned_files
from ..sources.versions import PublishRefused, Versions
from ..workspace import new_folder, remove
from .base import SALT, TABLES, open_tables, query, rules, spec_of, table

_TS = "20240131T000000Z"

FLEET_RULES = ScrubConfig.parse("""
version: 1
fk_mode: not_valid
tables:
  public.customer:
    columns:
      c_name: email
      c_acctbal: "NULL"
  public.supplier:
    columns:
      s_name: md5
  public.orders:
    where: "o_orderdate >= date '1999-01-01'"
  public.documents:
    columns:
      source: md5
  public.conversations:
    columns:
      text: redact
  public.labels:
    mode: skip
""")


def _specs(frames: dict[str, DataFrame]) -> list[TableSpec]:
    return [TableSpec.from_df(name, df) for name, df in frames.items()]


def _snapshot(
    spark: SparkSession, sf_dir: str, *names: str, cfg: ScrubConfig | None = None, **options
) -> Snapshot:
    frames = open_tables(spark, sf_dir, *names)
    if cfg is None:
        kept = {n: r for n, r in FLEET_RULES.tables.items() if n in frames}
        cfg = ScrubConfig(fk_mode=FLEET_RULES.fk_mode, tables=kept)
    options = {"salt": SALT, "ts": _TS, "root": new_folder(spark, "snapshots"), **options}
    return snapshot(spark, frames, _specs(frames), cfg, database="core", **options)


def _entries(spark: SparkSession, taken: Snapshot) -> DataFrame:
    return table_entries(read_manifests(spark, taken.layout.root))


_COUNTS = " UNION ALL ".join(
    f"""SELECT 'public.{t}' AS "table", count(*) AS n FROM {t}"""
    + {"orders": " WHERE o_orderdate >= DATE '1999-01-01'", "labels": " WHERE false"}.get(t, "")
    for t in TABLES
)


@query(f"""SELECT "table", CAST(n AS BIGINT) AS row_count, "table" = 'public.labels' AS skipped FROM ({_COUNTS})""")
def snapshot_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full snapshot of all tables; the counts observed while they were written."""
    taken = _snapshot(spark, sf_dir)
    return _entries(spark, taken).select("table", "row_count", "skipped")


@query("""
    SELECT 'public.labels' AS "table", CAST(0 AS BIGINT) AS row_count, 0 AS columns, true AS skipped
    UNION ALL SELECT 'public.pages', count(*), 3, false FROM pages""")
def sink_skip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = _snapshot(spark, sf_dir, "labels", "pages")
    return _entries(spark, taken).select("table", "row_count", F.size("columns").alias("columns"), "skipped")


@query("""
    SELECT 'public.' || table_name AS "table", CAST(ordinal_position AS INTEGER) AS position,
           column_name AS "column",
           CASE column_name WHEN 'c_name' THEN 'email' WHEN 'c_acctbal' THEN 'NULL'
                WHEN 's_name' THEN 'md5' END AS transform
    FROM information_schema.columns
    WHERE table_name IN ('customer', 'supplier', 'orders', 'nation')""")
def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest as a table: configured rules, never the salt or the expression made of it."""
    taken = _snapshot(spark, sf_dir, "customer", "supplier", "orders", "nation")
    return column_entries(_entries(spark, taken)).select("table", "position", "column", "transform")


@query(f"""SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS tables FROM ({_COUNTS})""")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = _snapshot(spark, sf_dir)
    return _entries(spark, taken).agg(
        F.sum("row_count").alias("row_count"), F.count(F.lit(1)).alias("tables")
    )


@query("""
    SELECT c_custkey, 'user_' || md5(c_name || 'grain-of-7') || '@example.invalid' AS c_name, c_nationkey,
           CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer""")
def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot, read the manifest back, load what it lists."""
    taken = _snapshot(spark, sf_dir, "customer")
    manifest = read_manifest(spark, taken.layout)
    target = spec_of(table(spark, sf_dir, "customer"), "customer")
    return load.load(spark, manifest, [target])["public.customer"]


@query("""
    SELECT doc_id, text, lang, md5(source || 'grain-of-7') AS source, n_chars FROM documents""")
def export_roundtrip_copytext(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = _snapshot(spark, sf_dir, "documents", fmt=COPYTEXT)
    target = spec_of(table(spark, sf_dir, "documents"), "documents")
    return load.load(spark, read_manifest(spark, taken.layout), [target])["public.documents"]


@query("""
    SELECT 'public.lineitem' AS "table", count(*) AS row_count, true AS has_files, true AS has_digest,
           CAST(0 AS BIGINT) AS changed_files FROM lineitem
    UNION ALL
    SELECT 'public.events', count(*), true, true, 0 FROM events
    UNION ALL
    SELECT 'public.nation', count(*), true, true, 2 FROM nation
    UNION ALL
    SELECT 'public.region', count(*), true, true, 1 FROM region""")
def export_file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file digested when it landed and again; then nation gets a file and one without rows, region loses one."""
    taken = _snapshot(spark, sf_dir, "lineitem", "events", "nation", "region", hash_files=True)
    nation = table(spark, sf_dir, "nation").coalesce(1)
    for added in (nation, nation.filter("n_nationkey < 0")):
        added.write.mode("append").parquet(taken.layout.data("public.nation"))
    lost = spark.read.parquet(taken.layout.table_digests("public.region")).first()["file"]
    remove(spark, f"{taken.layout.data('public.region')}/{lost}")
    changed = changed_digests(spark, taken.layout).groupBy("table").agg(F.count(F.lit(1)).alias("changed"))
    return _entries(spark, taken).join(changed, "table", "left").select(
        "table", "row_count",
        ((F.col("files") > 0) & (F.col("bytes") > 0)).alias("has_files"),
        (F.length("sha256") == 64).alias("has_digest"),
        F.coalesce("changed", F.lit(0)).cast("bigint").alias("changed_files"),
    )


@query("""
    SELECT 'public.orders' AS "table", count(*) AS recorded, count(*) AS found FROM orders
    UNION ALL
    SELECT 'public.customer', count(*), count(*) FROM customer
    UNION ALL
    SELECT 'public.lineitem', count(*), count(*) FILTER (l_returnflag <> 'R' OR l_quantity > 40) FROM lineitem
    UNION ALL
    SELECT 'public.events', count(*), count(*) FILTER (event_type <> 'view') FROM events""")
def snapshot_refuses_short_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tables, two of which give fewer rows than the footers of their files tell; no manifest is written.

    Filters of the rules do not count as loss, whether they leave out much or nothing.
    """
    frames = open_tables(spark, sf_dir, "orders", "customer", "lineitem", "events")
    stored = footer_rows(spark, {t: scanned_files(df) for t, df in frames.items()}).collect()
    recorded = {r["table"]: r["rows"] for r in stored}
    frames["public.events"] = frames["public.events"].filter("event_type <> 'view'")
    frames["public.lineitem"] = frames["public.lineitem"].filter("l_returnflag <> 'R' OR l_quantity > 40")
    cfg = ScrubConfig.parse({"version": 1, "tables": {
        "public.orders": {"where": "o_orderstatus = 'F'"}, "public.lineitem": {"where": "l_quantity > 10"},
    }})
    root = new_folder(spark, "snapshots")
    try:
        snapshot(spark, frames, _specs(frames), cfg, root, "core", salt=SALT, ts=_TS, recorded=recorded)
    except ShortRead as refused:
        if read_manifests(spark, root).count():
            raise
        rows = [(t, n, *refused.tables.get(t, (n, n))[1:]) for t, n in recorded.items()]
        return spark.createDataFrame(rows, "table string, recorded bigint, found bigint")
    raise AssertionError("a snapshot of short tables was taken")


@query("""
    SELECT 'public.lineitem' AS "table", count(*) AS "rows", true AS same FROM lineitem
    UNION ALL SELECT 'public.orders', count(*), true FROM orders WHERE o_orderdate >= DATE '1999-01-01'
    UNION ALL SELECT 'public.embeddings', count(*), true FROM embeddings
    UNION ALL SELECT 'public.supplier', count(*), false FROM supplier""")
def table_content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest observed while writing equals one computed from what a second export reads."""
    names = ("lineitem", "orders", "embeddings")
    taken = _snapshot(spark, sf_dir, *names)
    again = _snapshot(spark, sf_dir, *names, rows_per_file=5000)
    # One value of one column is another one.
    altered = {"public.supplier": open_tables(spark, sf_dir, "supplier")["public.supplier"].withColumn(
        "s_acctbal", F.when(F.col("s_suppkey") == 1, F.col("s_acctbal") + 0.01).otherwise(F.col("s_acctbal"))
    )}
    other = snapshot(spark, altered, _specs(altered), ScrubConfig(), new_folder(spark, "snapshots"), "core", salt=SALT, ts=_TS)
    before = _snapshot(spark, sf_dir, "supplier", cfg=ScrubConfig())
    digests = union_all(
        content_digest(spark.read.parquet(again.layout.data(f"public.{n}"))).select(
            F.lit(f"public.{n}").alias("table"), "rows", F.col("content_sha256").alias("second")
        )
        for n in names
    )
    changed = content_digest(spark.read.parquet(other.layout.data("public.supplier"))).select(
        F.lit("public.supplier").alias("table"), "rows", F.col("content_sha256").alias("second")
    )
    recorded = _entries(spark, taken).unionByName(_entries(spark, before))
    return digests.unionByName(changed).join(recorded, "table").select(
        "table", "rows", (F.col("content_sha256") == F.col("second")).alias("same")
    )


@query("SELECT * FROM documents")
def copytext_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "copytext")
    write_copytext(df, folder)
    return read_copytext(spark, folder, df.schema)


@query("SELECT * FROM embeddings")
def copytext_roundtrip_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    folder = new_folder(spark, "copytext")
    write_copytext(df, folder)
    return read_copytext(spark, folder, df.schema)


@query("""SELECT * FROM documents""")
def copytext_split_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table by a codec whose files are read in splits, however many rows a file has."""
    df = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "copytext")
    write_copytext(df, folder, compression=BZIP2)
    return read_copytext(spark, folder, df.schema)


@query("""
    SELECT count(*) AS "rows", count(DISTINCT page_id) AS pages, true AS same FROM pages""")
def copytext_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages through COPY text: every row equal to its original."""
    df = table(spark, sf_dir, "pages")
    folder = new_folder(spark, "copytext")
    write_copytext(df, folder)
    back = read_copytext(spark, folder, df.schema)
    joined = df.alias("a").join(back.alias("b"), "page_id", "full_outer")
    return joined.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("page_id").alias("pages"),
        F.bool_and(F.expr("a.url <=> b.url AND a.html <=> b.html")).alias("same"),
    )


@query("""
    SELECT s_acctbal, md5(s_name || 'grain-of-7') AS s_name, 'EU' AS s_region, s_suppkey,
           CAST(s_nationkey AS BIGINT) AS s_nationkey, CAST(NULL AS VARCHAR) AS s_note FROM supplier""")
def load_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target with another column order, a wider type, a defaulted and an empty column."""
    taken = _snapshot(spark, sf_dir, "supplier")
    target = spark.createDataFrame(
        [], "s_acctbal double, s_name string, s_region string, s_suppkey bigint, s_nationkey bigint, s_note string"
    )
    spec = spec_of(target, "supplier", defaults={"s_region": "'EU'"})
    return load.load(spark, read_manifest(spark, taken.layout), [spec])["public.supplier"]


@query("""
    SELECT s_suppkey, md5(s_name || 'grain-of-7') AS s_name, s_nationkey, s_acctbal,
           md5(s_name || 'grain-of-7') || ' <' || CAST(s_nationkey AS VARCHAR) || '>' AS display FROM supplier""")
def load_generated_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = "s_name || ' <' || cast(s_nationkey AS string) || '>'"
    source = table(spark, sf_dir, "supplier").withColumn("display", F.expr(made))
    spec = spec_of(source, "supplier", generated={"display": made})
    taken = snapshot(
        spark, {"public.supplier": source}, [spec], rules("supplier", s_name="md5"),
        new_folder(spark, "snapshots"), "core", salt=SALT, ts=_TS,
    )
    return load.load(spark, read_manifest(spark, taken.layout), [spec])["public.supplier"]


@query("""
    SELECT 'public.orders' AS "table", count(*) AS expected, count(*) AS actual, true AS ok FROM orders
    UNION ALL
    SELECT 'public.events', count(*), count(*) FILTER (event_type <> 'view'),
           count(*) = count(*) FILTER (event_type <> 'view') FROM events""")
def load_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table loaded whole, one loaded short: the recorded counts tell."""
    taken = _snapshot(spark, sf_dir, "orders", "events", cfg=ScrubConfig())
    frames = open_tables(spark, sf_dir, "orders", "events")
    targets = _specs(frames)
    loaded = load.load(
        spark, read_manifest(spark, taken.layout), targets,
        migrations={"public.events": lambda df: df.filter("event_type <> 'view'")},
    )
    recorded = _entries(spark, taken).select("table", F.col("row_count").alias("rows"))
    return load.reconcile(recorded, load.row_counts(loaded))


@query("""
    SELECT "table", CAST(row_number() OVER (ORDER BY n DESC) AS INTEGER) AS position FROM (
        SELECT 'public.lineitem' AS "table", count(*) AS n FROM lineitem
        UNION ALL SELECT 'public.orders', count(*) FROM orders
        UNION ALL SELECT 'public.customer', count(*) FROM customer
        UNION ALL SELECT 'public.region', count(*) FROM region)""")
def load_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest first; the skipped table is not loaded. These tables rank alike by rows and bytes."""
    cfg = ScrubConfig.parse({"version": 1, "tables": {"public.labels": {"mode": "skip"}}})
    taken = _snapshot(spark, sf_dir, "lineitem", "orders", "customer", "region", "labels", cfg=cfg)
    return ranked_by_size(_entries(spark, taken)).select("table", "position")


@query("""
    SELECT c_custkey, 'user_' || md5(c_name || 'grain-of-7') || '@example.invalid' AS email, c_nationkey,
           c_acctbal, c_mktsegment, c_mktsegment = 'BUILDING' AS builder FROM customer""")
def load_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A migration step between load and audit: renames a column and adds one."""
    taken = _snapshot(spark, sf_dir, "customer", cfg=rules("customer", c_name="email"))
    target = spec_of(table(spark, sf_dir, "customer"), "customer")

    def migrate(df: DataFrame) -> DataFrame:
        return df.select(
            "c_custkey", F.col("c_name").alias("email"), "c_nationkey", "c_acctbal", "c_mktsegment",
            (F.col("c_mktsegment") == "BUILDING").alias("builder"),
        )

    manifest = read_manifest(spark, taken.layout)
    return load.load(spark, manifest, [target], {"public.customer": migrate})["public.customer"]


@query("""
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, 'REDACTED' AS o_orderpriority
    FROM orders""")
def publish_current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot, load, check and publish twice; readers get the second version."""
    frames = open_tables(spark, sf_dir, "orders", "customer")
    customer_key = ForeignKey(("o_custkey",), "public.customer", ("c_custkey",))
    targets = [
        spec_of(frames["public.orders"], "orders", not_null=["o_orderkey"], unique=[["o_orderkey"]],
                foreign_keys=[customer_key]),
        spec_of(frames["public.customer"], "customer", unique=[["c_custkey"]]),
    ]
    versions = Versions(spark, new_folder(spark, "versions"))
    root = new_folder(spark, "snapshots")
    steps = (("20240130T000000Z", "md5"), ("20240131T000000Z", "redact"))
    for ts, rule in steps:
        _snapshot(spark, sf_dir, "orders", "customer", cfg=rules("orders", o_orderpriority=rule), root=root, ts=ts)
        restore(spark, root, "core", targets, versions)
    return versions.read("core", "public.orders")


@query("""
    SELECT 'core' AS database, ts, 'public.customer' AS "table", count(*) AS row_count
    FROM customer, (SELECT '20240130T000000Z' AS ts UNION ALL SELECT '20240131T000000Z') GROUP BY ts
    UNION ALL
    SELECT 'core', '20240131T000000Z', 'public.part', count(*) FROM part""")
def registry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of one database, listed from their manifests."""
    root = new_folder(spark, "snapshots")
    _snapshot(spark, sf_dir, "customer", root=root, ts="20240130T000000Z")
    _snapshot(spark, sf_dir, "customer", "part", root=root, ts="20240131T000000Z")
    entries = table_entries(read_manifests(spark, root))
    return entries.select("database", "ts", "table", "row_count")


@query("""
    SELECT 'core' AS database, 'public.part.' || column_name AS qualified_column
    FROM information_schema.columns WHERE table_name = 'part'
    UNION ALL SELECT 'core', 'public.customer.c_segment'""")
def drift_between_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second snapshot has a new table and a new column; the first reports nothing."""
    root = new_folder(spark, "snapshots")
    _snapshot(spark, sf_dir, "customer", root=root, ts="20240130T000000Z")
    frames = open_tables(spark, sf_dir, "customer", "part")
    wider = frames["public.customer"].withColumn("c_segment", F.lower("c_mktsegment"))
    frames["public.customer"] = wider
    snapshot(spark, frames, _specs(frames), ScrubConfig(), root, "core", salt=SALT, ts=_TS)
    taken = read_manifests(spark, root)
    columns = column_entries(table_entries(taken))
    return registry.columns_added(columns, taken).select("database", "qualified_column")


@query("""
    SELECT change, 'public.region.' || column_name AS qualified_column
    FROM information_schema.columns, (SELECT 'added' AS change UNION ALL SELECT 'removed') WHERE table_name = 'region'""")
def drift_over_a_skipped_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full, skipped, full: the second snapshot has no column and is there all the same."""
    root = new_folder(spark, "snapshots")
    skip = ScrubConfig.parse({"version": 1, "tables": {"public.region": {"mode": "skip"}}})
    for ts, cfg in (("20240129T000000Z", ScrubConfig()), ("20240130T000000Z", skip), (_TS, ScrubConfig())):
        _snapshot(spark, sf_dir, "region", cfg=cfg, root=root, ts=ts)
    taken = read_manifests(spark, root)
    found = registry.column_changes(column_entries(table_entries(taken)), taken)
    return found.select("change", "qualified_column")


@query("""
    SELECT 'public' AS "schema", 'orders_seq' AS name, max(o_orderkey) + 1 AS next_value FROM orders
    WHERE o_orderdate >= DATE '1999-01-01'
    UNION ALL SELECT 'public', 'customer_seq', CAST(7001 AS BIGINT)""")
def restore_next_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions found while a snapshot is written, and what a restored version hands out next."""
    root, versions = new_folder(spark, "snapshots"), Versions(spark, new_folder(spark, "versions"))
    refs = [
        SequenceRef("public", "orders_seq", "public.orders.o_orderkey"),
        SequenceRef("public", "customer_seq", "public.customer.c_custkey", readable=True, last_value=7000),
        SequenceRef("public", "free_seq"),
    ]
    _snapshot(spark, sf_dir, "orders", "customer", root=root, sequence_refs=refs)
    restore(spark, root, "core", _specs(open_tables(spark, sf_dir, "orders", "customer")), versions)
    return versions.next_values("core")


@query("SELECT * FROM customer")
def publish_refused_after_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A migration that breaks a key is found in what would be published; readers keep the version before."""
    root, versions = new_folder(spark, "snapshots"), Versions(spark, new_folder(spark, "versions"))
    target = spec_of(table(spark, sf_dir, "customer"), "customer", not_null=["c_custkey"], unique=[["c_custkey"]])
    _snapshot(spark, sf_dir, "customer", cfg=ScrubConfig(), root=root)
    restore(spark, root, "core", [target], versions)
    broken = {"public.customer": lambda df: df.withColumn("c_custkey", F.lit(None).cast("bigint"))}
    try:
        restore(spark, root, "core", [target], versions, migrations=broken)
    except PublishRefused:
        return versions.read("core", "public.customer")
    raise AssertionError("a version with a broken key was published")
