import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from maskframe.functions import names
from maskframe.operators import catalog, publications, registry, sequences
from maskframe.operators.publications import PublicationSpec, PublishedTable, apply_publication
from maskframe.operators.rules import stale_rules
from maskframe.sources.manifests import MANIFEST_SCHEMA, load_order, table_entries


@pytest.mark.parametrize(
    "version, scrubbed, source, target, reason",
    [
        (1, True, 16, 16, None), (1, True, 16, 18, None), (1, False, 16, 16, "not scrubbed"),
        (1, None, 16, 16, "not scrubbed"), (1, True, 18, 16, "source is newer than target"),
        (1, True, 15, 15, "target is not supported"), (2, False, 18, 15, "unknown artifact version"),
        (None, True, 16, 16, "unknown artifact version"),
    ],
)
def test_admission(spark, version, scrubbed, source, target, reason):
    df = spark.createDataFrame(
        [(version, scrubbed, (source,))], "artifactVersion int, scrubbed boolean, source struct<serverMajor:int>"
    )
    row = registry.admission(df, target).first()
    assert (row["reason"], row["admissible"]) == (reason, reason is None)


def test_previous_within_and_across_days(spark):
    stamps = ["20240101T000000Z", "20240101T235959Z", "20240103T120000Z", "20250101T000000Z"]
    data = [("a", t) for t in stamps + stamps[:2]] + [("b", stamps[0])]
    found = registry.previous(spark.createDataFrame(data, "database string, ts string"))
    assert rows(found) == sorted([
        ("a", stamps[0], None), ("a", stamps[1], stamps[0]), ("a", stamps[2], stamps[1]),
        ("a", stamps[3], stamps[2]), ("b", stamps[0], None),
    ], key=repr)


def test_previous_against_brute_force(spark):
    df = spark.range(4000).select(
        F.expr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'db' || (id % 7) END").alias("database"),
        F.date_format(F.timestamp_seconds(F.lit(1700000000) + F.col("id") * 7919 % 900000), names.TIMESTAMP_PATTERN).alias("ts"),
    )
    taken = {}
    for r in df.collect():
        taken.setdefault(r["database"], set()).add(r["ts"])
    want = []
    for d, stamps in taken.items():
        ordered = sorted(stamps)
        want += [(d, t, p) for t, p in zip(ordered, [None, *ordered])]
    assert rows(registry.previous(df)) == sorted(want, key=repr)
    assert rows(registry.latest(df)) == sorted(((d, max(s)) for d, s in taken.items()), key=repr)


def test_a_name_that_is_no_timestamp_is_an_error(spark):
    df = spark.createDataFrame([("a", "latest")], "database string, ts string")
    with pytest.raises(PySparkException):
        registry.latest(df).collect()


def test_drift(spark):
    t1, t2 = "20240101T000000Z", "20240102T000000Z"
    columns = spark.createDataFrame(
        [("core", t1, "public.users", "id"), ("core", t1, "public.users", "email"), ("core", t1, "public.users", "old"),
         ("core", t2, "public.users", "id"), ("core", t2, "public.users", "email"),
         ("core", t2, "public.users", "referral_code"), ("core", t2, "public.orders", "id"),
         ("new", t2, "public.users", "id")],
        "database string, ts string, table string, column string",
    )
    assert rows(registry.columns_added(columns)) == [
        ("core", t2, "public.orders.id"), ("core", t2, "public.users.referral_code"),
    ]
    assert rows(registry.columns_removed(columns)) == [("core", t2, "public.users.old")]
    t3 = "20240103T000000Z"
    later = columns.union(columns.filter("database = 'core'").filter(F.col("ts") == t2).withColumn("ts", F.lit("20240104T000000Z")))
    taken = later.select("database", "ts").distinct().union(spark.createDataFrame([("core", t3)], "database string, ts string"))
    back = registry.columns_added(later, taken).filter("ts > '20240103'").collect()
    gone = registry.columns_removed(later, taken).filter(F.col("ts") == t3).collect()
    assert len(back) == len(gone) == 4  # the snapshot without a column is compared with on both sides


def test_states(spark):
    listed = [
        ("idle", ["idle"]), ("orphan", ["orphan", "restored_1"]),
        ("orphan2", ["orphan2", "orphan2_backup_20240101T000000Z", "restored_2"]),
        ("crashed", ["crashed_backup_20240101T000000Z", "crashed_backup_20250101T000000Z", "restored_3"]),
        ("crashed2", ["crashed2_backup_20240101T000000Z"]), ("gone", ["restored_4"]),
        ("idle2", ["idle2", "idle2_backup_20240101T000000Z"]),
    ]
    df = spark.createDataFrame([(t, n) for t, ns in listed for n in [*ns, "postgres"]], "target string, name string")
    got = {r["target"]: (r["state"], r["action"]) for r in registry.state(registry.version_roles(df)).collect()}
    assert got == {
        "idle": ("idle", "none"), "idle2": ("idle", "none"),
        "orphan": ("orphaned_staging", "drop staging"), "orphan2": ("orphaned_staging", "drop staging"),
        "crashed": ("crashed_mid_swap", "restore crashed_backup_20250101T000000Z"),
        "crashed2": ("crashed_mid_swap", "restore crashed2_backup_20240101T000000Z"),
        "gone": ("missing", "refuse"),
    }


def test_a_backup_belongs_to_one_target(spark):
    df = spark.createDataFrame([("core", "core2_backup_x"), ("core2", "core2_backup_x")], "target string, name string")
    assert rows(registry.version_roles(df)) == [("core2", "core2_backup_x", "backup")]


@pytest.mark.parametrize("keep, gone", [(1, ["03", "04"]), (2, ["03"]), (0, ["03", "04", "05"]), (-1, ["03", "04", "05"]), (5, [])])
def test_expired(spark, keep, gone):
    data = [("t", f"t_backup_202608{d}T120000Z", "backup") for d in ("03", "05", "04")] + [("t", "t", "target")]
    found = registry.expired(spark.createDataFrame(data, "target string, name string, role string"), keep)
    assert sorted(r["name"][15:17] for r in found.collect()) == gone


def test_expired_cuts_to_the_kept_before_the_shuffle(spark):
    df = spark.createDataFrame([("t", "n", "backup")], "target string, name string, role string")
    plan = registry.expired(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_load_order(spark):
    entry = "struct('public' AS schema, '{}' AS name, {} AS skipped, {} AS file, {}L AS bytes)"
    entries = [("a", "false", "'f'", 5), ("b", "false", "'f'", 50), ("c", "true", "NULL", 0), ("d", "false", "NULL", 9)]
    made = ", ".join(entry.format(*e) for e in entries)
    doc = spark.sql(f"SELECT 'core' AS database, '20240101T000000Z' AS ts, to_json(struct(array({made}) AS tables)) AS j")
    parsed = doc.select("database", "ts", F.from_json("j", MANIFEST_SCHEMA)["tables"].alias("tables"))
    found = load_order(table_entries(parsed)).select("table", "position")
    assert rows(found) == [("public.a", 2), ("public.b", 1)]


def test_names(spark):
    df = spark.createDataFrame([("a.b",), ("a",), (".b",), ("a.",), ("a.b.c",)], "n string")
    assert [r[0] for r in df.select(names.is_qualified(F.col("n"))).collect()] == [True, False, False, False, False]
    quoted = spark.createDataFrame([("ok_1",), ("Upper",), ('q"x',)], "n string").select(names.quoted_identifier(F.col("n")))
    assert [r[0] for r in quoted.collect()] == ["ok_1", '"Upper"', '"q""x"']
    schemas = spark.createDataFrame([("pg_toast",), ("pgx",), ("information_schema",), ("public",)], "n string")
    assert [r[0] for r in schemas.select(names.is_user_schema(F.col("n"))).collect()] == [False, True, False, True]
    assert names.staging_name().startswith("restored_") and names.backup_name("core").startswith("core_backup_2")


# --- sequences --------------------------------------------------------------------------


def test_sequences(spark):
    refs = spark.createDataFrame(
        [("p", "read", "p.t.a"), ("p", "unused", "p.t.b"), ("p", "derived", "p.t.c"), ("p", "empty", "p.t.d"),
         ("p", "alone", None)],
        "schema string, name string, owned_by string",
    )
    readable = spark.createDataFrame([("p", "read", 41), ("p", "unused", None)], "schema string, name string, last_value bigint")
    table = spark.createDataFrame([(7, None, 1), (9, None, 2)], "c int, d int, a int")
    marks = sequences.high_water(table, "p.t", ["a", "c", "d"])
    found = sequences.positions(refs, readable, marks)
    got = {r["name"]: (r["source"], r["last_value"], r["is_called"]) for r in found.collect()}
    assert got == {
        "read": ("pg_sequences", 41, True), "unused": ("pg_sequences", 1, False),
        "derived": ("max_column", 9, True), "empty": ("max_column", 1, False), "alone": ("unavailable", 0, False),
    }
    assert {r["name"]: r["next_value"] for r in sequences.next_values(found).collect()} == {
        "read": 42, "unused": 1, "derived": 10, "empty": 1,
    }
    assert rows(sequences.source_summary(found)) == [
        ("max_column", 2, 2, 0), ("pg_sequences", 2, 2, 0), ("unavailable", 1, 0, 1),
    ]
    entries = sequences.manifest_rows(found)
    assert [e["name"] for e in entries] == ["alone", "derived", "empty", "read", "unused"]


# --- catalogs ---------------------------------------------------------------------------

CLASS = (
    "database string, oid bigint, nspname string, relname string, relkind string, relowner string, "
    "relispartition boolean, relrowsecurity boolean, relforcerowsecurity boolean"
)
ATTRIBUTE = (
    "database string, attrelid bigint, attnum int, attname string, typname string, atttypmod int, "
    "attgenerated string, attidentity string, attnotnull boolean, attisdropped boolean, readable boolean"
)


@pytest.fixture
def classes(spark):
    return spark.createDataFrame(
        [
            ("core", 1, "public", "plain", "r", "ann", False, False, False),
            ("core", 2, "public", "parent", "p", "ann", False, False, False),
            ("core", 3, "public", "leaf", "r", "ann", True, False, False),
            ("core", 4, "pg_catalog", "sys", "r", "ann", False, False, False),
            ("core", 5, "public", "view", "v", "ann", False, False, False),
            ("core", 6, "public", "secured", "r", "bob", False, True, False),
            ("core", 7, "public", "forced", "r", "ann", False, True, True),
            ("core", 8, "public", "mine", "r", "ann", False, True, False),
            ("core", 9, "public", "blocked", "r", "bob", False, True, True),
            ("core", 10, "public", "child", "r", "ann", False, False, False),
            ("free", 6, "public", "secured", "r", "bob", False, True, True),
        ],
        CLASS,
    )


@pytest.fixture
def attributes(spark):
    return spark.createDataFrame(
        [
            ("core", 1, 1, "id", "int8", -1, "", "a", True, False, True),
            ("core", 1, 2, "v", "varchar", 24, "", "", False, False, True),
            ("core", 1, 3, "gen", "text", -1, "s", "", False, False, False),
            ("core", 1, 4, "gone", "text", -1, "", "", False, True, False),
            ("core", 1, 5, "b", "bpchar", 4, "", "", False, False, True),
            ("core", 1, -1, "ctid", "tid", -1, "", "", False, False, True),
            ("core", 9, 1, "x", "text", -1, "", "", False, False, False),
            ("core", 9, 2, "y", "text", -1, "", "", False, False, False),
        ],
        ATTRIBUTE,
    )


def test_catalog_tables(spark, classes):
    inherits = spark.createDataFrame([("core", 3, 2), ("core", 10, 2)], "database string, inhrelid bigint, inhparent bigint")
    found = catalog.tables(classes, inherits)
    parents = {r["table"]: r["parent"] for r in found.filter("database = 'core'").collect()}
    assert parents["public.leaf"] == "public.parent" and parents["public.child"] == ""
    assert "pg_catalog.sys" not in parents and "public.view" not in parents
    assert "public.parent" not in {r["table"] for r in catalog.exportable(found).collect()}
    assert rows(catalog.schemas(found)) == [("core", "public"), ("free", "public")]


def test_catalog_columns(classes, attributes):
    got = {r["column"]: (r["max_len"], r["generated"], r["identity"], r["not_null"])
           for r in catalog.columns(classes, attributes).filter("table = 'public.plain'").collect()}
    assert got == {
        "id": (-1, False, True, True), "v": (20, False, False, False), "gen": (-1, True, False, False),
        "b": (-1, False, False, False),
    }


def test_declared_types(spark):
    df = spark.createDataFrame(
        [("varchar", 24), ("varchar", -1), ("bpchar", 5), ("int4", -1), ("numeric", (12 << 16 | 3) + 4),
         ("numeric", -1), ("uuid", -1)], "t string, m int",
    )
    got = [r[0] for r in df.select(catalog.type_name(F.col("t"), F.col("m"))).collect()]
    assert got == ["character varying(20)", "character varying", "character(1)", "integer", "numeric(12,3)",
                   "numeric", "uuid"]


def test_specs_from_a_catalog(spark, classes, attributes):
    core = "database = 'core'"
    inherits = spark.createDataFrame([("core", 3, 2)], "database string, inhrelid bigint, inhparent bigint")
    found = catalog.tables(classes, inherits).filter(core)
    specs = {s.qualified: s for s in catalog.table_specs(found, catalog.columns(classes, attributes).filter(core))}
    plain = specs["public.plain"]
    assert [c.name for c in plain.columns] == ["id", "v", "gen", "b"]
    assert [c.type_name for c in plain.columns] == ["bigint", "character varying(20)", "text", "character"]
    assert [c.name for c in plain.stored] == ["id", "v", "b"] and plain.column("id").identity
    assert specs["public.parent"].partitioned and specs["public.leaf"].parent == "public.parent"
    assert plain.column("id").data_type.simpleString() == "bigint" and not plain.column("id").textual


def test_findings(spark, classes, attributes):
    roles = spark.createDataFrame(
        [("core", "ann", True, False), ("core", "bob", False, False), ("free", "bob", False, True)],
        "database string, owner string, is_member boolean, bypass_rls boolean",
    )
    found = catalog.findings(classes, attributes, roles)
    assert rows(found.select("table", "kind", "column")) == sorted([
        ("public.blocked", "no_select", "x"), ("public.blocked", "no_select", "y"),
        ("public.forced", "forced_row_security", None), ("public.secured", "row_security", None),
    ], key=repr)
    assert rows(catalog.owner_roles(found)) == [("core", "bob")]
    remedies = {r["kind"]: r["remedy"] for r in catalog.remedies(found, "exporter").collect()}
    assert remedies["row_security"] == "grant bob to exporter"
    assert "BYPASSRLS" in remedies["forced_row_security"] and "SELECT" in remedies["no_select"]
    skipped = spark.createDataFrame([("core", "public.blocked"), ("core", "public.forced")], "database string, table string")
    left = catalog.findings(classes, attributes, roles, skipped)
    assert rows(left.select("table")) == [("public.secured",)]


def test_gate(spark, classes):
    inherits = spark.createDataFrame([], "database string, inhrelid bigint, inhparent bigint")
    databases = spark.createDataFrame(
        [("core", 160004), ("free", 150010), ("empty", 170000), ("old_and_empty", 140000)],
        "database string, version_num int",
    )
    found = catalog.gate(databases, catalog.exportable(catalog.tables(classes, inherits)))
    assert rows(found) == [
        ("empty", 17, 0, "no tables to export"), ("free", 15, 1, "unsupported server"),
        ("old_and_empty", 14, 0, "unsupported server"),
    ]


def test_extension_gaps(spark):
    wanted = spark.createDataFrame([("i", "a", "x"), ("i", "b", "x"), ("i", "a", "y"), ("j", "c", "y")], "instance string, database string, name string")
    available = spark.createDataFrame([("i", "y"), ("i", "z"), ("i", "y")], "instance string, name string")
    assert rows(catalog.extension_gaps(wanted, available)) == [("i", "x", 2), ("j", "y", 1)]


def test_stale_rules(spark, classes, attributes):
    inherits = spark.createDataFrame([], "database string, inhrelid bigint, inhparent bigint")
    rules = spark.createDataFrame(
        [("core", "public.plain", "v"), ("core", "public.plain", "gone"), ("core", "public.plain", "gen"),
         ("core", "public.absent", "v"), ("core", "public.absent", None), ("core", "public.parent", "id"),
         ("core", "public.plain", None)],
        "database string, table string, column string",
    )
    found = stale_rules(rules, catalog.tables(classes, inherits), catalog.columns(classes, attributes))
    assert rows(found) == sorted([
        ("core", "public.plain", "gone", "no such column"), ("core", "public.plain", "gen", "generated column"),
        ("core", "public.absent", "v", "no such table"), ("core", "public.absent", None, "no such table"),
        ("core", "public.parent", "id", "partitioned parent"),
    ], key=repr)


# --- publications -----------------------------------------------------------------------


def test_publications(spark, classes, attributes):
    pubs = spark.createDataFrame(
        [("core", "all", True, True, True, True, True, False), ("core", "by_schema", False, True, False, False, False, False),
         ("core", "listed", False, True, True, False, False, True), ("core", "empty", False, False, False, False, True, False),
         ("core", "both", False, False, False, True, False, False)],
        "database string, pubname string, all_tables boolean, ins boolean, upd boolean, del boolean, trunc boolean, via_root boolean",
    )
    schemas = spark.createDataFrame([("core", "by_schema", "public"), ("core", "both", "public")], "database string, pubname string, nspname string")
    tables = spark.createDataFrame(
        [("core", "listed", 1, [5, 1], "id > 3"), ("core", "listed", 6, None, None), ("core", "both", 1, None, None)],
        "database string, pubname string, oid bigint, attnums array<int>, rowfilter string",
    )
    got = {r["pubname"]: (r["form"], r["publish"]) for r in publications.describe(pubs, schemas, tables).collect()}
    assert got == {
        "all": ("all tables", "insert, update, delete, truncate"), "by_schema": ("schemas", "insert"),
        "listed": ("tables", "insert, update"), "empty": ("empty", "truncate"), "both": ("schemas and tables", "delete"),
    }
    columns = publications.published_columns(classes, attributes, tables).filter("pubname = 'listed'")
    assert rows(columns.select("table", "columns", "row_filter")) == [
        ("public.plain", ["b", "id"], "id > 3"), ("public.secured", [], ""),
    ]
    every = {"public.child", "public.forced", "public.mine", "public.blocked", "public.parent", "public.plain", "public.secured"}
    covered = publications.coverage(classes, pubs, schemas, tables)
    counted = {r["pubname"]: (r["tables"], r["covered"], r["missing"]) for r in covered.collect()}
    assert counted == {"listed": (7, 2, 5), "empty": (7, 0, 7)}
    missing = publications.missing_tables(classes, tables, covered).collect()
    assert {r["table"] for r in missing if r["pubname"] == "listed"} == every - {"public.plain", "public.secured"}
    assert {r["table"] for r in missing if r["pubname"] == "empty"} == every
    assert {r["pubname"] for r in missing} == {"listed", "empty"}
    counted = {r["table"]: (r["enumerated"], r["named"]) for r in publications.unpublished(classes, pubs, schemas, tables).collect()}
    assert counted == {t: (2, int(t in ("public.plain", "public.secured"))) for t in every}
    owners = spark.createDataFrame([("core", "dba")], "database string, owner string")
    found = publications.publication_owners(classes, tables.filter("pubname = 'listed'"), owners)
    assert rows(found.select("owner")) == [("ann",), ("bob",), ("dba",)]


FEED = "relation string, op string, id int, tenant string, secret string"


def test_apply_publication(spark):
    feed = spark.createDataFrame(
        [("public.orders", "insert", 1, "acme", "s"), ("public.orders", "insert", 2, "other", "s"),
         ("public.orders", "delete", 3, "acme", "s"), ("public.orders_2024", "update", 4, "acme", "s"),
         ("public.users", "insert", 5, "acme", "s"), ("public.orders", "insert", 6, None, "s")],
        FEED,
    )
    listed = PublishedTable(("id", "tenant"), "tenant = 'acme'")
    pub = PublicationSpec("p", ("insert", "update"), {"public.orders": listed}, roots={"public.orders_2024": "public.orders"})
    out = apply_publication(feed, pub, "public.orders")
    assert rows(out) == [("public.orders", "insert", 1, "acme"), ("public.orders", "update", 4, "acme")]
    everything = PublicationSpec("q", tables={"public.orders": PublishedTable()})
    assert apply_publication(feed, everything, "public.orders").columns == feed.columns
    assert apply_publication(feed, everything, "public.orders").count() == 4
    for whole in (PublicationSpec("r", all_tables=True), PublicationSpec("s", schemas=("public",))):
        assert apply_publication(feed, whole, "public.users").count() == 1
    for other in (pub, PublicationSpec("t", schemas=("private",))):
        with pytest.raises(ValueError, match="does not publish"):
            apply_publication(feed, other, "public.users")


def test_updates_across_the_filter(spark):
    feed = spark.createDataFrame(
        [("t.t", "update", (1, "in"), (1, "in")), ("t.t", "update", (2, "out"), (2, "in")),
         ("t.t", "update", (3, "in"), (3, "out")), ("t.t", "update", (4, "out"), (4, "out")),
         ("t.t", "insert", None, (5, "in")), ("t.t", "insert", None, (6, "out")),
         ("t.t", "delete", (7, "in"), None), ("t.t", "delete", (8, "out"), None)],
        "relation string, op string, before struct<id:int,op:string>, after struct<id:int,op:string>",
    )
    pub = PublicationSpec("p", tables={"t.t": PublishedTable(("id",), "op = 'in'")})
    out = apply_publication(feed, pub, "t.t", images=True)
    assert rows(out) == [("t.t", "delete", 3), ("t.t", "delete", 7), ("t.t", "insert", 2), ("t.t", "insert", 5), ("t.t", "update", 1)]
    no_filter = PublicationSpec("p", ("update",), {"t.t": PublishedTable(("id",))})
    assert apply_publication(feed, no_filter, "t.t", images=True).count() == 4
