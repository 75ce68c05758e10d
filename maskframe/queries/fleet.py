"""Questions over many databases: snapshots, versions, sequences, catalogs, publications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import catalog, publications, registry, sequences
from ..operators.reports import union_all
from ..operators.rules import stale_rules
from ..operators.scrub import scrub
from ..sources.manifests import parse_manifests
from .base import SALT, query, rules, spec_of, table
from .extracts import extract, published_tables, with_extracts

# --- snapshots and versions -------------------------------------------------------------


@query(with_extracts("SELECT database, max(ts) AS ts FROM snapshots WHERE has_manifest GROUP BY database", "snapshots"))
def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot without a manifest was never finished and is not one."""
    return registry.latest(extract(spark, sf_dir, "snapshots").filter("has_manifest"))


@query(with_extracts("""
    SELECT database, ts, lag(ts) OVER (PARTITION BY database ORDER BY ts) AS previous_ts
    FROM (SELECT DISTINCT database, ts FROM snapshots WHERE has_manifest)""", "snapshots"))
def registry_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.previous(extract(spark, sf_dir, "snapshots").filter("has_manifest"))


@query(with_extracts("""
    SELECT id, reason IS NULL AS admissible, reason FROM (
        SELECT id, CASE WHEN artifact_version <> 1 THEN 'unknown artifact version'
                        WHEN NOT scrubbed THEN 'not scrubbed'
                        WHEN source_major > target_major THEN 'source is newer than target'
                        WHEN target_major < 16 THEN 'target is not supported' END AS reason
        FROM manifest_headers)""", "manifest_headers"))
def manifest_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests as JSON documents, parsed and judged."""
    headers = extract(spark, sf_dir, "manifest_headers")
    document = F.to_json(F.struct(
        F.col("artifact_version").alias("artifactVersion"), "scrubbed",
        F.struct(F.col("source_major").alias("serverMajor"), F.lit("core").alias("database")).alias("source"),
    ))
    parsed = parse_manifests(headers.select("id", "target_major", document.alias("manifest")))
    return registry.admission(parsed, F.col("target_major")).select("id", "admissible", "reason")


@query(with_extracts("""
    , present AS (SELECT DISTINCT database, ts, "table" || '.' || "column" AS qualified_column FROM snapshot_columns),
    taken AS (SELECT database, ts, lag(ts) OVER (PARTITION BY database ORDER BY ts) AS previous_ts
              FROM (SELECT DISTINCT database, ts FROM snapshot_columns))
    SELECT p.database, p.ts, p.qualified_column FROM present p
    JOIN taken t ON t.database = p.database AND t.ts = p.ts AND t.previous_ts IS NOT NULL
    WHERE NOT EXISTS (SELECT 1 FROM present b WHERE b.database = p.database
                      AND b.ts = t.previous_ts AND b.qualified_column = p.qualified_column)""",
    "snapshot_columns"))
def drift_columns_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.columns_added(extract(spark, sf_dir, "snapshot_columns"))


@query(with_extracts("""
    , present AS (SELECT DISTINCT database, ts, "table" || '.' || "column" AS qualified_column FROM snapshot_columns),
    taken AS (SELECT database, ts, lag(ts) OVER (PARTITION BY database ORDER BY ts) AS previous_ts
              FROM (SELECT DISTINCT database, ts FROM snapshot_columns))
    SELECT t.database, t.ts, b.qualified_column FROM taken t
    JOIN present b ON b.database = t.database AND b.ts = t.previous_ts
    WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.database = t.database
                      AND p.ts = t.ts AND p.qualified_column = b.qualified_column)""",
    "snapshot_columns"))
def drift_columns_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.columns_removed(extract(spark, sf_dir, "snapshot_columns"))


_ROLES = """
    , versions AS (SELECT target, name,
        CASE WHEN name = target THEN 'target'
             WHEN starts_with(name, target || '_backup_') THEN 'backup'
             WHEN starts_with(name, 'restored_') THEN 'staging' END AS role
        FROM instance_databases)"""


@query(with_extracts(_ROLES + """
    SELECT target, name FROM (
        SELECT target, name, row_number() OVER (PARTITION BY target ORDER BY name DESC) AS n
        FROM versions WHERE role = 'backup') WHERE n > 1""", "instance_databases"))
def retention_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = registry.version_roles(extract(spark, sf_dir, "instance_databases"))
    return registry.expired(versions, keep=1)


@query(with_extracts(_ROLES + """
    , found AS (SELECT target, count(*) FILTER (role = 'target') AS live,
                       count(*) FILTER (role = 'backup') AS backups,
                       count(*) FILTER (role = 'staging') AS staging,
                       max(name) FILTER (role = 'backup') AS newest FROM versions GROUP BY target)
    SELECT target,
           CASE WHEN live > 0 AND staging = 0 THEN 'idle' WHEN live > 0 THEN 'orphaned_staging'
                WHEN backups > 0 THEN 'crashed_mid_swap' ELSE 'missing' END AS state,
           backups, staging,
           CASE WHEN live > 0 AND staging = 0 THEN 'none' WHEN live > 0 THEN 'drop staging'
                WHEN backups > 0 THEN 'restore ' || newest ELSE 'refuse' END AS action
    FROM found""", "instance_databases"))
def publish_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.state(registry.version_roles(extract(spark, sf_dir, "instance_databases")))


# --- sequences --------------------------------------------------------------------------


@query("""
    SELECT 'public.orders.o_orderkey' AS owned_by, max(o_orderkey) AS max_value FROM orders
    WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'public.orders.o_custkey', max(o_custkey) FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'public.lineitem.l_orderkey', max(l_orderkey) FROM lineitem
    UNION ALL SELECT 'public.lineitem.l_linenumber', CAST(max(l_linenumber) AS BIGINT) FROM lineitem""")
def sequence_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks come from the exported rows, so a filtered table's mark is that of its filter."""
    orders, lineitem = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    exported = scrub(orders, spec_of(orders, "orders"), rules("orders", where="o_orderstatus = 'F'"), SALT)
    return union_all([
        sequences.high_water(exported, "public.orders", ["o_orderkey", "o_custkey"]),
        sequences.high_water(lineitem, "public.lineitem", ["l_orderkey", "l_linenumber"]),
    ])


_POSITIONS = """
    , marks AS (SELECT owned_by, max(value) AS max_value FROM owned_values GROUP BY owned_by),
    positions AS (
        SELECT r."schema", r.name, r.owned_by,
               CASE WHEN v.name IS NOT NULL THEN 'pg_sequences' WHEN r.owned_by IS NULL THEN 'unavailable'
                    ELSE 'max_column' END AS source,
               CASE WHEN v.name IS NOT NULL THEN coalesce(v.last_value, 1)
                    WHEN r.owned_by IS NULL THEN 0 ELSE coalesce(m.max_value, 1) END AS last_value,
               CASE WHEN v.name IS NOT NULL THEN v.last_value IS NOT NULL
                    WHEN r.owned_by IS NULL THEN false ELSE m.max_value IS NOT NULL END AS is_called
        FROM sequence_refs r
        LEFT JOIN sequence_values v ON v."schema" = r."schema" AND v.name = r.name
        LEFT JOIN marks m ON m.owned_by = r.owned_by)"""
_POSITION_INPUTS = ("sequence_refs", "sequence_values", "owned_values")


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, readable, owned = (extract(spark, sf_dir, n) for n in _POSITION_INPUTS)
    return sequences.positions(refs, readable, sequences.high_water_by(owned, "owned_by", "value"))


@query(with_extracts("""
    SELECT s.database, n.nspname AS "schema", s.relname AS name,
           CASE WHEN t.relname IS NOT NULL AND a.attname IS NOT NULL
                THEN tn.nspname || '.' || t.relname || '.' || a.attname END AS owned_by
    FROM raw_classes s
    JOIN namespaces n ON n.database = s.database AND n.oid = s.relnamespace
    LEFT JOIN depends d ON d.database = s.database AND d.objid = s.oid AND d.deptype IN ('a', 'i') AND d.refobjsubid > 0
    LEFT JOIN raw_classes t ON t.database = d.database AND t.oid = d.refobjid
    LEFT JOIN namespaces tn ON tn.database = t.database AND tn.oid = t.relnamespace
    LEFT JOIN attributes a ON a.database = d.database AND a.attrelid = d.refobjid AND a.attnum = d.refobjsubid
    WHERE s.relkind = 'S'""", "raw_classes", "namespaces", "depends", "attributes"))
def sequence_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which column owns a sequence, from the raw catalog."""
    names = ("raw_classes", "namespaces", "depends", "attributes")
    return sequences.owning_columns(*(extract(spark, sf_dir, n) for n in names))


@query(with_extracts(_POSITIONS + " SELECT * FROM positions", *_POSITION_INPUTS))
def sequence_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir)


@query(with_extracts(_POSITIONS + """
    SELECT "schema", name, CASE WHEN is_called THEN last_value + 1 ELSE last_value END AS next_value
    FROM positions WHERE source <> 'unavailable'""", *_POSITION_INPUTS))
def sequence_next_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.next_values(_positions(spark, sf_dir))


@query(with_extracts(_POSITIONS + """
    SELECT source, count(*) AS sequences, count(*) FILTER (source <> 'unavailable') AS applied,
           count(*) FILTER (source = 'unavailable') AS skipped FROM positions GROUP BY source""",
    *_POSITION_INPUTS))
def sequence_source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.source_summary(_positions(spark, sf_dir))


# --- catalogs ---------------------------------------------------------------------------

_USER = r"nspname NOT LIKE 'pg\_%' ESCAPE '\' AND nspname <> 'information_schema'"
_TABLES = f"""
    tables AS (
        SELECT c.database, c.oid, c.nspname || '.' || c.relname AS "table", c.nspname AS "schema",
               c.relkind AS kind, c.relowner AS owner, c.relrowsecurity AS row_security,
               c.relforcerowsecurity AS force_row_security, coalesce(p.nspname || '.' || p.relname, '') AS parent
        FROM classes c
        LEFT JOIN inherits i ON i.database = c.database AND i.inhrelid = c.oid AND c.relispartition
        LEFT JOIN classes p ON p.database = i.database AND p.oid = i.inhparent
        WHERE c.relkind IN ('r', 'p') AND c.{_USER.replace('AND nspname', 'AND c.nspname')})"""
_COLUMNS = f"""
    columns AS (
        SELECT c.database, c.nspname || '.' || c.relname AS "table", a.attnum, a.attname AS "column",
               CASE a.typname WHEN 'varchar' THEN 'character varying' WHEN 'bpchar' THEN 'character'
                              WHEN 'int4' THEN 'integer' ELSE a.typname END AS base_type,
               CASE WHEN a.typname = 'varchar' AND a.atttypmod > 4
                        THEN 'character varying(' || CAST(a.atttypmod - 4 AS VARCHAR) || ')'
                    WHEN a.typname = 'bpchar' AND a.atttypmod > 4
                        THEN 'character(' || CAST(a.atttypmod - 4 AS VARCHAR) || ')'
                    WHEN a.typname = 'varchar' THEN 'character varying'
                    WHEN a.typname = 'bpchar' THEN 'character'
                    WHEN a.typname = 'int4' THEN 'integer' ELSE a.typname END AS type_name,
               CASE WHEN a.typname IN ('varchar', 'bpchar') AND a.atttypmod > 4
                    THEN a.atttypmod - 4 ELSE -1 END AS max_len,
               a.attgenerated <> '' AS generated, a.attidentity <> '' AS identity, a.attnotnull AS not_null
        FROM attributes a JOIN classes c ON c.database = a.database AND c.oid = a.attrelid
        WHERE a.attnum > 0 AND NOT a.attisdropped AND c.relkind IN ('r', 'p')
          AND c.{_USER.replace('AND nspname', 'AND c.nspname')})"""
_FINDINGS = f"""
    ordinary AS (SELECT database, oid, nspname || '.' || relname AS "table", relowner AS owner,
                        relrowsecurity, relforcerowsecurity
                 FROM classes WHERE relkind = 'r' AND {_USER}),
    blocked AS (SELECT o.database, o."table", o.owner, a.attnum, a.attname AS "column"
                FROM ordinary o JOIN attributes a ON a.database = o.database AND a.attrelid = o.oid
                WHERE NOT a.attisdropped AND a.attgenerated = '' AND NOT a.readable),
    findings AS (
        SELECT f.* FROM (
            SELECT database, "table", owner, 'no_select' AS kind, attnum, "column" FROM blocked
            UNION ALL
            SELECT o.database, o."table", o.owner,
                   CASE WHEN o.relforcerowsecurity THEN 'forced_row_security' ELSE 'row_security' END,
                   NULL, NULL
            FROM ordinary o LEFT JOIN roles r ON r.database = o.database AND r.owner = o.owner
            WHERE o.relrowsecurity AND NOT coalesce(r.bypass_rls, false)
              AND NOT (coalesce(r.is_member, false) AND NOT o.relforcerowsecurity)
              AND NOT EXISTS (SELECT 1 FROM blocked b WHERE b.database = o.database AND b."table" = o."table")
        ) f
        WHERE NOT EXISTS (SELECT 1 FROM skipped s WHERE s.database = f.database AND s."table" = f."table"))"""


@query(with_extracts("," + _TABLES + " SELECT * FROM tables", "inherits"))
def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.tables(extract(spark, sf_dir, "classes"), extract(spark, sf_dir, "inherits"))


@query(with_extracts("," + _COLUMNS + " SELECT * FROM columns", "attributes"))
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.columns(extract(spark, sf_dir, "classes"), extract(spark, sf_dir, "attributes"))


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive(with_extracts(""",
    up AS (SELECT i.database, i.inhrelid AS node, i.inhparent AS root, 1 AS depth FROM tree_inherits i
           JOIN tree_classes c ON c.database = i.database AND c.oid = i.inhrelid WHERE c.relispartition
           UNION ALL
           SELECT u.database, u.node, i.inhparent, u.depth + 1 FROM up u
           JOIN tree_classes c ON c.database = u.database AND c.oid = u.root AND c.relispartition
           JOIN tree_inherits i ON i.database = u.database AND i.inhrelid = u.root)
    SELECT u.database, c.nspname || '.' || c.relname AS "table", c.relkind AS kind, t.nspname || '.' || t.relname AS root, u.depth
    FROM (SELECT *, row_number() OVER (PARTITION BY database, node ORDER BY depth DESC) AS place FROM up) u
    JOIN tree_classes c ON c.database = u.database AND c.oid = u.node
    JOIN tree_classes t ON t.database = u.database AND t.oid = u.root WHERE u.place = 1""", "tree_classes", "tree_inherits")))
def catalog_partition_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every partition with the top of its tree, over several levels."""
    return catalog.partition_trees(extract(spark, sf_dir, "tree_classes"), extract(spark, sf_dir, "tree_inherits"))


_PRIVILEGES = """
    grants AS (SELECT m.database, m.member, m.role FROM memberships m
               JOIN role_list r ON r.database = m.database AND r.rolname = m.member
               WHERE coalesce(m.inherit_option, r.rolinherit)),
    held(database, owner) AS (SELECT database, rolname FROM current_roles
        UNION SELECT g.database, g.role FROM held h JOIN grants g ON g.database = h.database AND g.member = h.owner),
    privileges AS (SELECT r.database, r.rolname AS owner, m.rolsuper OR h.owner IS NOT NULL AS is_member,
                          m.rolsuper OR m.rolbypassrls AS bypass_rls
        FROM role_list r
        JOIN current_roles c ON c.database = r.database
        JOIN role_list m ON m.database = c.database AND m.rolname = c.rolname
        LEFT JOIN held h ON h.database = r.database AND h.owner = r.rolname)"""


def _privileges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.role_privileges(*(extract(spark, sf_dir, n) for n in ("role_list", "memberships", "current_roles")))


@query(_recursive(with_extracts("," + _PRIVILEGES + " SELECT * FROM privileges", "role_list", "memberships", "current_roles")))
def catalog_role_privileges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the exporting role is to every role, from grants that go in circles."""
    return _privileges(spark, sf_dir)


@query(_recursive(with_extracts(
    "," + _PRIVILEGES + "," + _FINDINGS.replace("JOIN roles r", "JOIN privileges r") + " SELECT * FROM findings",
    "attributes", "skipped", "role_list", "memberships", "current_roles")))
def catalog_findings_from_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``catalog_findings``, with membership worked out from the grants."""
    return catalog.findings(
        extract(spark, sf_dir, "classes"), extract(spark, sf_dir, "attributes"), _privileges(spark, sf_dir), extract(spark, sf_dir, "skipped")
    )


@query(_recursive(with_extracts(""",
    chain AS (SELECT database, oid, typname, typnamespace, typtype, typcategory, typelem, oid AS cur,
                     typtypmod AS typmod, 0 AS steps FROM types
              UNION ALL
              SELECT c.database, c.oid, c.typname, c.typnamespace, c.typtype, c.typcategory, c.typelem,
                     CASE WHEN t.typtype = 'd' THEN t.typbasetype ELSE t.typelem END,
                     CASE WHEN c.typmod >= 0 THEN c.typmod ELSE n.typtypmod END, c.steps + 1
              FROM chain c JOIN types t ON t.database = c.database AND t.oid = c.cur
              JOIN types n ON n.database = c.database AND n.oid = CASE WHEN t.typtype = 'd' THEN t.typbasetype ELSE t.typelem END
              WHERE t.typtype = 'd' OR t.typcategory = 'A'),
    passed AS (SELECT c.database, c.oid, count(*) FILTER (t.typtype = 'd') AS domains,
                      count(*) FILTER (t.typcategory = 'A') > 0 AS is_array
               FROM chain c JOIN types t ON t.database = c.database AND t.oid = c.cur GROUP BY c.database, c.oid),
    known AS (SELECT c.database, c.oid, c.typname AS own, c.typtype, s.nspname, e.typname, c.typmod, p.domains, p.is_array,
                     CASE WHEN c.typcategory = 'A' THEN c.typelem END AS element
              FROM (SELECT *, row_number() OVER (PARTITION BY database, oid ORDER BY steps DESC) AS place FROM chain) c
              JOIN types e ON e.database = c.database AND e.oid = c.cur
              JOIN passed p ON p.database = c.database AND p.oid = c.oid
              JOIN tree_namespaces s ON s.database = c.database AND s.oid = c.typnamespace WHERE c.place = 1),
    cols AS (SELECT a.database, n.nspname || '.' || r.relname AS "table", a.attnum, a.attname AS "column", k.*,
                    CASE WHEN a.atttypmod >= 0 THEN a.atttypmod ELSE k.typmod END AS modifier,
                    x.typname AS element_name, xs.nspname AS element_schema, x.typtype AS element_kind
             FROM tree_attributes a
             JOIN tree_raw_classes r ON r.database = a.database AND r.oid = a.attrelid
             JOIN tree_namespaces n ON n.database = r.database AND n.oid = r.relnamespace
             JOIN known k ON k.database = a.database AND k.oid = a.atttypid
             LEFT JOIN types x ON x.database = k.database AND x.oid = k.element
             LEFT JOIN tree_namespaces xs ON xs.database = x.database AND xs.oid = x.typnamespace
             WHERE a.attnum > 0 AND NOT a.attisdropped),
    named AS (SELECT *, CASE typname WHEN 'varchar' THEN 'character varying' WHEN 'bpchar' THEN 'character' WHEN 'int4' THEN 'integer'
                        ELSE typname END AS base FROM cols),
    full_name AS (SELECT *, CASE WHEN typname IN ('varchar', 'bpchar') AND modifier > 4 THEN base || '(' || CAST(modifier - 4 AS VARCHAR) || ')'
                        WHEN typname = 'numeric' AND modifier >= 4
                            THEN base || '(' || CAST((modifier - 4) >> 16 AS VARCHAR) || ',' || CAST((modifier - 4) & 65535 AS VARCHAR) || ')'
                        ELSE base END AS whole FROM named)
    SELECT database, "table", attnum, "column", base AS base_type,
           CASE WHEN typtype = 'd' THEN nspname || '.' || own
                WHEN element_kind = 'd' THEN element_schema || '.' || element_name || '[]'
                WHEN element IS NOT NULL THEN whole || '[]' ELSE whole END AS type_name,
           CASE WHEN typname IN ('varchar', 'bpchar') AND modifier > 4 AND NOT is_array THEN modifier - 4 ELSE -1 END AS max_len,
           CAST(domains AS INTEGER) AS domains, is_array
    FROM full_name""", "tree_raw_classes", "tree_attributes", "types")))
def catalog_column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of domains over domains, of arrays of them, and of plain types with modifiers, from raw extracts."""
    names = ("tree_raw_classes", "tree_namespaces", "tree_attributes", "types")
    return catalog.columns_of_types(*(extract(spark, sf_dir, n) for n in names))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("classes", "attributes", "roles", "skipped")
    return catalog.findings(*(extract(spark, sf_dir, n) for n in names))


@query(with_extracts("," + _FINDINGS + " SELECT * FROM findings", "attributes", "roles", "skipped"))
def catalog_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir)


@query(with_extracts("," + _FINDINGS + """
    SELECT database, "table", kind, "column",
           CASE kind WHEN 'no_select' THEN 'grant SELECT (' || "column" || ') on ' || "table" || ' to exporter'
                       || '; or leave it out with ' || "table" || ': { mode: skip }'
                     WHEN 'row_security' THEN 'grant ' || owner || ' to exporter'
                     ELSE 'grant BYPASSRLS, as the policy is forced on owners too; or leave it out with '
                       || "table" || ': { mode: skip }' END AS remedy
    FROM findings""", "attributes", "roles", "skipped"))
def catalog_remedies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.remedies(_findings(spark, sf_dir), "exporter")


@query(with_extracts(
    "," + _FINDINGS + " SELECT DISTINCT database, owner FROM findings WHERE kind = 'row_security'",
    "attributes", "roles", "skipped"))
def catalog_owner_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.owner_roles(_findings(spark, sf_dir))


@query(with_extracts("," + _TABLES + """ SELECT DISTINCT database, "schema" FROM tables WHERE kind = 'r'""", "inherits"))
def catalog_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.tables(extract(spark, sf_dir, "classes"), extract(spark, sf_dir, "inherits"))
    return catalog.schemas(catalog.exportable(found))


@query(with_extracts("," + _TABLES + """
    SELECT * FROM (
        SELECT d.database, CAST(d.version_num // 10000 AS INTEGER) AS major, count(t.oid) AS tables,
               CASE WHEN d.version_num // 10000 < 16 THEN 'unsupported server'
                    WHEN count(t.oid) = 0 THEN 'no tables to export' END AS reason
        FROM databases d LEFT JOIN tables t ON t.database = d.database AND t.kind = 'r'
        GROUP BY d.database, d.version_num)
    WHERE reason IS NOT NULL""", "inherits", "databases"))
def catalog_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.tables(extract(spark, sf_dir, "classes"), extract(spark, sf_dir, "inherits"))
    return catalog.gate(extract(spark, sf_dir, "databases"), catalog.exportable(found))


@query(with_extracts("""
    SELECT w.instance, w.name, count(*) AS wanted_by FROM wanted w
    WHERE NOT EXISTS (SELECT 1 FROM available a WHERE a.instance = w.instance AND a.name = w.name)
    GROUP BY w.instance, w.name""", "wanted", "available"))
def extension_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.extension_gaps(extract(spark, sf_dir, "wanted"), extract(spark, sf_dir, "available"))


@query(with_extracts("," + _TABLES + "," + _COLUMNS + """
    SELECT * FROM (
        SELECT r.database, r."table", r."column",
               CASE WHEN t.kind IS NULL THEN 'no such table' WHEN t.kind = 'p' THEN 'partitioned parent'
                    WHEN c."column" IS NULL THEN 'no such column'
                    WHEN c.generated THEN 'generated column' END AS reason
        FROM fleet_rules r
        LEFT JOIN tables t ON t.database = r.database AND t."table" = r."table"
        LEFT JOIN columns c ON c.database = r.database AND c."table" = r."table" AND c."column" = r."column")
    WHERE reason IS NOT NULL""", "inherits", "attributes", "fleet_rules"))
def rules_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = extract(spark, sf_dir, "classes")
    return stale_rules(
        extract(spark, sf_dir, "fleet_rules"),
        catalog.tables(classes, extract(spark, sf_dir, "inherits")),
        catalog.columns(classes, extract(spark, sf_dir, "attributes")),
    )


@query(with_extracts(f"""
    SELECT oid, nspname || '.' || relname AS "table",
           len(string_split(nspname || '.' || relname, '.')) = 2 AS qualified,
           CASE WHEN regexp_full_match(relname, '[a-z_][a-z0-9_]*') THEN relname
                ELSE '"' || replace(relname, '"', '""') || '"' END AS quoted,
           {_USER} AS user_schema FROM classes""", "classes"))
def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar rules on names, one row per relation."""
    name = F.concat_ws(".", "nspname", "relname")
    return extract(spark, sf_dir, "classes").select(
        "oid", name.alias("table"), names.is_qualified(name).alias("qualified"),
        names.quoted_identifier(F.col("relname")).alias("quoted"),
        names.is_user_schema(F.col("nspname")).alias("user_schema"),
    )


# --- publications -----------------------------------------------------------------------


@query(with_extracts("""
    SELECT p.database, p.pubname,
           concat_ws(', ', CASE WHEN ins THEN 'insert' END, CASE WHEN upd THEN 'update' END,
                     CASE WHEN del THEN 'delete' END, CASE WHEN trunc THEN 'truncate' END) AS publish,
           p.via_root,
           CASE WHEN p.all_tables THEN 'all tables' WHEN s.n > 0 AND t.n > 0 THEN 'schemas and tables'
                WHEN s.n > 0 THEN 'schemas' WHEN t.n > 0 THEN 'tables' ELSE 'empty' END AS form,
           coalesce(s.n, 0) AS schemas, coalesce(t.n, 0) AS tables
    FROM publications p
    LEFT JOIN (SELECT database, pubname, count(*) AS n FROM published_schemas GROUP BY ALL) s
      ON s.database = p.database AND s.pubname = p.pubname
    LEFT JOIN (SELECT database, pubname, count(*) AS n FROM published GROUP BY ALL) t
      ON t.database = p.database AND t.pubname = p.pubname""",
    "publications", "published_schemas", "published"))
def publication_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publications.describe(
        extract(spark, sf_dir, "publications"), extract(spark, sf_dir, "published_schemas"),
        published_tables(spark, sf_dir),
    )


@query(with_extracts("""
    SELECT p.database, p.pubname, c.nspname || '.' || c.relname AS "table",
           CASE WHEN p.a1 <> p.a2 THEN
             (SELECT attname FROM attributes a WHERE a.database = p.database AND a.attrelid = p.oid AND a.attnum = p.a2)
             || ',' ||
             (SELECT attname FROM attributes a WHERE a.database = p.database AND a.attrelid = p.oid AND a.attnum = p.a1)
           ELSE '' END AS columns,
           coalesce(p.rowfilter, '') AS row_filter
    FROM published p JOIN classes c ON c.database = p.database AND c.oid = p.oid""",
    "attributes", "published"))
def publication_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = publications.published_columns(
        extract(spark, sf_dir, "classes"), extract(spark, sf_dir, "attributes"),
        published_tables(spark, sf_dir),
    )
    return found.withColumn("columns", F.array_join("columns", ","))


_DRIFT = f"""
    listed AS (SELECT p.database, p.pubname FROM publications p WHERE NOT p.all_tables AND NOT EXISTS
        (SELECT 1 FROM published_schemas s WHERE s.database = p.database AND s.pubname = p.pubname)),
    publishable AS (SELECT database, oid, nspname, relname FROM classes
        WHERE relkind IN ('r', 'p') AND NOT relispartition AND {_USER})"""


@query(with_extracts("," + _DRIFT + """
    SELECT l.database, l.pubname, count(t.oid) AS tables, count(m.oid) AS covered,
           count(t.oid) - count(m.oid) AS missing
    FROM listed l
    LEFT JOIN publishable t ON t.database = l.database
    LEFT JOIN published m ON m.database = l.database AND m.pubname = l.pubname AND m.oid = t.oid
    GROUP BY l.database, l.pubname""", "publications", "published_schemas", "published"))
def publication_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir)


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publications.coverage(
        extract(spark, sf_dir, "classes"), extract(spark, sf_dir, "publications"),
        extract(spark, sf_dir, "published_schemas"), published_tables(spark, sf_dir),
    )


@query(with_extracts("," + _DRIFT + """,
    per AS (SELECT database, count(*) AS enumerated FROM listed GROUP BY database),
    named AS (SELECT m.database, m.oid, count(DISTINCT m.pubname) AS named FROM published m
              JOIN listed l ON l.database = m.database AND l.pubname = m.pubname GROUP BY m.database, m.oid)
    SELECT t.database, p.enumerated, coalesce(n.named, 0) AS named,
           CASE WHEN regexp_full_match(t.nspname, '[a-z_][a-z0-9_]*') THEN t.nspname
                ELSE '"' || replace(t.nspname, '"', '""') || '"' END || '.' ||
           CASE WHEN regexp_full_match(t.relname, '[a-z_][a-z0-9_]*') THEN t.relname
                ELSE '"' || replace(t.relname, '"', '""') || '"' END AS "table"
    FROM publishable t JOIN per p ON p.database = t.database
    LEFT JOIN named n ON n.database = t.database AND n.oid = t.oid""",
    "publications", "published_schemas", "published"))
def publication_missing_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every table, how many enumerated publications its database has and how many of them name it."""
    return publications.unpublished(
        extract(spark, sf_dir, "classes"), extract(spark, sf_dir, "publications"),
        extract(spark, sf_dir, "published_schemas"), published_tables(spark, sf_dir),
    )


@query(with_extracts("," + _DRIFT + """,
    gaps AS (SELECT l.database, l.pubname, t.oid FROM listed l JOIN publishable t ON t.database = l.database
             WHERE NOT EXISTS (SELECT 1 FROM published m WHERE m.database = l.database AND m.pubname = l.pubname AND m.oid = t.oid)),
    placed AS (SELECT database, oid, (row_number() OVER (PARTITION BY database ORDER BY nspname, relname) - 1) // 4096 AS part,
           row_number() OVER (PARTITION BY database ORDER BY nspname, relname) AS place,
           CASE WHEN regexp_full_match(nspname, '[a-z_][a-z0-9_]*') THEN nspname
                ELSE '"' || replace(nspname, '"', '""') || '"' END || '.' ||
           CASE WHEN regexp_full_match(relname, '[a-z_][a-z0-9_]*') THEN relname
                ELSE '"' || replace(relname, '"', '""') || '"' END AS name FROM publishable)
    SELECT g.database, g.pubname, CAST(p.part AS INTEGER) AS part, count(*) AS missing, string_agg(p.name, ',' ORDER BY p.place) AS tables
    FROM gaps g JOIN placed p ON p.database = g.database AND p.oid = g.oid GROUP BY g.database, g.pubname, p.part""",
    "publications", "published_schemas", "published"))
def publication_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that each enumerated publication misses, in order."""
    found = publications.gaps(
        extract(spark, sf_dir, "classes"), extract(spark, sf_dir, "publications"),
        extract(spark, sf_dir, "published_schemas"), published_tables(spark, sf_dir),
    )
    size = F.size("tables").cast("bigint").alias("missing")
    return found.select("database", "pubname", "part", size, F.array_join("tables", ",").alias("tables"))


@query(with_extracts("""
    SELECT DISTINCT p.database, p.pubname, o.relowner AS owner FROM published p
    JOIN classes c ON c.database = p.database AND c.oid = p.oid
    JOIN classes o ON o.database = c.database AND o.nspname = c.nspname AND o.relkind IN ('r', 'p')
    UNION
    SELECT DISTINCT p.database, p.pubname, d.owner FROM published p
    JOIN database_owners d ON d.database = p.database""", "published", "database_owners"))
def publication_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publications.publication_owners(
        extract(spark, sf_dir, "classes"), published_tables(spark, sf_dir),
        extract(spark, sf_dir, "database_owners"),
    )
