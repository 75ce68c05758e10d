"""Catalogs, registries and rule sets of a fleet, derived from the given tables.

The texts run unchanged on Spark and on the checking engine, so both sides start
from the same frames and differ in the operator under test. Every frame grows
with the table it is made from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import TABLES, table


def stamp(ts: str) -> str:
    """A timestamp as text like 20240131T235959Z."""
    text = f"substr(CAST({ts} AS STRING), 1, 19)"
    return f"replace(replace(replace({text}, '-', ''), ':', ''), ' ', 'T') || 'Z'"


EXTRACTS: dict[str, str] = {
    "classes": """
        SELECT 'db_' || CAST(p_size AS STRING) AS database, p_partkey AS oid,
               CASE p_type WHEN 'PROMO' THEN 'pg_toast' WHEN 'SMALL' THEN 'information_schema'
                    ELSE lower(p_type) END AS nspname,
               CASE p_type WHEN 'MEDIUM' THEN replace(p_name, ' ', '_') ELSE p_name END
                   || '_' || CAST(p_partkey AS STRING) AS relname,
               CASE p_brand WHEN 'Brand#1' THEN 'p' WHEN 'Brand#2' THEN 'v' ELSE 'r' END AS relkind,
               'owner_' || lower(replace(p_brand, '#', '')) AS relowner,
               p_brand IN ('Brand#3', 'Brand#4') AS relispartition,
               p_brand IN ('Brand#5', 'Brand#6', 'Brand#7', 'Brand#8', 'Brand#10', 'Brand#11',
                           'Brand#12') AS relrowsecurity,
               p_brand IN ('Brand#7', 'Brand#8', 'Brand#9') AS relforcerowsecurity
        FROM {part}""",
    "namespaces": """
        SELECT database, min(oid) AS oid, nspname FROM {classes} GROUP BY database, nspname""",
    "raw_classes": """
        SELECT c.database, c.oid, c.relname, n.oid AS relnamespace, c.relkind
        FROM {classes} c JOIN {namespaces} n ON n.database = c.database AND n.nspname = c.nspname
        UNION ALL
        SELECT c.database, 1000000000 + c.oid, c.relname || '_seq', n.oid, 'S'
        FROM {classes} c JOIN {namespaces} n ON n.database = c.database AND n.nspname = c.nspname""",
    "depends": """
        SELECT c.database, 1000000000 + c.oid AS objid, c.oid AS refobjid,
               CASE c.relkind WHEN 'v' THEN 0 ELSE 1 + length(c.nspname) - 4 END AS refobjsubid,
               CASE WHEN c.relforcerowsecurity THEN 'n' WHEN c.relispartition THEN 'i' ELSE 'a' END AS deptype
        FROM {classes} c WHERE c.relowner <> 'owner_brand13'""",
    "inherits": """
        SELECT c.database, c.oid AS inhrelid, p.parent AS inhparent
        FROM {classes} c
        JOIN (SELECT database, min(oid) AS parent FROM {classes} WHERE relkind = 'p'
              GROUP BY database) p ON c.database = p.database
        WHERE c.relispartition OR c.relowner = 'owner_brand10'""",
    "attributes": """
        SELECT c.database, a.attrelid, a.attnum, 'c' || CAST(a.attnum AS STRING) AS attname,
               CASE WHEN a.high >= 45 THEN 'varchar' WHEN a.high >= 38 THEN 'bpchar'
                    WHEN a.high >= 25 THEN 'text' ELSE 'int4' END AS typname,
               CASE WHEN a.high >= 38 AND a.low > 3 THEN CAST(a.high AS INT) + 4 ELSE -1 END AS atttypmod,
               CASE WHEN a.flag = 'N' THEN 's' ELSE '' END AS attgenerated,
               CASE WHEN a.attnum = 1 THEN 'd' ELSE '' END AS attidentity,
               a.low >= 5 AS attnotnull, a.discount >= 0.08 AS attisdropped,
               a.low <= 30 AS readable
        FROM (SELECT l_partkey AS attrelid, l_linenumber AS attnum, max(l_quantity) AS high,
                     min(l_quantity) AS low, min(l_returnflag) AS flag, min(l_discount) AS discount
              FROM {lineitem} GROUP BY l_partkey, l_linenumber) a
        JOIN {classes} c ON c.oid = a.attrelid""",
    "roles": """
        SELECT 'db_' || CAST(p_size AS STRING) AS database,
               'owner_' || lower(replace(p_brand, '#', '')) AS owner,
               max(p_type) = 'STANDARD' AS is_member, min(p_type) = 'PROMO' AS bypass_rls
        FROM {part} GROUP BY p_size, p_brand HAVING max(p_type) <> 'MEDIUM'""",
    "databases": """
        SELECT 'db_' || CAST(c_nationkey AS STRING) AS database,
               CASE WHEN min(c_acctbal) < -980 THEN 150004 ELSE 170002 END AS version_num
        FROM {customer} GROUP BY c_nationkey""",
    "database_owners": """
        SELECT 'db_' || CAST(p_size AS STRING) AS database, 'dba_' || lower(max(p_type)) AS owner
        FROM {part} GROUP BY p_size""",
    "fleet_rules": """
        SELECT DISTINCT c.database,
               CASE WHEN l.l_tax >= 0.08 THEN 'public.gone_' || CAST(c.oid AS STRING)
                    ELSE c.nspname || '.' || c.relname END AS "table",
               CASE WHEN l.l_returnflag = 'R' THEN 'x' ELSE 'c' END
                   || CAST(l.l_linenumber AS STRING) AS "column"
        FROM {lineitem} l JOIN {classes} c ON c.oid = l.l_partkey""",
    "skipped": """
        SELECT database, nspname || '.' || relname AS "table" FROM {classes}
        WHERE relowner IN ('owner_brand12', 'owner_brand20')""",
    "wanted": """
        SELECT source AS instance, 'db_' || CAST(doc_id AS STRING) AS database,
               'ext_' || lang || '_' || CAST(length(CAST(n_chars AS STRING)) AS STRING) AS name
        FROM {documents}""",
    "available": """
        SELECT DISTINCT d.source AS instance,
               'ext_' || d.lang || '_' || CAST(length(CAST(d.n_chars AS STRING)) AS STRING) AS name
        FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id WHERE l.quality = 1""",
    "sequence_refs": """
        SELECT 'public' AS "schema", c_name || '_seq' AS name,
               CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN NULL
                    ELSE 'public.orders_' || CAST(c_custkey AS STRING) || '.o_orderkey' END AS owned_by
        FROM {customer}""",
    "sequence_values": """
        SELECT 'public' AS "schema", c_name || '_seq' AS name,
               CASE WHEN c_acctbal < 0 THEN NULL ELSE c_custkey * 10 END AS last_value
        FROM {customer} WHERE c_mktsegment IN ('AUTOMOBILE', 'FURNITURE')""",
    "owned_values": """
        SELECT 'public.orders_' || CAST(o_custkey AS STRING) || '.o_orderkey' AS owned_by,
               o_orderkey AS value
        FROM {orders}""",
    "publications": """
        SELECT 'db_' || CAST(1 + s_nationkey AS STRING) AS database,
               'pub_' || CAST(s_suppkey AS STRING) AS pubname, s_acctbal < 500 AS all_tables,
               s_acctbal < 9000 AS ins, s_acctbal > 1000 AS upd, s_acctbal > 5000 AS del,
               s_acctbal > 8000 AS trunc, s_acctbal > 4000 AS via_root
        FROM {supplier}""",
    "published_schemas": """
        SELECT 'db_' || CAST(1 + s_nationkey AS STRING) AS database,
               'pub_' || CAST(s_suppkey AS STRING) AS pubname, 'economy' AS nspname
        FROM {supplier} WHERE s_acctbal > 7000
        UNION ALL
        SELECT 'db_' || CAST(1 + s_nationkey AS STRING), 'pub_' || CAST(s_suppkey AS STRING), 'large'
        FROM {supplier} WHERE s_acctbal > 8500""",
    "published": """
        SELECT p.database, p.pubname, c.oid, min(l.l_linenumber) AS a1, max(l.l_linenumber) AS a2,
               CASE WHEN max(l.l_quantity) > 30 THEN 'c1 > 5' ELSE NULL END AS rowfilter
        FROM {lineitem} l
        JOIN {publications} p ON p.pubname = 'pub_' || CAST(l.l_suppkey AS STRING)
        JOIN {classes} c ON c.oid = l.l_partkey AND c.database = p.database
        GROUP BY p.database, p.pubname, c.oid""",
    # Trees: every node but the first of a database has the parent a sixth as far along; some hang on by plain inheritance.
    "nodes": """
        SELECT 'db_' || CAST((p_partkey - 1) % 5 AS STRING) AS database, p_partkey AS oid, p_type, p_brand, p_size,
               CAST(floor((p_partkey - 1) / 5) AS BIGINT) AS place,
               CASE WHEN p_partkey > 5
                    THEN CAST(floor((floor((p_partkey - 1) / 5) - 1) / 6) * 5 + (p_partkey - 1) % 5 + 1 AS BIGINT) END AS parent
        FROM {part}""",
    "tree_classes": """
        SELECT n.database, n.oid, lower(n.p_type) AS nspname, 'n' || CAST(n.oid AS STRING) AS relname,
               CASE WHEN (6 * n.place + 1) * 5 < m.most THEN 'p' ELSE 'r' END AS relkind,
               n.parent IS NOT NULL AND n.p_type <> 'PROMO' AS relispartition
        FROM {nodes} n CROSS JOIN (SELECT max(oid) AS most FROM {nodes}) m""",
    "tree_inherits": """
        SELECT database, oid AS inhrelid, parent AS inhparent FROM {nodes} WHERE parent IS NOT NULL""",
    "role_list": """
        SELECT 'db_' || CAST(p_size AS STRING) AS database, 'owner_' || lower(replace(p_brand, '#', '')) AS rolname,
               max(p_type) <> 'ECONOMY' AS rolinherit, false AS rolsuper, false AS rolbypassrls
        FROM {part} GROUP BY p_size, p_brand
        UNION ALL
        SELECT DISTINCT 'db_' || CAST(p_size AS STRING), 'exporter', true, p_size = 7, p_size % 10 = 9 FROM {part}""",
    "memberships": """
        SELECT DISTINCT database, role, member, inherit_option FROM (
            SELECT 'db_' || CAST(p_size AS STRING) AS database, 'owner_' || lower(replace(p_brand, '#', '')) AS member,
                   'owner_brand' || CAST(1 + 2 * CAST(replace(p_brand, 'Brand#', '') AS INT) % 25 AS STRING) AS role,
                   CASE WHEN p_type = 'STANDARD' THEN false WHEN p_type <> 'LARGE' THEN true END AS inherit_option
            FROM {part} WHERE p_retailprice > 1200) m
        UNION ALL
        SELECT DISTINCT 'db_' || CAST(p_size AS STRING), 'owner_' || lower(replace(p_brand, '#', '')), 'exporter', true
        FROM {part} WHERE p_brand IN ('Brand#1', 'Brand#3')""",
    "current_roles": """
        SELECT DISTINCT 'db_' || CAST(p_size AS STRING) AS database, 'exporter' AS rolname FROM {part}""",
    "tree_namespaces": """
        SELECT DISTINCT database, 11 AS oid, 'pg_catalog' AS nspname FROM {nodes}
        UNION ALL SELECT database, min(oid) + 1000, lower(p_type) FROM {nodes} GROUP BY database, p_type""",
    "tree_raw_classes": """
        SELECT c.database, c.oid, c.relname, n.oid AS relnamespace, c.relkind
        FROM {tree_classes} c JOIN {tree_namespaces} n ON n.database = c.database AND n.nspname = c.nspname""",
    "types": """
        SELECT d.database, CAST(t.oid AS BIGINT) AS oid, t.typname, CAST(11 AS BIGINT) AS typnamespace, 'b' AS typtype,
               CAST(0 AS BIGINT) AS typbasetype, -1 AS typtypmod, CAST(t.typelem AS BIGINT) AS typelem, t.typcategory
        FROM (SELECT DISTINCT database FROM {nodes}) d
        CROSS JOIN (VALUES (23, 'int4', 0, 'N'), (25, 'text', 0, 'S'), (1042, 'bpchar', 0, 'S'), (1043, 'varchar', 0, 'S'),
                           (1700, 'numeric', 0, 'N'), (1015, '_varchar', 1043, 'A')) AS t(oid, typname, typelem, typcategory)
        UNION ALL
        SELECT n.database, 500000000 + n.oid, 'dom' || CAST(n.oid AS STRING), s.oid, 'd',
               CASE WHEN n.parent IS NOT NULL AND n.p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 500000000 + n.parent
                    WHEN n.p_size % 5 = 0 THEN 23 WHEN n.p_size % 5 = 1 THEN 1042 WHEN n.p_size % 5 = 2 THEN 1015 ELSE 1043 END,
               CASE WHEN n.p_size > 25 THEN n.p_size + 4 ELSE -1 END, 0, 'U'
        FROM {nodes} n JOIN {tree_namespaces} s ON s.database = n.database AND s.nspname = lower(n.p_type)
        UNION ALL
        SELECT n.database, 600000000 + n.oid, '_dom' || CAST(n.oid AS STRING), s.oid, 'b', 0, -1, 500000000 + n.oid, 'A'
        FROM {nodes} n JOIN {tree_namespaces} s ON s.database = n.database AND s.nspname = lower(n.p_type)""",
    "tree_attributes": """
        SELECT n.database, n.oid AS attrelid, a.attnum, 'c' || CAST(a.attnum AS STRING) AS attname,
               CASE a.attnum WHEN 1 THEN 500000000 + n.oid WHEN 2 THEN 600000000 + n.oid WHEN 3 THEN 1043 WHEN 4 THEN 1700
                             WHEN 5 THEN 1015 ELSE 23 END AS atttypid,
               CASE WHEN a.attnum IN (3, 5) AND n.p_size > 10 THEN n.p_size + 4
                    WHEN a.attnum = 4 THEN 65536 * (10 + n.p_size) + 2 + 4 ELSE -1 END AS atttypmod,
               a.attnum = 6 AND n.p_size % 3 = 0 AS attisdropped
        FROM {nodes} n CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (-1)) AS a(attnum)""",
    "snapshots": f"""
        SELECT 'db_' || CAST(user_id AS STRING) AS database, {stamp("ts")} AS ts,
               event_type <> 'error' AS has_manifest
        FROM {{events}}""",
    "snapshot_columns": """
        SELECT 'db_' || CAST(l_suppkey AS STRING) AS database,
               CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + 1 AS STRING) || 'T000000Z' AS ts,
               'public.t' || CAST(l_linenumber AS STRING) AS "table",
               lower(l_returnflag || l_linestatus) AS "column"
        FROM {lineitem}""",
    "instance_databases": f"""
        SELECT DISTINCT 'core_' || CAST(o_custkey AS STRING) AS target,
               CASE o_orderstatus
                    WHEN 'F' THEN 'core_' || CAST(o_custkey AS STRING)
                    WHEN 'O' THEN 'core_' || CAST(o_custkey AS STRING) || '_backup_' || {stamp("o_orderdate")}
                    ELSE 'restored_' || CAST(o_orderkey AS STRING) END AS name
        FROM {{orders}}""",
    "manifest_headers": """
        SELECT o_orderkey AS id,
               CASE WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 1 END AS artifact_version,
               o_orderstatus <> 'P' AS scrubbed,
               CASE WHEN o_totalprice > 300000 THEN 18 WHEN o_totalprice > 100000 THEN 16 ELSE 14 END
                   AS source_major,
               CASE o_orderpriority WHEN '1-URGENT' THEN 15 WHEN '2-HIGH' THEN 16 ELSE 18 END
                   AS target_major
        FROM {orders}""",
}

# Each extract and the ones it is made from, in an order in which they can be defined.
_MADE_FROM = {
    "namespaces": ["classes"], "raw_classes": ["classes", "namespaces"], "depends": ["classes"],
    "inherits": ["classes"], "attributes": ["classes"], "fleet_rules": ["classes"],
    "skipped": ["classes"], "published": ["classes", "publications"],
    "tree_classes": ["nodes"], "tree_inherits": ["nodes"], "tree_namespaces": ["nodes"],
    "tree_raw_classes": ["nodes", "tree_classes", "tree_namespaces"], "types": ["nodes", "tree_namespaces"],
    "tree_attributes": ["nodes"],
}


def extract(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = EXTRACTS[name].replace('"', "`")
    inputs = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    inputs |= {e: extract(spark, sf_dir, e) for e in _MADE_FROM.get(name, ())}
    return spark.sql(text, **inputs)


def published_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the column numbers as the array a catalog holds; none means every column."""
    found = extract(spark, sf_dir, "published")
    listed = F.when(F.col("a1") != F.col("a2"), F.array("a2", "a1"))
    return found.select("database", "pubname", "oid", listed.alias("attnums"), "rowfilter")


def with_extracts(sql: str, *names: str) -> str:
    """SQL for the checking engine with the extracts in front."""
    needed: list[str] = []
    for n in names:
        needed += [d for d in [*_MADE_FROM.get(n, ()), n] if d not in needed]
    same = {t: t for t in (*TABLES, *EXTRACTS)}
    parts = [f"{n} AS ({EXTRACTS[n].format(**same)})" for n in needed]
    return "WITH " + ",\n".join(parts) + "\n" + sql
