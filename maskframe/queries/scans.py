"""Scans, scrub transforms and filters over the given tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits
from ..operators.load import leaf_counts
from ..operators.reports import union_all
from ..operators.scrub import scrub
from ..plans.config import ScrubConfig
from ..sources.tables import pinned_files, read_parent
from ..workspace import new_folder
from .base import SALT, open_tables, query, rules, spec_of, table

_NO_RULES = ScrubConfig()


@query("SELECT * FROM orders")
def scan_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return scrub(orders, spec_of(orders, "orders"), _NO_RULES, SALT)


@query("""
    SELECT 'public.events_' || event_type AS "table", count(*) AS "rows" FROM events GROUP BY event_type
    UNION ALL SELECT 'public.events', count(*) FROM events""")
def scan_leaf_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a partitioned table: one leaf per type, read once, whatever the number of leaves."""
    folder = new_folder(spark, "leaves")
    events = table(spark, sf_dir, "events")
    events.withColumn("leaf", F.col("event_type")).write.partitionBy("leaf").parquet(folder)
    return leaf_counts(spark.read.parquet(folder), "leaf", "public.events")


@query("SELECT event_id, user_id, event_type, value FROM events")
def scan_partition_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events below a parent of three levels, by type and then by user."""
    folder = new_folder(spark, "tree")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    kind, half = F.col("event_type").alias("kind"), (F.col("user_id") % 2).alias("half")
    events.select("*", kind, half).write.partitionBy("kind", "half").parquet(folder)
    root = spec_of(events, "events")
    specs, frames = [replace(root, kind="partitioned")], {}
    whole = spark.read.parquet(folder)
    for kind_, half_ in whole.select("kind", "half").distinct().collect():  # one row for each leaf that the catalog would list
        middle, leaf = f"events_{kind_}", f"events_{kind_}_{half_}"
        if all(s.name != middle for s in specs):
            specs.append(replace(root, name=middle, kind="partitioned", parent=root.qualified))
        specs.append(replace(root, name=leaf, parent=f"{root.schema}.{middle}"))
        frames[f"{root.schema}.{leaf}"] = whole.where((F.col("kind") == kind_) & (F.col("half") == half_)).drop("kind", "half")
    return read_parent(frames, specs, root.qualified)


@query("""
    SELECT 'public.orders' AS "table", count(*) AS "rows" FROM orders
    UNION ALL SELECT 'public.lineitem', count(*) FROM lineitem""")
def scan_pinned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = open_tables(spark, sf_dir, "orders", "lineitem")
    files = union_all(pinned_files(df, name) for name, df in frames.items())
    return files.groupBy("table").agg(F.sum("rows").alias("rows"))


@query("""
    SELECT s_suppkey, CAST(NULL AS VARCHAR) AS s_name, s_nationkey, s_acctbal FROM supplier""")
def scrub_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier")
    return scrub(df, spec_of(df, "supplier", not_null=["s_suppkey"]), rules("supplier", s_name="null"), SALT)


@query("""
    SELECT c_custkey, md5(c_name || 'grain-of-7') AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def scrub_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return scrub(df, spec_of(df, "customer"), rules("customer", c_name="md5"), SALT)


@query("""
    SELECT event_id, md5(nullif(event_type, 'error') || 'grain-of-7') AS a,
           'REDACTED' AS b, 'user_' || md5(nullif(event_type, 'view') || 'grain-of-7') || '@example.invalid' AS c
    FROM events""")
def scrub_md5_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of NULL are NULL; a redacted NULL is the marker."""
    df = table(spark, sf_dir, "events").selectExpr(
        "event_id", "nullif(event_type, 'error') AS a", "nullif(event_type, 'click') AS b",
        "nullif(event_type, 'view') AS c",
    )
    return scrub(df, spec_of(df, "events"), rules("events", a="md5", b="redact", c="email"), SALT)


@query("""
    SELECT c_custkey, left(md5(c_name || 'grain-of-7'), 20) AS c_name, c_nationkey, c_acctbal, c_mktsegment
    FROM customer""")
def scrub_md5_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    spec = spec_of(df, "customer", max_len={"c_name": 20})
    return scrub(df, spec, rules("customer", c_name="md5"), SALT)


@query("""
    SELECT c_custkey, 'user_' || md5(c_name || 'grain-of-7') || '@example.invalid' AS c_name,
           c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def scrub_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return scrub(df, spec_of(df, "customer"), rules("customer", c_name="email"), SALT)


@query("""
    SELECT c_custkey, 'user_' || left(md5(c_name || 'grain-of-7'), 9) || '@example.invalid' AS c_name,
           c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def scrub_email_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    spec = spec_of(df, "customer", max_len={"c_name": 30})
    return scrub(df, spec, rules("customer", c_name="Email"), SALT)


@query("""
    SELECT p_partkey, 'REDACTED' AS p_name, p_brand, p_type, p_size, p_retailprice FROM part""")
def scrub_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    return scrub(df, spec_of(df, "part"), rules("part", p_name="redact"), SALT)


@query("""
    SELECT p_partkey, 'REDA' AS p_name, p_brand, p_type, p_size, p_retailprice FROM part""")
def scrub_redact_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    spec = spec_of(df, "part", max_len={"p_name": 4})
    return scrub(df, spec, rules("part", p_name="redact"), SALT)


@query("""
    SELECT o_orderkey, md5(CAST(o_custkey AS VARCHAR) || 'grain-of-7') AS o_custkey,
           'old ' || o_orderstatus AS o_orderstatus, floor(o_totalprice / 1000) * 1000 AS o_totalprice,
           o_orderdate, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'n/a' END AS o_orderpriority
    FROM orders""")
def scrub_raw_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL rules see raw values of every column, also of those that are scrubbed themselves."""
    df = table(spark, sf_dir, "orders")
    cfg = rules(
        "orders",
        o_custkey="md5(cast(o_custkey AS string) || :salt)",
        o_orderstatus="'old ' || o_orderstatus",
        o_totalprice="floor(o_totalprice / 1000) * 1000.0D",
        o_orderpriority="CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'n/a' END",
    )
    return scrub(df, spec_of(df, "orders"), cfg, SALT)


@query("""
    SELECT c_custkey, md5(c_name || 'grain-of-7') AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def scrub_excludes_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = "c_name || ' <' || c_mktsegment || '>'"
    df = table(spark, sf_dir, "customer").withColumn("display", F.expr(made))
    spec = spec_of(df, "customer", generated={"display": made}, identity=["c_custkey"])
    return scrub(df, spec, rules("customer", c_name="md5"), SALT)


@query("""
    SELECT c_mktsegment, count(*) AS n_orders, CAST(round(sum(o_totalprice), 0) AS BIGINT) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def scrub_join_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables scrubbed apart join on the scrubbed key as they do on the raw one."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    hashed = "md5(cast({} AS string) || :salt)"
    orders = scrub(orders, spec_of(orders, "orders"), rules("orders", o_custkey=hashed.format("o_custkey")), SALT)
    customer = scrub(
        customer, spec_of(customer, "customer"),
        rules("customer", c_custkey=hashed.format("c_custkey"), c_name="md5"), SALT,
    )
    # A customer with very many orders is one row per task before the join.
    per_customer = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(20,2)")).alias("total")
    )
    joined = per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(
        F.sum("n").alias("n_orders"), F.round(F.sum("total"), 0).cast("bigint").alias("total")
    )


@query("""
    SELECT doc_id, repeat('*', CAST(length(text) AS INTEGER)) AS text, lang,
           md5(source || 'grain-of-7') AS source, n_chars
    FROM documents WHERE lang <> 'en'""")
def scrub_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    cfg = rules(
        "documents", where="lang <> 'en'", text="repeat('*', length(text))", source="md5"
    )
    return scrub(df, spec_of(df, "documents"), cfg, SALT)


@query("""
    SELECT md5(role || 'grain-of-7') AS role, conv_id, turn, 'user_' || md5(text || 'grain-of-7') || '@example.invalid' AS text
    FROM conversations""")
def scrub_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts are hashed, however long."""
    df = table(spark, sf_dir, "conversations")
    return scrub(df, spec_of(df, "conversations"), rules("conversations", role="md5", text="email"), SALT)


@query("""
    SELECT vec_id, embedding, CAST(NULL AS INTEGER) AS label FROM embeddings""")
def scrub_arrays_pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return scrub(df, spec_of(df, "embeddings"), rules("embeddings", label="NULL"), SALT)


@query("SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL '20 days'")
def filter_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    where = "ts > timestamp_ntz '2024-01-30 00:00:00' - interval '20 days'"
    return scrub(df, spec_of(df, "events"), rules("events", where=where), SALT)


@query("""
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, 'REDACTED' AS c_mktsegment
    FROM customer WHERE c_mktsegment = 'BUILDING'""")
def filter_before_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    cfg = rules("customer", where="c_mktsegment = 'BUILDING'", c_mktsegment="redact")
    return scrub(df, spec_of(df, "customer"), cfg, SALT)


@query("""
    SELECT 'public.orders' AS "table", count(*) AS recorded, count(*) AS source_rows,
           count(*) FILTER (o_orderdate >= DATE '1999-01-01') AS kept,
           count(*) FILTER (NOT o_orderdate >= DATE '1999-01-01') AS removed,
           count(*) FILTER (o_orderdate >= DATE '1999-01-01') AS exported, true AS complete FROM orders
    UNION ALL
    SELECT 'public.lineitem', count(*), count(*), count(*), 0, count(*), true FROM lineitem
    UNION ALL
    SELECT 'public.customer', count(*), count(*) FILTER (c_acctbal >= 0), count(*) FILTER (c_acctbal >= 0), 0,
           count(*) FILTER (c_acctbal >= 0), count(*) = count(*) FILTER (c_acctbal >= 0) FROM customer""")
def audit_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts beside those of the pinned files; customer is read short, as a policy on its rows would have it."""
    frames = open_tables(spark, sf_dir, "orders", "lineitem", "customer")
    orders, lineitem = frames["public.orders"], frames["public.lineitem"]
    recorded = {n: pinned_files(df, n) for n, df in frames.items()}
    short = frames["public.customer"].filter("c_acctbal >= 0")
    where = "o_orderdate >= date '1999-01-01'"
    kept = scrub(orders, spec_of(orders, "orders"), rules("orders", where=where), SALT)
    folder = new_folder(spark, "kept")
    kept.write.parquet(folder)
    return audits.audit_completeness(
        orders, "public.orders", where, spark.read.parquet(folder), recorded["public.orders"]
    ).unionByName(
        audits.audit_completeness(lineitem, "public.lineitem", recorded=recorded["public.lineitem"])
    ).unionByName(audits.audit_completeness(short, "public.customer", recorded=recorded["public.customer"]))


@query("""
    SELECT event_id, ts, user_id, event_type, value, props FROM events
    WHERE now()::TIMESTAMP - ((SELECT max(ts) FROM events) - ts) > now()::TIMESTAMP - INTERVAL '10 days'""")
def filter_relative_to_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual filter on age: the newest event is taken to be of this moment, and a third of them are young enough."""
    df = table(spark, sf_dir, "events")
    newest = df.agg(F.max("ts").cast("string").alias("newest")).first()["newest"]
    aged = df.withColumn("seen_at", F.expr(f"now() - (TIMESTAMP_NTZ '{newest}' - ts)"))
    kept = scrub(aged, spec_of(aged, "events"), rules("events", where="seen_at > now() - interval '10 days'"), SALT)
    return kept.drop("seen_at")
