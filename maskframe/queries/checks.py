"""Constraint and scrub-quality checks over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits, leaks, profile
from ..operators.reports import union_all
from ..operators.scrub import scrub
from ..plans.specs import ForeignKey
from .base import SALT, open_tables, query, rules, spec_of, table

_RECENT = "o_orderdate >= date '1999-01-01'"
_ORDER_KEY = ForeignKey(("l_orderkey",), "public.orders", ("o_orderkey",))


def _filtered_orders(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Filtering a parent orphans its children: the case the rule set's fk_mode is for."""
    frames = open_tables(spark, sf_dir, "orders", "lineitem")
    orders = frames["public.orders"]
    frames["public.orders"] = scrub(orders, spec_of(orders, "orders"), rules("orders", where=_RECENT), SALT)
    return frames


@query("""
    SELECT 'public.events' AS "table", 'not_null' AS "check", 'event_id' AS subject,
           CAST(0 AS BIGINT) AS violations, 'error' AS severity
    UNION ALL SELECT 'public.events', 'not_null', 'event_type', count(*), 'error'
    FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'public.events', 'not_null', 'value', count(*), 'error' FROM events WHERE value < 10""")
def audit_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").selectExpr(
        "event_id", "nullif(event_type, 'error') AS event_type", "CASE WHEN value >= 10 THEN value END AS value"
    )
    return audits.audit_not_null(df, spec_of(df, "events", not_null=df.columns))


@query("""
    SELECT 'public.lineitem' AS "table", 'unique' AS "check", 'l_orderkey,l_linenumber' AS subject,
           (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber
                                  HAVING count(*) > 1)) AS violations, 'error' AS severity
    UNION ALL
    SELECT 'public.orders', 'unique', 'o_orderkey',
           (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)), 'error'""")
def audit_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = open_tables(spark, sf_dir, "orders", "lineitem")
    lineitem = spec_of(frames["public.lineitem"], "lineitem", unique=[["l_orderkey", "l_linenumber"]])
    orders = spec_of(frames["public.orders"], "orders", unique=[["o_orderkey"]])
    return union_all(audits.audit_unique(frames[s.qualified], s) for s in (lineitem, orders))


@query("""
    SELECT l_orderkey, l_linenumber, count(*) AS "rows" FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def audit_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
    SELECT 'public.lineitem' AS "table", 'check' AS "check", 'discount_below_tax' AS subject,
           (SELECT count(*) FROM lineitem WHERE NOT (l_discount < l_tax)) AS violations, 'error' AS severity
    UNION ALL
    SELECT 'public.lineitem', 'check', 'quantity_when_returned',
           (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND NOT (l_quantity > 10)), 'error'""")
def audit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second check is NULL unless a line was returned, and NULL passes."""
    df = table(spark, sf_dir, "lineitem")
    checks = {
        "discount_below_tax": "l_discount < l_tax",
        "quantity_when_returned": "CASE WHEN l_returnflag = 'R' THEN l_quantity > 10 END",
    }
    return audits.audit_check(df, spec_of(df, "lineitem", checks=checks))


@query("""
    SELECT 'public.documents' AS "table", 'max_len' AS "check", 'text' AS subject,
           (SELECT count(*) FROM documents WHERE length(text) > 500) AS violations, 'error' AS severity
    UNION ALL
    SELECT 'public.documents', 'max_len', 'source',
           (SELECT count(*) FROM documents WHERE length(source) > 4), 'error'""")
def audit_max_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return audits.audit_max_len(df, spec_of(df, "documents", max_len={"text": 500, "source": 4}))


@query("""
    SELECT l_orderkey, count(*) AS "rows" FROM lineitem l
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey
                      AND o.o_orderdate >= DATE '1999-01-01')
    GROUP BY l_orderkey""")
def audit_fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _filtered_orders(spark, sf_dir)
    return audits.fk_orphans(frames["public.lineitem"], frames["public.orders"], _ORDER_KEY)


@query("""
    SELECT 'public.lineitem' AS "table", 'foreign_key' AS "check", 'l_orderkey->public.orders' AS subject,
           (SELECT count(*) FROM lineitem l WHERE NOT EXISTS
              (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey
               AND o.o_orderdate >= DATE '1999-01-01')) AS violations, 'warn' AS severity
    UNION ALL
    SELECT 'public.orders', 'foreign_key', 'o_custkey->public.customer',
           (SELECT count(*) FROM orders o WHERE o.o_orderdate >= DATE '1999-01-01' AND NOT EXISTS
              (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)), 'warn'""")
def audit_fk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _filtered_orders(spark, sf_dir) | open_tables(spark, sf_dir, "customer")
    customer_key = ForeignKey(("o_custkey",), "public.customer", ("c_custkey",))
    lineitem = spec_of(frames["public.lineitem"], "lineitem", foreign_keys=[_ORDER_KEY])
    orders = spec_of(frames["public.orders"], "orders", foreign_keys=[customer_key])
    return union_all(audits.audit_fk(s, frames, "not_valid") for s in (lineitem, orders))


@query("""
    SELECT 'public.customer' AS "table", 'leak' AS "check", 'c_name' AS subject,
           CAST(0 AS BIGINT) AS violations, 'error' AS severity
    UNION ALL
    SELECT 'public.customer', 'leak', 'c_mktsegment', count(*), 'error' FROM customer WHERE c_acctbal < 0""")
def audit_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column scrubbed well, one by a rule that lets some raw values through."""
    df = table(spark, sf_dir, "customer")
    half = "CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE md5(c_mktsegment || :salt) END"
    scrubbed = scrub(df, spec_of(df, "customer"), rules("customer", c_name="email", c_mktsegment=half), SALT)
    return audits.audit_leak(df, scrubbed, ["c_name", "c_mktsegment"], "public.customer")


@query("""
    SELECT 'public.documents' AS "table", 'leak' AS "check", 'text' AS subject,
           (SELECT count(*) FROM documents WHERE lang = 'de') AS violations, 'error' AS severity""")
def audit_leak_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    rule = "CASE WHEN lang = 'de' THEN text ELSE md5(text || :salt) END"
    scrubbed = scrub(df, spec_of(df, "documents"), rules("documents", text=rule), SALT)
    return audits.audit_leak(df, scrubbed, ["text"], "public.documents")


@query("""
    WITH v AS (SELECT 'public.customer.c_name' AS source, c_name AS v FROM customer
               UNION SELECT 'public.supplier.s_name', s_name FROM supplier
               UNION SELECT 'public.benchmark.text', text FROM benchmark),
    t(target, id, text) AS (
        SELECT 'public.customer.c_name', c_custkey, md5(c_name || 'grain-of-7') FROM customer
        UNION ALL SELECT 'public.customer.c_mktsegment', c_custkey,
            CASE WHEN c_acctbal < 0 THEN 'seen: ' || c_name || ', ' || c_mktsegment ELSE c_mktsegment END FROM customer
        UNION ALL SELECT 'public.supplier.s_name', s_suppkey, md5(s_name || 'grain-of-7') FROM supplier
        UNION ALL SELECT 'public.documents.text', doc_id, text FROM documents
        UNION ALL SELECT 'public.documents.lang', doc_id, lang FROM documents
        UNION ALL SELECT 'public.documents.source', doc_id, NULL FROM documents),
    f AS (SELECT source, target, v, id FROM v JOIN t ON v <> '' AND contains(t.text, v.v)),
    p AS (SELECT s.source, t.target FROM (SELECT DISTINCT source FROM v) s, (SELECT DISTINCT target FROM t) t)
    SELECT p.source, p.target, count(DISTINCT f.v) AS leaked_values, count(DISTINCT f.id) AS leaked_rows
    FROM p LEFT JOIN f ON f.source = p.source AND f.target = p.target GROUP BY p.source, p.target""")
def audit_leak_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a rule moves into another column, and passages that stay inside documents."""
    raw = open_tables(spark, sf_dir, "customer", "supplier", "documents", "benchmark")
    moved = "CASE WHEN c_acctbal < 0 THEN 'seen: ' || c_name || ', ' || c_mktsegment ELSE c_mktsegment END"
    cfgs = {
        "customer": rules("customer", c_name="md5", c_mktsegment=moved),
        "supplier": rules("supplier", s_name="md5"),
        "documents": rules("documents", source="null"),
    }
    scrubbed = {f"public.{n}": scrub(raw[f"public.{n}"], spec_of(raw[f"public.{n}"], n), cfg, SALT) for n, cfg in cfgs.items()}
    protected = {"public.customer": ["c_name"], "public.supplier": ["s_name"], "public.benchmark": ["text"]}
    return leaks.audit_leak_anywhere(raw, protected, scrubbed)


@query("""
    SELECT 'public.customer' AS "table", 'distinct_preserved' AS "check", 'c_name' AS subject,
           CAST(0 AS BIGINT) AS violations, 'error' AS severity
    UNION ALL
    SELECT 'public.customer', 'distinct_preserved', 'c_mktsegment',
           (SELECT count(DISTINCT c_mktsegment) - count(DISTINCT left(md5(c_mktsegment || 'grain-of-7'), 1))
            FROM customer), 'error'""")
def audit_distinct_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash cut to one digit may collide; a full one keeps values apart."""
    df = table(spark, sf_dir, "customer")
    spec = spec_of(df, "customer", max_len={"c_mktsegment": 1})
    scrubbed = scrub(df, spec, rules("customer", c_name="md5", c_mktsegment="md5"), SALT)
    return audits.audit_distinct_preserved(df, scrubbed, ["c_name", "c_mktsegment"], "public.customer")


def _profile_sql(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT 'public.{name}' AS "table", '{c}' AS "column", count(*) AS "rows",
            count(*) - count({c}) AS nulls, regexp_replace(CAST(min({c}) AS VARCHAR), '^-0\\.0$', '0.0') AS min_value,
            regexp_replace(CAST(max({c}) AS VARCHAR), '^-0\\.0$', '0.0') AS max_value FROM {name}"""
        for c in columns
    )


@query(
    _profile_sql("lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ])
    + " UNION ALL " + _profile_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"])
)
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    documents = table(spark, sf_dir, "documents")
    return profile.table_profile(lineitem, "public.lineitem", distinct=False).unionByName(
        profile.table_profile(documents, "public.documents", distinct=False)
    )


_COUNTED = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "events": ["event_id", "user_id", "event_type", "value"],
}


@query(" UNION ALL ".join(
    f"""SELECT 'public.{t}' AS "table", '{c}' AS "column", count(*) AS "rows", count(DISTINCT {c}) AS exact,
        true AS near FROM {t}""" for t, names in _COUNTED.items() for c in names))
def table_profile_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct counts beside exact ones: within three times the stated error of 5 %."""
    found = []
    for name, columns in _COUNTED.items():
        df = table(spark, sf_dir, name).select(*columns)
        exact = audits.column_values(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("exact"))
        found.append(profile.table_profile(df, f"public.{name}").join(exact, "column"))
    off = F.abs(F.col("approx_distinct") - F.col("exact"))
    return union_all(found).select("table", "column", "rows", "exact", (off <= F.col("exact") * 0.15 + 1).alias("near"))


_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


_ARRAYS = {"embedding"}  # without a smallest and a largest value


def _distinct_sql(name: str, column: str) -> str:
    plain = _profile_sql(name, [column]) if column not in _ARRAYS else f"""
        SELECT 'public.{name}' AS "table", '{column}' AS "column", count(*) AS "rows", count(*) - count({column}) AS nulls,
            CAST(NULL AS VARCHAR) AS min_value, CAST(NULL AS VARCHAR) AS max_value FROM {name}"""
    return f"SELECT p.*, (SELECT count(DISTINCT {column}) FROM {name}) AS exact, true AS near FROM ({plain}) p"


@query(" UNION ALL ".join(_distinct_sql(t, c) for t, names in _COLUMNS.items() for c in names))
def table_profile_distinct_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``table_profile`` and ``table_profile_distinct``, over all columns of all tables."""
    found = []
    for name, df in open_tables(spark, sf_dir).items():
        exact = audits.column_values(df, df.columns).groupBy("column").agg(F.count(F.lit(1)).alias("exact"))
        found.append(profile.table_profile(df, name).join(exact, "column", "left").fillna(0, ["exact"]))
    off = F.abs(F.col("approx_distinct") - F.col("exact"))
    near = (off <= F.col("exact") * 0.15 + 1).alias("near")
    return union_all(found).select("table", "column", "rows", "nulls", "min_value", "max_value", "exact", near)
