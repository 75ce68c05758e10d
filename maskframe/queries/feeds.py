"""Change feeds and streams over the given events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.publications import PublicationSpec, PublishedTable, apply_publication
from ..streaming.feeds import read_folder, scrub_stream, write_folder
from ..workspace import new_folder
from .base import SALT, query, rules, spec_of, table

# How a type of event is read as a change.
_OPERATION = {
    "click": "insert", "signup": "insert", "purchase": "update", "error": "delete", "view": "truncate",
}
_LEAVES = {f"public.events_{t}": "public.events" for t in _OPERATION}


def _operation() -> Column:
    pairs = [F.lit(x) for kv in _OPERATION.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.col("event_type"))


_OPERATION_SQL = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in _OPERATION.items()
) + " END"


@query(f"""
    SELECT 'public.events' AS relation, {_OPERATION_SQL} AS op, event_id, user_id, value FROM events
    WHERE {_OPERATION_SQL} IN ('insert', 'update') AND value > 10""")
def publication_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of leaf partitions, published under the root: operations, row filter, columns."""
    changes = table(spark, sf_dir, "events").select(
        F.concat(F.lit("public.events_"), "event_type").alias("relation"), _operation().alias("op"), "*"
    )
    spec = PublicationSpec(
        "changes", ("insert", "update"),
        {"public.events": PublishedTable(("event_id", "user_id", "value"), "value > 10")}, roots=_LEAVES,
    )
    return apply_publication(changes, spec, "public.events")


_IMAGES = f"""
    WITH c AS (SELECT event_id, {_OPERATION_SQL} AS op, value AS old,
                      CASE WHEN user_id < 75 THEN value - 20 ELSE value + 20 END AS new FROM events),
    m AS (SELECT *, old > 20 AS was, new > 20 AS now FROM c)
    SELECT 'public.events' AS relation, 'insert' AS op, event_id, new AS value FROM m
    WHERE now AND (op = 'insert' OR (op = 'update' AND NOT was))
    UNION ALL
    SELECT 'public.events', 'update', event_id, new FROM m WHERE op = 'update' AND was AND now
    UNION ALL
    SELECT 'public.events', 'delete', event_id, old FROM m
    WHERE was AND (op = 'delete' OR (op = 'update' AND NOT now))"""


@query(_IMAGES)
def publication_apply_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that cross the row filter arrive as inserts or deletes."""
    row = "named_struct('event_id', event_id, 'value', {})"
    changes = table(spark, sf_dir, "events").select(
        F.lit("public.events").alias("relation"), _operation().alias("op"),
        F.expr(row.format("value")).alias("before"),
        F.expr(row.format("CASE WHEN user_id < 75 THEN value - 20 ELSE value + 20 END")).alias("after"),
    )
    spec = PublicationSpec(
        "changes", ("insert", "update", "delete"),
        {"public.events": PublishedTable(("event_id", "value"), "value > 20")},
    )
    return apply_publication(changes, spec, "public.events", images=True)


@query("""
    SELECT event_id, ts, CAST(NULL AS BIGINT) AS user_id, event_type, value,
           md5(props || 'grain-of-7') AS props
    FROM events WHERE value > 5""")
def stream_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch scrub on a stream of files, read back from its sink."""
    source, sink = new_folder(spark, "events"), new_folder(spark, "scrubbed")
    events = table(spark, sf_dir, "events")
    events.write.parquet(source)
    cfg = rules("events", where="value > 5", user_id="null", props="md5")
    stream = read_folder(spark, source, events.schema)
    running = write_folder(scrub_stream(stream, spec_of(events, "events"), cfg, SALT), sink)
    running.awaitTermination()
    return spark.read.parquet(sink)


@query(f"""
    SELECT 'public.events' AS relation, 'insert' AS op, event_id, value FROM events
    WHERE {_OPERATION_SQL} = 'insert' AND value > 10""")
def stream_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, sink = new_folder(spark, "changes"), new_folder(spark, "published")
    events = table(spark, sf_dir, "events").withColumn(
        "relation", F.concat(F.lit("public.events_"), "event_type")
    ).withColumn("op", _operation())
    events.write.parquet(source)
    spec = PublicationSpec(
        "inserts", ("insert",), {"public.events": PublishedTable(("event_id", "value"), "value > 10")},
        roots=_LEAVES,
    )
    stream = read_folder(spark, source, events.schema)
    write_folder(apply_publication(stream, spec, "public.events"), sink).awaitTermination()
    return spark.read.parquet(sink)
