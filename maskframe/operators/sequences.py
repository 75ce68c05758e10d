"""Sequence positions: where each one stands and what its next value is."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.transforms import source_column
from .reports import one_row_to_rows

# How a position was obtained.
FROM_CATALOG = "pg_sequences"
FROM_MAX = "max_column"
UNAVAILABLE = "unavailable"


# (owned_by, the greatest exported value)
Mark = tuple[str, "int | None"]


@dataclass(frozen=True)
class SequenceRef:
    """A sequence of one database, its owning column, and its value where the role may read it."""

    schema: str
    name: str
    owned_by: str | None = None
    readable: bool = False
    last_value: int | None = None


def sequence_positions(spark: SparkSession, refs: Sequence[SequenceRef], marks: Sequence[Mark]) -> DataFrame:
    """The same as :func:`positions` for the sequences of one database, which are few."""
    return positions(
        spark.createDataFrame([(r.schema, r.name, r.owned_by) for r in refs], "schema string, name string, owned_by string"),
        spark.createDataFrame(
            [(r.schema, r.name, r.last_value) for r in refs if r.readable], "schema string, name string, last_value bigint"
        ),
        spark.createDataFrame(list(marks), "owned_by string, max_value bigint"),
    )


def owning_columns(
    classes: DataFrame, namespaces: DataFrame, depends: DataFrame, attributes: DataFrame
) -> DataFrame:
    """(database, schema, name, owned_by) of every sequence, from raw catalog extracts.

    ``classes``: database, oid, relname, relnamespace, relkind. ``namespaces``: database, oid, nspname.
    ``depends``: database, objid, refobjid, refobjsubid, deptype. ``attributes``: database, attrelid, attnum, attname.
    A column owns a sequence through an automatic or internal dependency; that is part of the lookup, so a sequence
    with other dependencies only keeps its row and has no owner. The column is found by relation and number.
    """
    spaces = namespaces.select("database", F.col("oid").alias("relnamespace"), "nspname")
    named = classes.join(spaces, ["database", "relnamespace"])
    found = named.filter("relkind = 'S'").select("database", "oid", F.col("nspname").alias("schema"), F.col("relname").alias("name"))
    links = depends.filter(F.col("deptype").isin("a", "i") & (F.col("refobjsubid") > 0)).select(
        "database", F.col("objid").alias("oid"), F.col("refobjid").alias("attrelid"), F.col("refobjsubid").alias("attnum")
    )
    owners = named.select("database", F.col("oid").alias("attrelid"), F.concat_ws(".", "nspname", "relname").alias("table"))
    columns = attributes.select("database", "attrelid", "attnum", "attname")
    linked = found.join(links, ["database", "oid"], "left")
    owned, free = linked.filter("attrelid IS NOT NULL"), linked.filter("attrelid IS NULL")
    owned = owned.join(owners, ["database", "attrelid"], "left").join(columns, ["database", "attrelid", "attnum"], "left")
    owner = F.when(F.col("table").isNotNull() & F.col("attname").isNotNull(), F.concat_ws(".", "table", "attname"))
    return owned.select("database", "schema", "name", owner.alias("owned_by")).unionByName(
        free.select("database", "schema", "name", F.lit(None).cast("string").alias("owned_by"))
    )


def high_water(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """(owned_by, max_value) of several columns of one table in one pass.

    Taken from the exported frame, so that filtered rows do not count.
    """
    marks = df.agg(*[F.max(source_column(c)).cast("bigint").alias(f"m{i}") for i, c in enumerate(columns)])
    return one_row_to_rows(
        marks,
        [
            {"owned_by": F.lit(f"{table}.{c}"), "max_value": F.col(f"m{i}")}
            for i, c in enumerate(columns)
        ],
    )


def high_water_by(df: DataFrame, owner: str, value: str) -> DataFrame:
    """The same for a frame that holds many owners: maxima combine before they shuffle."""
    return df.groupBy(F.col(owner).alias("owned_by")).agg(
        F.max(source_column(value)).cast("bigint").alias("max_value")
    )


def positions(
    refs: DataFrame, readable: DataFrame, marks: DataFrame, scope: Sequence[str] = ()
) -> DataFrame:
    """The position of every sequence, and how it was found.

    ``refs``: (schema, name, owned_by), owned_by NULL when nothing owns the sequence.
    ``readable``: (schema, name, last_value), a row only where the role may read it;
    last_value NULL when the sequence was never advanced.
    ``marks``: (owned_by, max_value). For many databases all three carry the columns
    of ``scope`` too.
    """
    key = [*scope, "schema", "name"]
    seen = readable.select(*key, "last_value", F.lit(True).alias("may_read"))
    found = refs.join(seen, key, "left")
    # Nothing owns a good part of them; those have no mark to look for, and no key to meet at.
    owned = found.filter(F.col("owned_by").isNotNull()).join(marks, [*scope, "owned_by"], "left")
    free = found.filter(F.col("owned_by").isNull())
    found = owned.unionByName(free, allowMissingColumns=True)
    value = F.when(F.col("may_read"), F.col("last_value")).otherwise(F.col("max_value"))
    source = (
        F.when(F.col("may_read"), FROM_CATALOG)
        .when(F.col("owned_by").isNull(), UNAVAILABLE)
        .otherwise(FROM_MAX)
    )
    unavailable = F.col("source") == UNAVAILABLE
    return (
        found.select(*key, "owned_by", source.alias("source"), value.alias("value"))
        .select(
            *key, "owned_by", "source",
            # Never advanced: 1 and not yet called, so that the next value is the first one.
            F.when(unavailable, 0).otherwise(F.coalesce("value", F.lit(1))).cast("bigint")
            .alias("last_value"),
            F.when(unavailable, False).otherwise(F.col("value").isNotNull()).alias("is_called"),
        )
    )


def next_values(found: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """What each sequence hands out next; unavailable ones are left at their start."""
    step = F.when(F.col("is_called"), 1).otherwise(0)
    return found.filter(F.col("source") != UNAVAILABLE).select(
        *scope, "schema", "name", (F.col("last_value") + step).cast("bigint").alias("next_value")
    )


def source_summary(found: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """How many positions were read, derived or unavailable, and whether they were applied."""
    return found.groupBy(*scope, "source").agg(
        F.count(F.lit(1)).alias("sequences"),
        F.count_if(F.col("source") != UNAVAILABLE).alias("applied"),
        F.count_if(F.col("source") == UNAVAILABLE).alias("skipped"),
    )


def stored_positions(spark: SparkSession, entries: Sequence[dict]) -> DataFrame:
    """Manifest entries as a frame again, for :func:`next_values` and :func:`source_summary`."""
    rows = [
        (s["schema"], s["name"], s.get("ownedBy"), s["source"], s.get("lastValue") or 0, bool(s.get("isCalled"))) for s in entries
    ]
    shape = "schema string, name string, owned_by string, source string, last_value bigint, is_called boolean"
    return spark.createDataFrame(rows, shape)


def manifest_rows(found: DataFrame) -> list[dict]:
    """The sequences of one database as manifest entries: as many as it has sequences."""
    return [
        {
            "schema": r["schema"], "name": r["name"], "source": r["source"],
            "lastValue": r["last_value"], "isCalled": r["is_called"], "ownedBy": r["owned_by"],
        }
        for r in found.orderBy("schema", "name").collect()
    ]
