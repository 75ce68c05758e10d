"""Reports over catalog extracts of many databases.

Extracts are plain frames, one row per catalog entry, each with a ``database``:

- ``classes``: oid, nspname, relname, relkind, relowner, relispartition,
  relrowsecurity, relforcerowsecurity
- ``inherits``: inhrelid, inhparent
- ``attributes``: attrelid, attnum, attname, typname, atttypmod, attgenerated,
  attidentity, attnotnull, attisdropped, readable
- ``roles``: owner, is_member, bypass_rls (what the exporting role is to each owner), as ``role_privileges`` makes it
- ``role_list``: rolname, rolinherit, rolsuper, rolbypassrls
- ``memberships``: role, member, inherit_option (NULL before version 16, where the member's flag decides)
- ``types``: oid, typname, typnamespace, typtype, typbasetype, typtypmod, typelem, typcategory

Reports keep one row per column, owner or finding. Nothing gathers a database or
a table into an array. One owner may well own most tables; adaptive execution splits
the partitions such joins skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import MIN_SERVER_MAJOR, is_user_schema, server_major
from ..plans.specs import ColumnSpec, TableSpec
from ..workspace import kept
from .closure import CycleError, reachable, roots

# Kinds of finding, strongest first.
NO_SELECT = "no_select"
FORCED_ROW_SECURITY = "forced_row_security"
ROW_SECURITY = "row_security"

TYPMOD_HEADER = 4

# The declared name of a type, and the Spark type its values have here.
TYPES = {
    "int2": ("smallint", "smallint"),
    "int4": ("integer", "int"),
    "int8": ("bigint", "bigint"),
    "float4": ("real", "float"),
    "float8": ("double precision", "double"),
    "bool": ("boolean", "boolean"),
    "varchar": ("character varying", "string"),
    "bpchar": ("character", "string"),
    "bytea": ("bytea", "binary"),
    "date": ("date", "date"),
    "timestamp": ("timestamp without time zone", "timestamp_ntz"),
    "timestamptz": ("timestamp with time zone", "timestamp"),
}


def _qualified(schema: str, name: str) -> Column:
    return F.concat_ws(".", schema, name)


def base_type(typname: Column) -> Column:
    """The declared name of a type without its modifier."""
    names = F.create_map(*[F.lit(x) for t, (name, _) in TYPES.items() for x in (t, name)])
    return F.coalesce(F.try_element_at(names, typname), typname)


def type_name(typname: Column, typmod: Column) -> Column:
    """The declared name with its modifier: a length, or a precision and scale."""
    base = base_type(typname)
    modifier = typmod - TYPMOD_HEADER
    length = typname.isin("varchar", "bpchar") & (modifier > 0)
    precision = F.shiftright(modifier, 16).cast("string")
    scale = modifier.bitwiseAND(F.lit(65535)).cast("string")
    return (
        F.when(length, F.concat(base, F.lit("("), modifier.cast("string"), F.lit(")")))
        .when(
            (typname == "numeric") & (modifier >= 0),
            F.concat(base, F.lit("("), precision, F.lit(","), scale, F.lit(")")),
        )
        .otherwise(base)
    )


def user_relations(classes: DataFrame) -> DataFrame:
    """Tables and partitioned parents outside the system schemas."""
    return classes.filter(F.col("relkind").isin("r", "p") & is_user_schema(F.col("nspname")))


def tables(classes: DataFrame, inherits: DataFrame) -> DataFrame:
    """Every table with its flags, and for a leaf partition the parent it belongs to.

    The condition that only partitions have a parent is part of the lookup: a table
    that merely inherits keeps its row and has none.
    """
    found = user_relations(classes)
    parents = classes.select(
        "database", F.col("oid").alias("inhparent"),
        _qualified("nspname", "relname").alias("parent"),
    )
    links = inherits.join(parents, ["database", "inhparent"])
    links = links.select("database", F.col("inhrelid").alias("oid"), "parent")
    leaf = found.filter("relispartition").join(links, ["database", "oid"], "left")
    other = found.filter("NOT relispartition").withColumn("parent", F.lit(""))
    leaf = leaf.withColumn("parent", F.coalesce("parent", F.lit("")))
    return leaf.unionByName(other).select(
        "database", "oid", _qualified("nspname", "relname").alias("table"),
        F.col("nspname").alias("schema"), F.col("relkind").alias("kind"),
        F.col("relowner").alias("owner"),
        F.col("relrowsecurity").alias("row_security"),
        F.col("relforcerowsecurity").alias("force_row_security"),
        "parent",
    )


def partition_trees(classes: DataFrame, inherits: DataFrame) -> DataFrame:
    """Every partition with the table at the top of its tree: (database, table, kind, root, depth).

    Only partitions are followed: a table that merely inherits belongs to no tree, and ends one. Leaves, of kind ``r``,
    hold the rows.
    """
    name = _qualified("nspname", "relname")
    partitions = classes.filter("relispartition").select(
        "database", F.col("oid").alias("node"), name.alias("table"), F.col("relkind").alias("kind")
    )
    links = inherits.select("database", F.col("inhrelid").alias("node"), F.col("inhparent").alias("parent"))
    links = links.join(partitions.select("database", "node"), ["database", "node"], "left_semi")
    tops = classes.select("database", F.col("oid").alias("root"), name.alias("top"))
    found = roots(links).join(partitions, ["database", "node"]).join(tops, ["database", "root"])
    return found.select("database", "table", "kind", F.col("top").alias("root"), "depth")


def exportable(found: DataFrame) -> DataFrame:
    """Tables whose rows are copied directly; a partitioned parent's rows are in its leaves."""
    return found.filter(F.col("kind") == "r")


def columns(classes: DataFrame, attributes: DataFrame) -> DataFrame:
    """Every live column of every table with its length limit and flags."""
    relations = user_relations(classes).select(
        "database", F.col("oid").alias("attrelid"), _qualified("nspname", "relname").alias("table")
    )
    live = attributes.filter((F.col("attnum") > 0) & ~F.col("attisdropped"))
    bounded = F.col("typname").isin("varchar", "bpchar") & (F.col("atttypmod") > TYPMOD_HEADER)
    return live.join(relations, ["database", "attrelid"]).select(
        "database", "table", "attnum", F.col("attname").alias("column"),
        base_type(F.col("typname")).alias("base_type"),
        type_name(F.col("typname"), F.col("atttypmod")).alias("type_name"),
        F.when(bounded, F.col("atttypmod") - TYPMOD_HEADER).otherwise(-1).cast("int").alias("max_len"),
        (F.col("attgenerated") != "").alias("generated"),
        (F.col("attidentity") != "").alias("identity"),
        F.col("attnotnull").alias("not_null"),
    )


def table_specs(found: DataFrame, of_columns: DataFrame) -> list[TableSpec]:
    """The specs of one database's tables, from ``tables`` and ``columns``.

    Collects one row per column of that database. Types without a Spark type of
    their own are read as text.
    """
    spark_types = {name: kind for name, kind in TYPES.values()}

    def column(r) -> ColumnSpec:
        declared = r["type_name"]
        kind = spark_types.get(r["base_type"], "string")
        if declared.startswith("numeric("):
            kind = declared.replace("numeric", "decimal")
        return ColumnSpec(
            name=r["column"],
            data_type=T.DataType.fromDDL(kind),
            base_type=r["base_type"],
            max_len=r["max_len"] if r["max_len"] > 0 else None,
            not_null=r["not_null"],
            generated="" if r["generated"] else None,
            identity=r["identity"],
        )

    by_table: dict[str, list] = {}
    for r in of_columns.orderBy("table", "attnum").collect():
        by_table.setdefault(r["table"], []).append(column(r))
    out = []
    for r in found.orderBy("table").collect():
        schema, name = r["schema"], r["table"][len(r["schema"]) + 1:]
        kind = "partitioned" if r["kind"] == "p" else "table"
        columns_ = tuple(by_table.get(r["table"], ()))
        out.append(TableSpec(schema, name, columns_, kind, r["parent"] or None))
    return out


def unreadable_columns(classes: DataFrame, attributes: DataFrame) -> DataFrame:
    """Columns the role may not select. Generated ones are never exported, so they do not count."""
    ordinary = classes.filter((F.col("relkind") == "r") & is_user_schema(F.col("nspname")))
    blocked = attributes.filter(
        (F.col("attnum") > 0) & ~F.col("attisdropped")
        & (F.col("attgenerated") == "") & ~F.col("readable")
    )
    keyed = ordinary.select(
        "database", F.col("oid").alias("attrelid"),
        _qualified("nspname", "relname").alias("table"), F.col("relowner").alias("owner"),
    )
    return blocked.join(keyed, ["database", "attrelid"]).select(
        "database", "table", "owner", "attnum", F.col("attname").alias("column")
    )


def role_privileges(role_list: DataFrame, memberships: DataFrame, current: DataFrame) -> DataFrame:
    """What the exporting role is to every role of its database: (database, owner, is_member, bypass_rls).

    ``current``: (database, rolname), one row for each database. A role has the privileges of those it is granted, and of
    those that are granted, as long as every grant on the way is inherited; a superuser has all. Grants may go in circles.
    """
    flags = role_list.select("database", F.col("rolname").alias("member"), "rolinherit")
    inherited = F.coalesce("inherit_option", "rolinherit")
    grants = memberships.join(flags, ["database", "member"]).filter(inherited)
    starts = current.select("database", F.col("rolname").alias("node"))
    held = reachable(grants.select("database", F.col("member").alias("source"), F.col("role").alias("target")), starts)
    held = held.select("database", F.col("node").alias("owner"), F.lit(True).alias("held"))
    me = role_list.join(current, ["database", "rolname"]).select("database", "rolsuper", "rolbypassrls")
    owners = role_list.select("database", F.col("rolname").alias("owner")).join(me, "database")
    return owners.join(held, ["database", "owner"], "left").select(
        "database", "owner", (F.coalesce("held", F.lit(False)) | F.col("rolsuper")).alias("is_member"),
        (F.col("rolbypassrls") | F.col("rolsuper")).alias("bypass_rls"),
    )


def resolved_types(types: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Each type by what its values are: (database, oid, declared, typname, typmod, domains, is_array).

    ``typname`` and ``typmod`` are those of the plain type at the end of a chain of domains and arrays, ``typmod`` the one nearest
    to the declared type that says anything. ``declared`` is the name to write: a domain's own, with its schema unless
    that is the system's, and for an array the element's with brackets.
    """
    named = types.join(namespaces.select("database", F.col("oid").alias("typnamespace"), "nspname"), ["database", "typnamespace"])
    is_array = (F.col("typcategory") == "A") & (F.col("typelem") != 0)
    is_domain = F.col("typtype") == "d"
    chains = named.select(
        "database", "oid", F.when(is_domain, F.col("typbasetype")).when(is_array, F.col("typelem")).alias("next"),
        F.col("typtypmod").alias("typmod"), F.col("oid").alias("end"), is_domain.cast("int").alias("domains"), is_array.alias("is_array"),
        F.when(is_array, F.col("typelem")).alias("element"),
    )
    chains, most, reach = kept(chains, "types"), types.count(), 1
    while not chains.where("next IS NOT NULL").isEmpty():
        if reach > 2 * most:
            raise CycleError("types are made of themselves")
        end = chains.select("database", *[F.col(c).alias(n) for c, n in (
            ("oid", "next"), ("next", "then"), ("typmod", "mod2"), ("end", "end2"), ("domains", "domains2"), ("is_array", "array2")
        )])
        met = chains.join(end, ["database", "next"], "left").select(
            "database", "oid", F.col("then").alias("next"),
            F.when(F.col("typmod") >= 0, F.col("typmod")).otherwise(F.coalesce("mod2", "typmod")).alias("typmod"),
            F.coalesce("end2", "end").alias("end"), (F.col("domains") + F.coalesce("domains2", F.lit(0))).alias("domains"),
            (F.col("is_array") | F.coalesce("array2", F.lit(False))).alias("is_array"), "element",
        )
        chains, reach = kept(met, "types"), reach * 2
    system = F.col("nspname").isin("pg_catalog", "information_schema")
    names = named.select(
        "database", "oid", "typname", F.when(is_domain & ~system, _qualified("nspname", "typname")).otherwise(F.col("typname")).alias("name")
    )
    own = names.select("database", "oid", F.col("name").alias("own"))
    ends = names.select("database", F.col("oid").alias("end"), "typname")
    elements = names.select("database", F.col("oid").alias("element"), F.col("name").alias("element_name"))
    found = chains.join(own, ["database", "oid"]).join(ends, ["database", "end"]).join(elements, ["database", "element"], "left")
    declared = F.when(F.col("element").isNotNull(), F.concat(base_type(F.col("element_name")), F.lit("[]"))).otherwise(F.col("own"))
    return found.select("database", "oid", declared.alias("declared"), "typname", "typmod", "domains", "is_array")


def columns_of_types(classes: DataFrame, namespaces: DataFrame, attributes: DataFrame, types: DataFrame) -> DataFrame:
    """As ``columns``, from raw extracts: relations name their schema by ``relnamespace``, columns their type by ``atttypid``.

    ``type_name`` is the declared type, ``base_type`` and ``max_len`` what its values are bound to: those of a domain's plain type. A
    column's own modifier comes before the type's.
    """
    relations = classes.join(namespaces.select("database", F.col("oid").alias("relnamespace"), "nspname"), ["database", "relnamespace"])
    relations = user_relations(relations).select("database", F.col("oid").alias("attrelid"), _qualified("nspname", "relname").alias("table"))
    live = attributes.filter((F.col("attnum") > 0) & ~F.col("attisdropped")).join(relations, ["database", "attrelid"])
    known = resolved_types(types, namespaces).withColumnRenamed("oid", "atttypid")
    found = live.join(known, ["database", "atttypid"])
    own = F.col("atttypmod") >= 0
    modifier = F.when(own, F.col("atttypmod")).otherwise(F.col("typmod"))
    plain = F.col("domains") == 0
    declared = (
        F.when(~plain, F.col("declared"))
        .when(F.col("is_array"), F.concat(type_name(F.col("typname"), modifier), F.lit("[]")))
        .otherwise(type_name(F.col("typname"), modifier))
    )
    bounded = F.col("typname").isin("varchar", "bpchar") & (modifier > TYPMOD_HEADER) & ~F.col("is_array")
    return found.select(
        "database", "table", "attnum", F.col("attname").alias("column"), base_type(F.col("typname")).alias("base_type"),
        declared.alias("type_name"), F.when(bounded, modifier - TYPMOD_HEADER).otherwise(-1).cast("int").alias("max_len"),
        "domains", "is_array",
    )


def findings(
    classes: DataFrame, attributes: DataFrame, roles: DataFrame, skipped: DataFrame | None = None
) -> DataFrame:
    """Why tables cannot be exported in full: (database, table, owner, kind, column).

    A table with unreadable columns has one row per such column and nothing else.
    Otherwise row security is a finding unless the role escapes it: by bypassing it,
    or through the owner as long as the table does not force it. Tables the rule set
    skips (``skipped``: database, table) need no access.
    """
    blocked = unreadable_columns(classes, attributes)
    no_select = blocked.select(
        "database", "table", "owner", F.lit(NO_SELECT).alias("kind"), "attnum", "column"
    )
    secured = classes.filter(
        (F.col("relkind") == "r") & is_user_schema(F.col("nspname")) & F.col("relrowsecurity")
    ).select(
        "database", _qualified("nspname", "relname").alias("table"),
        F.col("relowner").alias("owner"), F.col("relforcerowsecurity").alias("forced"),
    )
    secured = secured.join(roles, ["database", "owner"], "left")
    bypass = F.coalesce("bypass_rls", F.lit(False))
    member = F.coalesce("is_member", F.lit(False))
    secured = secured.filter(~(bypass | (member & ~F.col("forced"))))
    by_policy = (
        secured.join(blocked.select("database", "table").distinct(), ["database", "table"], "left_anti")
        .select(
            "database", "table", "owner",
            F.when(F.col("forced"), FORCED_ROW_SECURITY).otherwise(ROW_SECURITY).alias("kind"),
            F.lit(None).cast("int").alias("attnum"), F.lit(None).cast("string").alias("column"),
        )
    )
    found = no_select.unionByName(by_policy)
    if skipped is not None:
        found = found.join(skipped, ["database", "table"], "left_anti")
    return found


def remedies(found: DataFrame, role: str) -> DataFrame:
    """What would resolve each finding, one row per finding and column."""
    skip = F.concat(F.lit("; or leave it out with "), "table", F.lit(": { mode: skip }"))
    remedy = (
        F.when(
            F.col("kind") == NO_SELECT,
            F.concat(F.lit("grant SELECT ("), "column", F.lit(") on "), "table", F.lit(f" to {role}"), skip),
        )
        .when(
            F.col("kind") == ROW_SECURITY,
            F.concat(F.lit("grant "), "owner", F.lit(f" to {role}")),
        )
        .otherwise(F.concat(F.lit("grant BYPASSRLS, as the policy is forced on owners too"), skip))
    )
    return found.select("database", "table", "kind", "column", remedy.alias("remedy"))


def owner_roles(found: DataFrame) -> DataFrame:
    """Owners whose membership would resolve the findings that a grant can resolve."""
    return found.filter(F.col("kind") == ROW_SECURITY).select("database", "owner").distinct()


def schemas(found: DataFrame) -> DataFrame:
    """The schemas an export covers."""
    return found.select("database", "schema").distinct()


def gate(databases: DataFrame, exportable_tables: DataFrame) -> DataFrame:
    """Databases no snapshot should start on: an old server, or nothing to export.

    ``databases``: (database, version_num). The server is looked at first.
    """
    counts = exportable_tables.groupBy("database").agg(F.count(F.lit(1)).alias("tables"))
    major = server_major(F.col("version_num"))
    checked = databases.join(counts, "database", "left").select(
        "database", major.alias("major"),
        F.coalesce("tables", F.lit(0)).cast("bigint").alias("tables"),
    )
    reason = F.when(F.col("major") < MIN_SERVER_MAJOR, "unsupported server").when(
        F.col("tables") == 0, "no tables to export"
    )
    return checked.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def extension_gaps(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """Extensions that databases want and their instance lacks, with how many want each.

    ``wanted``: (instance, database, name). ``available``: (instance, name).
    """
    asked = wanted.groupBy("instance", "name").agg(F.count(F.lit(1)).alias("wanted_by"))
    return asked.join(available.select("instance", "name").distinct(), ["instance", "name"], "left_anti")
