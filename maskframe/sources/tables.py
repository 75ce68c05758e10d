"""Opening source tables so that all of them are read as of one moment."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import union_all
from ..plans.specs import TableSpec
from ..workspace import new_folder, path_exists


def open_parquet(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Open every table before the first job runs.

    A file-backed frame lists its files when it is made and reads exactly those
    afterwards: files added later are not seen, and one that disappears is an error.
    """
    return {name: spark.read.parquet(path) for name, path in paths.items()}


def pinned_files(df: DataFrame, table: str) -> DataFrame:
    """The files a frame reads, with what identifies their content: one row per file."""
    return (
        df.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("bytes"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
        .groupBy("file", "bytes", "modified").agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(table).alias("table"), "file", "bytes", "modified", "rows")
    )


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that were replaced or removed between two looks at the same table."""
    return before.join(after, ["table", "file", "bytes", "modified"], "left_anti")


_FOOTERS = {
    "spark.sql.sources.useV1SourceList": "",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.files.ignoreMissingFiles": "false",
    "spark.sql.files.ignoreCorruptFiles": "false",
}
_STATE = ("path", "length", "modificationTime")


def _listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Path, length and time of files from a fresh listing; their content is not read."""
    return spark.read.format("binaryFile").load(paths).select(*_STATE)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of the data files in a folder, as the store lists them, files without rows too."""
    found = _listed(spark, [folder]).withColumn("file", F.regexp_extract("path", r"/([^/]+)$", 1))
    return found.select("file", F.col("length").alias("bytes"))


def pinned(spark: SparkSession, frames: Iterable[DataFrame]) -> DataFrame | None:
    """The files that frames read, as they are now, kept in the shared folder; None if there are none."""
    paths = sorted({unquote(f) for df in frames for f in df.inputFiles()})
    if not paths:
        return None
    folder = new_folder(spark, "pins")
    _listed(spark, paths).write.parquet(folder)
    return spark.read.parquet(folder)


def unpinned(spark: SparkSession, pins: DataFrame | None) -> int:
    """How many pinned files are no longer there as they were."""
    if pins is None:
        return 0
    folders = pins.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder")).distinct()
    there = [f for f in (unquote(r["folder"]) for r in folders.toLocalIterator()) if path_exists(spark, f)]
    if not there:
        return pins.count()
    now = spark.read.format("binaryFile").load(there).select(*_STATE)
    return pins.join(now, list(_STATE), "left_anti").count()


def scanned_files(df: DataFrame) -> list[str] | None:
    """The Parquet files of a frame that gives every row of them, as it is; None for any other frame."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.child()
    if plan.nodeName() != "LogicalRelation" or not plan.simpleString(1).endswith(" parquet"):
        return None
    return sorted({unquote(f) for f in df.inputFiles()})


def footer_rows(spark: SparkSession, files: Mapping[str, list[str]]) -> DataFrame:
    """(table, rows): what the footers of Parquet files or folders say, whatever a scan of them gives.

    Tasks read footers only. The session is one of its own, as the setting by which Spark counts from
    footers concerns all reads, and as one that skips missing or broken files must not apply here.
    """
    own = spark.newSession()
    for key, value in _FOOTERS.items():
        own.conf.set(key, value)
    counts = [
        own.read.parquet(*paths).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), "rows")
        for t, paths in files.items() if paths
    ]
    none = [own.createDataFrame([(t, 0) for t, paths in files.items() if not paths], "table string, rows bigint")]
    return union_all([*counts, *none])


def leaves_of(specs: Iterable[TableSpec], parent: str) -> list[TableSpec]:
    """The tables that hold a partitioned table's rows, however many levels down."""
    below: dict[str, list[TableSpec]] = {}
    for s in specs:
        if s.parent is not None:
            below.setdefault(s.parent, []).append(s)
    out, todo, seen = [], [parent], {parent}
    while todo:
        for s in below.get(todo.pop(), ()):
            if s.qualified in seen:
                raise ValueError(f'partition "{s.qualified}" is below itself')
            seen.add(s.qualified)
            if s.partitioned:
                todo.append(s.qualified)
            else:
                out.append(s)
    return sorted(out, key=lambda s: s.qualified)


def roots_of(specs: Iterable[TableSpec]) -> dict[str, str]:
    """Leaf partition -> the partitioned table at the top of its tree, as ``PublicationSpec.roots`` wants it."""
    specs = list(specs)
    tops = [s.qualified for s in specs if s.partitioned and s.parent is None]
    return {leaf.qualified: top for top in tops for leaf in leaves_of(specs, top)}


def read_parent(frames: Mapping[str, DataFrame], specs: Iterable[TableSpec], parent: str) -> DataFrame:
    """A partitioned parent holds no rows itself; it is the union of the leaves of its whole tree, by name."""
    leaves = leaves_of(specs, parent)
    if not leaves:
        raise ValueError(f'partitioned table "{parent}" has no leaf partitions')
    return union_all(frames[leaf.qualified] for leaf in leaves)


def read_jdbc(
    spark: SparkSession,
    url: str,
    spec: TableSpec,
    *,
    split: tuple[str, int, int, int] | None,
    fetch_size: int = 10000,
    **options: str,
) -> DataFrame:
    """A table of a live database: only the exported columns, in parallel ranges of a column.

    ``split`` is the column, its lowest and highest value and the number of ranges. Reading through
    one task is for small tables, and has to be written down as None.
    Filters and column pruning of the scrub reach the database through Spark's JDBC
    pushdown. ``row_security`` is switched off so that a policy fails the read
    instead of shortening it.
    """
    columns = ", ".join('"' + c.name.replace('"', '""') + '"' for c in spec.stored)
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", f'(SELECT {columns} FROM "{spec.schema}"."{spec.name}") AS src')
        .option("fetchsize", fetch_size)
        .option("sessionInitStatement", "SET row_security = off")
    )
    for key, value in options.items():
        reader = reader.option(key, value)
    if split is not None:
        for key, value in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), split, strict=True):
            reader = reader.option(key, value)
    return reader.load()
