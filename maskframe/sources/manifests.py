"""The manifest: what a snapshot holds, and the mark that it is complete."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import path_exists
from .layout import Layout, path_part

ARTIFACT_VERSION = 1

# The field names and types of the manifest document.
MANIFEST_SCHEMA = """
    artifactVersion int, tool string, createdAt string,
    source struct<serverMajor: int, database: string>,
    scrubbed boolean, scrubConfigSha256 string, fkMode string,
    tables array<struct<schema: string, name: string, skipped: boolean, `where`: string,
        columns: array<string>, transforms: map<string, string>, rowCount: bigint, file: string,
        format: string, files: bigint, bytes: bigint, sha256: string, contentSha256: string>>,
    sequences array<struct<schema: string, name: string, source: string, lastValue: bigint,
        isCalled: boolean, ownedBy: string>>
"""

_PLACE = r"/([^/]+)/(\d{8}T\d{6}Z)/manifest\.json(?:/[^/]*)?$"


@dataclass(frozen=True)
class TableEntry:
    schema: str
    name: str
    skipped: bool = False
    where: str = ""
    columns: tuple[str, ...] = ()
    transforms: dict[str, str] = field(default_factory=dict)
    row_count: int = 0
    file: str | None = None
    format: str | None = None
    files: int = 0
    bytes: int = 0
    sha256: str | None = None
    content_sha256: str | None = None

    @property
    def qualified(self) -> str:
        return f"{self.schema}.{self.name}"

    def document(self) -> dict[str, Any]:
        return {
            "schema": self.schema, "name": self.name, "skipped": self.skipped,
            "where": self.where, "columns": list(self.columns), "transforms": self.transforms,
            "rowCount": self.row_count, "file": self.file, "format": self.format,
            "files": self.files, "bytes": self.bytes, "sha256": self.sha256,
            "contentSha256": self.content_sha256,
        }

    @classmethod
    def of(cls, doc: dict[str, Any]) -> TableEntry:
        return cls(
            schema=doc["schema"], name=doc["name"], skipped=bool(doc.get("skipped")),
            where=doc.get("where") or "", columns=tuple(doc.get("columns") or ()),
            transforms=dict(doc.get("transforms") or {}), row_count=doc.get("rowCount") or 0,
            file=doc.get("file") or None, format=doc.get("format"), files=doc.get("files") or 0,
            bytes=doc.get("bytes") or 0, sha256=doc.get("sha256"),
            content_sha256=doc.get("contentSha256"),
        )


@dataclass(frozen=True)
class Manifest:
    database: str
    server_major: int
    created_at: str
    tool: str = "maskframe"
    scrubbed: bool = True
    config_sha256: str = ""
    fk_mode: str = ""
    tables: tuple[TableEntry, ...] = ()
    sequences: tuple[dict[str, Any], ...] = ()
    artifact_version: int = ARTIFACT_VERSION

    def entry(self, qualified: str) -> TableEntry:
        return next(t for t in self.tables if t.qualified == qualified)

    def total_rows(self) -> int:
        return sum(t.row_count for t in self.tables)

    def loadable(self) -> list[TableEntry]:
        """Entries that hold rows, largest first: the longest job starts at once."""
        found = [t for t in self.tables if not t.skipped and t.file]
        return sorted(found, key=lambda t: (-t.bytes, t.qualified))

    def to_json(self) -> str:
        return json.dumps({
            "artifactVersion": self.artifact_version,
            "tool": self.tool,
            "createdAt": self.created_at,
            "source": {"serverMajor": self.server_major, "database": self.database},
            "scrubbed": self.scrubbed,
            "scrubConfigSha256": self.config_sha256,
            "fkMode": self.fk_mode,
            "tables": [t.document() for t in sorted(self.tables, key=lambda t: t.qualified)],
            "sequences": list(self.sequences),
        })

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        doc = json.loads(text)
        source = doc.get("source") or {}
        return cls(
            database=source.get("database") or "",
            server_major=source.get("serverMajor") or 0,
            created_at=doc.get("createdAt") or "",
            tool=doc.get("tool") or "",
            scrubbed=bool(doc.get("scrubbed")),
            config_sha256=doc.get("scrubConfigSha256") or "",
            fk_mode=doc.get("fkMode") or "",
            tables=tuple(TableEntry.of(t) for t in doc.get("tables") or ()),
            sequences=tuple(doc.get("sequences") or ()),
            artifact_version=doc.get("artifactVersion") or 0,
        )


def write_manifest(spark: SparkSession, layout: Layout, manifest: Manifest) -> None:
    """Written last, as one document. A snapshot without it does not exist."""
    stored = replace(manifest, tables=tuple(replace(t, file=layout.relative(t.file)) for t in manifest.tables))
    row = spark.range(0, 1, 1, 1).select(F.lit(stored.to_json()).alias("value"))
    row.write.mode("error").text(layout.manifest)


def read_manifest(spark: SparkSession, layout: Layout) -> Manifest:
    """The document, with the places of data below the folder it was read from."""
    found = Manifest.from_json(spark.read.text(layout.manifest, wholetext=True).first()["value"])
    return replace(found, tables=tuple(replace(t, file=layout.resolve(t.file)) for t in found.tables))


def read_manifests(spark: SparkSession, root: str, database: str = "*") -> DataFrame:
    """Every complete snapshot below a root: its database as the document says, ``ts`` from its place."""
    name = database if database == "*" else path_part(database)
    place = f"{root.rstrip('/')}/{name}/*/manifest.json"
    if path_exists(spark, place):
        docs = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(place)
        docs = docs.withColumn("place", F.col("_metadata.file_path"))
    else:
        docs = spark.createDataFrame([], MANIFEST_SCHEMA).withColumn("place", F.lit(""))
    return docs.select(
        F.coalesce("source.database", F.regexp_extract("place", _PLACE, 1)).alias("database"),
        F.regexp_extract("place", _PLACE, 2).alias("ts"),
        *[c for c in docs.columns if c != "place"],
    ).filter(F.col("ts") != "")


def parse_manifests(df: DataFrame, text: str = "manifest") -> DataFrame:
    """The documents of a text column, as fields beside the other columns."""
    kept = [c for c in df.columns if c != text]
    parsed = df.select(*kept, F.from_json(text, MANIFEST_SCHEMA).alias("m"))
    return parsed.select(*kept, "m.*")


def table_entries(manifests: DataFrame) -> DataFrame:
    """One row per (database, ts, table)."""
    entries = manifests.select("database", "ts", F.inline("tables"))
    return entries.select(
        "database", "ts",
        F.concat_ws(".", "schema", "name").alias("table"),
        "skipped", "where", "columns", "transforms",
        F.col("rowCount").alias("row_count"), "file", "format", "files", "bytes", "sha256",
        F.col("contentSha256").alias("content_sha256"),
    )


def column_entries(entries: DataFrame) -> DataFrame:
    """One row per exported column, with its position and its configured rule."""
    exploded = entries.select(
        "database", "ts", "table", "transforms", F.posexplode("columns").alias("position", "column")
    )
    return exploded.select(
        "database", "ts", "table", (F.col("position") + 1).alias("position"), "column",
        F.try_element_at("transforms", F.col("column")).alias("transform"),
    )


def load_order(entries: DataFrame) -> DataFrame:
    """Loadable entries of each snapshot, ranked by size.

    A window over one snapshot is bounded: its rows come out of one document.
    """
    by_size = Window.partitionBy("database", "ts").orderBy(F.col("bytes").desc(), "table")
    return (
        entries.filter(~F.col("skipped") & F.col("file").isNotNull())
        .select("database", "ts", "table", "bytes", F.row_number().over(by_size).alias("position"))
    )
