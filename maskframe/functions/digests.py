"""Digests that do not depend on row order or on how rows are split into files."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .transforms import source_column


def _contains_map(t: T.DataType) -> bool:
    if isinstance(t, T.MapType):
        return True
    if isinstance(t, T.ArrayType):
        return _contains_map(t.elementType)
    return isinstance(t, T.StructType) and any(_contains_map(f.dataType) for f in t.fields)


def row_hash(schema: T.StructType) -> Column:
    """64 bits per row. Maps have no order of their own, so a top-level map is sorted first."""
    parts = []
    for f in schema.fields:
        col = source_column(f.name)
        if isinstance(f.dataType, T.MapType) and not _contains_map(f.dataType.valueType):
            col = F.array_sort(F.map_entries(col))
        elif _contains_map(f.dataType):
            col = F.to_json(col)
        # Hash functions skip NULLs; the flag keeps (NULL, 'a') apart from ('a', NULL).
        parts += [col, col.isNull()]
    return F.xxhash64(*parts)


def content_measures(schema: T.StructType) -> dict[str, Column]:
    """Aggregates that combine partially, so they can be observed while a table is written."""
    h = row_hash(schema)
    return {
        "rows": F.count(F.lit(1)),
        "hash_xor": F.coalesce(F.bit_xor(h), F.lit(0).cast("bigint")),
        # 38 digits hold the sum of 10^19 64-bit hashes.
        "hash_sum": F.coalesce(F.sum(h.cast("decimal(19,0)")), F.lit(0)).cast("decimal(38,0)"),
    }


def content_sha256(found: Mapping[str, Any]) -> str:
    """The digest made of observed measures; ``content_digest`` gives the same as a column."""
    text = f"{found['rows']}:{found['hash_xor']}:{found['hash_sum']}"
    return hashlib.sha256(text.encode()).hexdigest()


def content_digest(df: DataFrame) -> DataFrame:
    """One row: (rows, content_sha256), the same for any order and any file layout."""
    measured = df.agg(*[c.alias(n) for n, c in content_measures(df.schema).items()])
    return measured.select(
        "rows",
        F.sha2(F.concat_ws(":", "rows", "hash_xor", F.col("hash_sum").cast("string")), 256)
        .alias("content_sha256"),
    )


def combine_sha256(sha: Column) -> list[Column]:
    """Aggregates over part digests from which one digest for all parts is made."""
    words = [F.conv(F.substring(sha, i * 16 + 1, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    return [F.sum(w).alias(f"w{i}") for i, w in enumerate(words)]


def combined_sha256(files: Column, size: Column) -> Column:
    words = [F.col(f"w{i}").cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(":", *words, files.cast("string"), size.cast("string")), 256)
