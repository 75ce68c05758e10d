"""What the engine knows about a table beyond its Spark schema.

Parquet carries names and types; length limits, generated columns, keys and
checks come from the database the table was taken from.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The base types that can hold the output of a text-producing transform.
TEXTUAL_BASE_TYPES = frozenset({"text", "character varying", "character", "citext", "name"})

_DECLARED_LENGTH = re.compile(r"^(char|varchar)\((\d+)\)$")


class SpecError(ValueError):
    """A list of problems, reported together."""

    def __init__(self, problems: Iterable[str]):
        self.problems = list(problems)
        super().__init__("\n".join(self.problems))


def split_qualified(name: str) -> tuple[str, str]:
    """``public.users`` -> ``("public", "users")``; anything else is an error."""
    parts = name.split(".")
    if len(parts) != 2 or not all(parts):
        raise ValueError(f'"{name}" is not a table name of the form schema.table')
    return parts[0], parts[1]


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    data_type: T.DataType = field(default_factory=T.StringType)
    base_type: str = "text"
    max_len: int | None = None
    not_null: bool = False
    generated: str | None = None
    identity: bool = False
    default: str | None = None

    @property
    def textual(self) -> bool:
        return self.base_type in TEXTUAL_BASE_TYPES

    @property
    def type_name(self) -> str:
        return self.base_type if self.max_len is None else f"{self.base_type}({self.max_len})"

    @classmethod
    def from_field(cls, f: T.StructField) -> ColumnSpec:
        """Field metadata wins over the Spark type: a uuid is a string to Spark but not textual."""
        meta = f.metadata or {}
        declared = meta.get("__CHAR_VARCHAR_TYPE_STRING", f.dataType.simpleString())
        bounded = _DECLARED_LENGTH.match(declared)
        if bounded:
            base = "character" if bounded.group(1) == "char" else "character varying"
            limit: int | None = int(bounded.group(2))
        else:
            base = "text" if isinstance(f.dataType, T.StringType) else f.dataType.simpleString()
            limit = None
        limit = meta.get("max_len", limit)
        return cls(
            name=f.name,
            data_type=T.StringType() if bounded else f.dataType,
            base_type=meta.get("base_type", "character varying" if limit and base == "text" else base),
            max_len=limit if limit and limit > 0 else None,
            not_null=not f.nullable,
            generated=meta.get("generated_expr"),
            identity=bool(meta.get("identity", False)),
        )


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class TableSpec:
    schema: str
    name: str
    columns: tuple[ColumnSpec, ...]
    kind: str = "table"  # "table" or "partitioned"
    parent: str | None = None
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: Mapping[str, str] = field(default_factory=dict)

    @property
    def qualified(self) -> str:
        return f"{self.schema}.{self.name}"

    @property
    def partitioned(self) -> bool:
        return self.kind == "partitioned"

    @property
    def stored(self) -> tuple[ColumnSpec, ...]:
        """The columns that are exported: everything that is not recomputed on load."""
        return tuple(c for c in self.columns if c.generated is None)

    def column(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name == name), None)

    def struct(self, columns: Iterable[ColumnSpec] | None = None) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.data_type) for c in columns or self.columns])

    @classmethod
    def from_schema(
        cls,
        name: str,
        schema: T.StructType,
        *,
        max_len: Mapping[str, int] | None = None,
        base_type: Mapping[str, str] | None = None,
        not_null: Iterable[str] = (),
        generated: Mapping[str, str] | None = None,
        identity: Iterable[str] = (),
        defaults: Mapping[str, str] | None = None,
        kind: str = "table",
        parent: str | None = None,
        unique: Iterable[Iterable[str]] = (),
        foreign_keys: Iterable[ForeignKey] = (),
        checks: Mapping[str, str] | None = None,
    ) -> TableSpec:
        max_len, base_type = max_len or {}, base_type or {}
        generated, defaults = generated or {}, defaults or {}
        not_null, identity = set(not_null), set(identity)
        named = set(max_len) | set(base_type) | not_null | set(generated) | identity | set(defaults)
        unknown = named - set(schema.fieldNames())
        if unknown:
            raise SpecError(f"{name}.{c}: no such column" for c in sorted(unknown))

        columns = []
        for f in schema.fields:
            spec = ColumnSpec.from_field(f)
            if f.name in max_len:
                base = "character varying" if spec.base_type == "text" else spec.base_type
                spec = replace(spec, max_len=max_len[f.name], base_type=base)
            columns.append(
                replace(
                    spec,
                    base_type=base_type.get(f.name, spec.base_type),
                    # Files report every column as nullable; constraints come from the caller.
                    not_null=f.name in not_null,
                    generated=generated.get(f.name, spec.generated),
                    identity=f.name in identity or spec.identity,
                    default=defaults.get(f.name),
                )
            )
        db_schema, table = split_qualified(name)
        return cls(
            schema=db_schema,
            name=table,
            columns=tuple(columns),
            kind=kind,
            parent=parent,
            unique=tuple(tuple(u) for u in unique),
            foreign_keys=tuple(foreign_keys),
            checks=dict(checks or {}),
        )

    @classmethod
    def from_df(cls, name: str, df: DataFrame, **kwargs) -> TableSpec:
        return cls.from_schema(name, df.schema, **kwargs)
