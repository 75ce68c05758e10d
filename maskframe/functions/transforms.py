"""The scrub transforms as column expressions.

Each builtin takes a column and the run's salt and gives an expression that fits
the column's declared type. Anything that is not the name of a builtin is SQL.
"""

from __future__ import annotations

import re
import secrets
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.specs import ColumnSpec

# The shapes of scrubbed text.
EMAIL_PREFIX = "user_"
EMAIL_DOMAIN = "@example.invalid"
REDACTED = "REDACTED"
HASH_LENGTH = 32

_SALT_OR_LITERAL = re.compile(r"'(?:[^'\\]|\\.|'')*'|(?<!:):salt\b")


def new_salt() -> str:
    """A salt for one run. Hashes made with two salts cannot be compared."""
    return secrets.token_hex(16)


def source_column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def salted_hash(value: Column, salt: str) -> Column:
    """NULL stays NULL: ``concat`` is NULL as soon as one side is."""
    return F.md5(F.concat(value.cast("string"), F.lit(salt)))


def _null(col: ColumnSpec, salt: str) -> Column:
    if col.not_null:
        raise ValueError(
            "the column must have a value, so null cannot stand there; a constant in SQL can"
        )
    return F.lit(None).cast(col.data_type)


def _md5(col: ColumnSpec, salt: str) -> Column:
    _require_textual(col, "md5")
    out = salted_hash(source_column(col.name), salt)
    if col.max_len is not None and col.max_len < HASH_LENGTH:
        out = F.left(out, F.lit(col.max_len))
    return _declared(out, col)


def _email(col: ColumnSpec, salt: str) -> Column:
    _require_textual(col, "email")
    fixed = len(EMAIL_PREFIX) + len(EMAIL_DOMAIN)
    digits = HASH_LENGTH if col.max_len is None else min(HASH_LENGTH, col.max_len - fixed)
    if digits < 1:
        raise ValueError(
            f"an address takes {fixed + 1} characters or more and the column has room for {col.max_len}"
        )
    name = salted_hash(source_column(col.name), salt)
    if digits < HASH_LENGTH:
        name = F.left(name, F.lit(digits))
    return _declared(F.concat(F.lit(EMAIL_PREFIX), name, F.lit(EMAIL_DOMAIN)), col)


def _redact(col: ColumnSpec, salt: str) -> Column:
    _require_textual(col, "redact")
    return _declared(F.lit(REDACTED[: col.max_len]), col)


BUILTINS: dict[str, Callable[[ColumnSpec, str], Column]] = {
    "null": _null,
    "md5": _md5,
    "email": _email,
    "redact": _redact,
}


def builtin_names() -> list[str]:
    return sorted(BUILTINS)


def lookup_builtin(transform: str) -> str | None:
    name = transform.strip().lower()
    return name if name in BUILTINS else None


def sql_expression(transform: str, salt: str) -> Column:
    """User SQL over the raw row; ``:salt`` outside string literals is the run's salt."""
    quoted = "'" + salt.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(
        _SALT_OR_LITERAL.sub(lambda m: quoted if m.group() == ":salt" else m.group(), transform)
    )


def render(col: ColumnSpec, transform: str, salt: str) -> Column:
    name = lookup_builtin(transform)
    return sql_expression(transform, salt) if name is None else BUILTINS[name](col, salt)


def _declared(value: Column, col: ColumnSpec) -> Column:
    """Spark does not enforce lengths in expressions; a fixed-length type also pads."""
    if col.base_type == "character" and col.max_len is not None:
        value = F.rpad(value, col.max_len, " ")
    return value.cast(col.data_type)


def _require_textual(col: ColumnSpec, name: str) -> None:
    if not col.textual:
        raise ValueError(
            f"{name} makes text and the column is {col.type_name}; SQL of that type would fit"
        )
