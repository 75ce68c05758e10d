"""Names and versions: the small scalar rules, as column expressions where they run on rows."""

from __future__ import annotations

import secrets
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes and formats that other tools read back.
STAGING_PREFIX = "restored_"
BACKUP_INFIX = "_backup_"
TIMESTAMP_PATTERN = "yyyyMMdd'T'HHmmss'Z'"
MIN_SERVER_MAJOR = 16


def timestamp_name(at: datetime | None = None) -> str:
    """Sorts as text in the order of time."""
    at = at or datetime.now(timezone.utc)
    return at.astimezone(timezone.utc).strftime("%Y%m%dT%H%M%SZ")


def staging_name() -> str:
    return STAGING_PREFIX + secrets.token_hex(4)


def backup_name(target: str, at: datetime | None = None) -> str:
    return target + BACKUP_INFIX + timestamp_name(at)


def timestamp_number(name: Column) -> Column:
    """A timestamp name as a whole number in the same order; any other text is an error."""
    return F.replace(F.replace(name, F.lit("T"), F.lit("")), F.lit("Z"), F.lit("")).cast("bigint")


def number_timestamp(number: Column) -> Column:
    text = number.cast("string")
    return F.concat(F.left(text, F.lit(8)), F.lit("T"), F.substring(text, 9, 6), F.lit("Z"))


def is_staging(name: Column) -> Column:
    return name.startswith(STAGING_PREFIX)


def is_backup_of(target: Column, name: Column) -> Column:
    return F.startswith(name, F.concat(target, F.lit(BACKUP_INFIX)))


def server_major(version_num: Column) -> Column:
    return F.floor(version_num / 10000).cast("int")


def is_qualified(name: Column) -> Column:
    parts = F.split(name, r"\.", -1)
    return (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "")


def quoted_identifier(name: Column) -> Column:
    """As is when plain, else in double quotes."""
    plain = name.rlike("^[a-z_][a-z0-9_]*$")
    return F.when(plain, name).otherwise(
        F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
    )


def is_user_schema(schema: Column) -> Column:
    return ~schema.like(r"pg\_%") & (schema != "information_schema")
