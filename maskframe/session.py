"""Session settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SALT_REDACTION = r"(?i)\b[0-9a-f]{32}\b"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A side is broadcast on its measured size only. Estimates come from compressed files
    # and pruned columns and can be far below what a derived text column really takes.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    # Generated salts are 32 hex digits; keep them out of rendered plans and event logs.
    "spark.redaction.string.regex": SALT_REDACTION,
    "spark.sql.redaction.string.regex": SALT_REDACTION,
}


def builder(app: str = "maskframe", total_cores: int | None = None) -> SparkSession.Builder:
    """A session builder with the settings above; later ``.config`` calls win.

    With the cores of a whole cluster given, shuffles start with several partitions
    per core; adaptive execution merges the ones that turn out small.
    """
    out = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        out = out.config(key, value)
    if total_cores is not None:
        out = out.config("spark.sql.shuffle.partitions", str(4 * total_cores))
    return out
