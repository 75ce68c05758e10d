"""Scrubbing and publishing streams. Both are row-wise: no state, no watermark, no late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.scrub import scrub
from ..plans.config import ScrubConfig
from ..plans.specs import TableSpec
from ..workspace import new_folder


def read_folder(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """A folder of Parquet files as a stream; each micro-batch takes a bounded number of files."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def write_folder(
    df: DataFrame, path: str, checkpoint: str | None = None, *, available_now: bool = True,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Append a stream to a Parquet folder, each input row once whatever fails in between."""
    checkpoint = checkpoint or new_folder(df.sparkSession, "checkpoint")
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def scrub_stream(stream: DataFrame, spec: TableSpec, cfg: ScrubConfig, salt: str) -> DataFrame:
    """The batch scrub on a stream.

    The caller gives the salt and keeps it for the life of the query, outside the
    checkpoint: a restart with another salt would break joins over scrubbed keys.
    """
    return scrub(stream, spec, cfg, salt)
