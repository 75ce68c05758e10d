"""Reading and writing tables as compressed COPY text."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import types as T

from ..functions.copytext import decode_fields, encode_line, split_line

GZIP, BZIP2 = "gzip", "bzip2"
# Gzip cannot be split, so one file is one task when it is read back.
ROWS_PER_FILE = 2_000_000


def encode(df: DataFrame) -> DataFrame:
    return df.select(encode_line(df.schema).alias("value"))


def copytext_writer(df: DataFrame, rows_per_file: int | None = None, compression: str = GZIP) -> DataFrameWriter:
    """Lines of COPY text, compressed by ``gzip`` or by ``bzip2``.

    bzip2 takes more processor time; its blocks are found again from any place in a file, so a file is
    read by as many tasks as its bytes call for, and rows per file are bounded only if asked for. It is the choice for
    rows of very different lengths, where a number of rows bounds no bytes.
    """
    if compression not in (GZIP, BZIP2):
        raise ValueError(f'COPY text is compressed by gzip or bzip2, not "{compression}"')
    writer = encode(df).write.format("text").option("compression", compression).option("lineSep", "\n")
    most = rows_per_file or (ROWS_PER_FILE if compression == GZIP else 0)
    return writer.option("maxRecordsPerFile", most)


def write_copytext(df: DataFrame, path: str, rows_per_file: int | None = None, compression: str = GZIP) -> None:
    copytext_writer(df, rows_per_file, compression).save(path)


def read_copytext(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Only a newline ends a line: a carriage return can be part of a value read from elsewhere."""
    lines = spark.read.option("lineSep", "\n").text(path)
    # A line is cut once; the fields are taken from the result.
    cut = lines.select(split_line(lines["value"], schema).alias("fields"))
    return cut.select(*decode_fields(cut["fields"], schema))
