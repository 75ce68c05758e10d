"""Where intermediate and example outputs go.

A cluster names one folder every executor can reach in ``spark.checkpoint.dir``.
A machine-local folder is used only by a local master that names none.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="maskframe-")


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_folder()


def new_folder(spark: SparkSession, label: str) -> str:
    """A path nobody else uses, below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """The rows, computed once and written to the shared folder, so that later steps start from there."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _store(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def data_size(spark: SparkSession, folder: str) -> tuple[int, int]:
    """How many files Spark has written to a folder, and their bytes, as the store lists them."""
    path, store = _store(spark, folder)
    found = store.getContentSummary(path)
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return found.getFileCount() - int(store.exists(marker)), found.getLength()


def remove(spark: SparkSession, place: str) -> bool:
    """Delete a file or a folder; whether there was one."""
    path, store = _store(spark, place)
    return store.delete(path, True)


def path_exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any file or folder matches, on whatever file system the path names."""
    path, store = _store(spark, pattern)
    found = store.globStatus(path)
    return found is not None and len(found) > 0


def create_new(spark: SparkSession, place: str, text: str) -> bool:
    """Write a small file unless there is one already; of several writers one succeeds.

    The text goes to a file of its own name first and is renamed without overwriting, so nobody sees
    half of it. HDFS decides between two renames to one name; a local folder, or a store that copies
    to rename, looks first and renames then, which leaves a moment in which both may get through.
    """
    jvm = spark._jvm
    path, store = _store(spark, place)
    aside = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}.{uuid.uuid4().hex}")
    out = store.create(aside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        context.rename(aside, path, options)
    except Py4JJavaError as e:
        if not store.exists(path):
            raise e
        return False
    finally:
        store.delete(aside, False)
    return True
