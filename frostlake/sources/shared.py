"""Folders and tables of a query's own where all executors can write and read."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only where that is unset and one machine runs everything, as in tests, a
    temporary folder takes its place; on a cluster executors would not see each other's."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return at or "file://" + tempfile.gettempdir()


def scratch(spark: SparkSession) -> str:
    """A new folder there, which goes when the session ends."""
    path = f"{shared_folder(spark)}/frostlake-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def _status(spark: SparkSession, path: str):
    """What the file system has of a path, or nothing where it is not there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getFileStatus(where) if files.exists(where) else None


_made: dict[tuple, str] = {}


def made_once(spark: SparkSession, name: str, source: str, make: Callable[[str], None], done: str = "") -> str:
    """A folder that make fills, once for an application and a state of the source's files. done: what is in it when it is whole; where
    that has gone, it is made anew."""
    seen = _status(spark, source)
    key = (spark.sparkContext.applicationId, name, source, seen and seen.getModificationTime())
    at = _made.get(key)
    if at is None or _status(spark, f"{at}/{done}") is None:
        at = scratch(spark)
        make(at)
        _made[key] = at
    return at


def stored(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read again, so that many branches can start from it without its
    being worked out for each, and lost executors cost nothing of it."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
