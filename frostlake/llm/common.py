"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostlake.sources.shared import scratch

#: Fixed value: the characters that separate words, as a regular expression.
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Rows of a Parquet file that a task holds at once where whole texts are read.
READ_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_few_rows(spark: SparkSession) -> None:
    """From here on Spark's Parquet reader holds READ_ROWS rows a task at most. Its own 4,096 whole texts are arrays of
    tens of MB, which it doubles as they fill, in every task. The session keeps this, as results are read when they are written."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key)) > READ_ROWS:
        spark.conf.set(key, str(READ_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts_for(df: DataFrame, each: int = 64 << 20, most: int = 100_000) -> int:
    """Parts of a shuffle of df: the session's number, and more where Spark's estimate of its stored size asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(shuffle_partitions(df.sparkSession), min(most, size // each) if size < 1 << 60 else 1)


def materialise(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read again: lineage is cut, lost executors
    cost nothing that was finished, and the files go when the session ends, or with discard."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    got.__dict__["_frostlake_at"] = path
    return got


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialise has made, which nothing will read any more."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.__dict__["_frostlake_at"])
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_of(column: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
