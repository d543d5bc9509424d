"""Arrival-order watermarks and the routing of events that come too late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostlake.operators.dedup import ARRIVAL

OUT_OF_ORDER_MS = 60_000
ALLOWED_MS = 300_000
#: Rows that share a prefix maximum, about: what a task sorts at once.
BUCKET_ROWS = 1_000_000


def _bucket_ms(raw: DataFrame) -> int:
    """The stretch of arrival time that holds about so many rows, and less where there would be fewer stretches than tasks."""
    seen = raw.agg(F.min("arrival").alias("low"), F.max("arrival").alias("high"), F.count("arrival").alias("n")).first()
    tasks = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * tasks, -(-seen.n // BUCKET_ROWS))
    return max(1, -(-(seen.high - seen.low + 1) // buckets)) if seen.n else 1


def with_watermark(raw: DataFrame) -> DataFrame:
    """raw with watermark_ms as it stood when each row arrived: the largest Kafka time so far, less the
    disorder allowed and one millisecond; null for the first row. Rows without arrival count as the first to come.

    Running maxima are worked out inside buckets of arrival time and offset by the maxima of the buckets before. A
    bucket's width follows from the number of rows, so no task sees many, and the buckets' maxima, a row for
    each BUCKET_ROWS rows or two for each task, are few enough to broadcast. raw is read three times: store it first."""
    width = _bucket_ms(raw)
    rows = raw.withColumns({"_b": F.floor(F.col("arrival") / width), "_ts": F.unix_millis("kafka_timestamp")})
    tops = rows.groupBy("_b").agg(F.max("_ts").alias("_top"))
    before = tops.select(F.col("_b").alias("_own"), F.max("_top").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = F.max("_ts").over(Window.partitionBy("_b").orderBy(*ARRIVAL).rowsBetween(Window.unboundedPreceding, -1))
    joined = rows.withColumn("_inside", inside).join(F.broadcast(before), F.col("_b").eqNullSafe(F.col("_own")), "left")
    return joined.withColumn("watermark_ms", F.greatest("_before", "_inside") - OUT_OF_ORDER_MS - 1).drop("_b", "_ts", "_inside", "_own", "_before")


def is_late() -> Column:
    """Strictly older than the watermark less the allowed lateness; never without a watermark."""
    return F.coalesce(F.col("event_time") < F.col("watermark_ms") - ALLOWED_MS, F.lit(False))


def is_missing() -> Column:
    """No metadata version was effective."""
    return F.col("metadata_version").isNull()


def on_time(joined: DataFrame) -> DataFrame:
    """Of the events joined with metadata those that are neither without any nor late."""
    return joined.where(~is_missing() & ~is_late())
