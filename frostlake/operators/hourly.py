"""Hourly metrics of each shipment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostlake.functions.scalars import steady_mean
from frostlake.operators.dedup import ARRIVAL


def hourly_metrics(events: DataFrame, width: str = "1 hour", time: str | None = None) -> DataFrame:
    """One row for each shipment and tumbling window of event time. The latest place is that of the newest event with
    both coordinates; of equally new ones the last to arrive. time names the timestamp column that a stream has its
    watermark on; without it event_time is used."""
    temperature = F.when(F.col("event_type") == "TELEMETRY_TEMPERATURE", F.col("numeric_value"))
    humidity = F.when(F.col("event_type") == "TELEMETRY_HUMIDITY", F.col("numeric_value"))
    place = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.struct("event_time", *ARRIVAL, "latitude", "longitude"))
    rows = events.groupBy("shipment_id", F.window(F.timestamp_millis("event_time") if time is None else F.col(time), width).alias("w")).agg(
        F.min(temperature).alias("temperature_min"),
        F.max(temperature).alias("temperature_max"),
        steady_mean(temperature).alias("temperature_avg"),
        steady_mean(humidity).alias("humidity_avg"),
        F.count_if(F.col("event_type") == "DETECTION").alias("detection_count"),
        F.count_if("breach").alias("breach_count"),
        F.count(F.lit(1)).alias("event_count"),
        F.max(place).alias("place"),
        F.max("event_time").alias("last_event_time"),
    )
    return rows.select(
        "shipment_id", F.unix_millis("w.start").alias("window_start"), F.unix_millis("w.end").alias("window_end"),
        "temperature_min", "temperature_max", "temperature_avg", "humidity_avg", "detection_count", "breach_count", "event_count",
        F.col("place.latitude").alias("latest_latitude"), F.col("place.longitude").alias("latest_longitude"), "last_event_time",
    )


def finalized(rows: DataFrame, watermark_ms: int | None) -> DataFrame:
    """Of the hourly rows those whose window the watermark has closed: its last millisecond is not after it."""
    return rows.where(F.lit(False) if watermark_ms is None else F.col("window_end") - 1 <= watermark_ms)


def alerts(on_time: DataFrame) -> DataFrame:
    """A temperature alert for each breach that came in time."""
    return on_time.where("breach").select("event_id", "device_id", "shipment_id", "event_time", F.col("numeric_value").alias("measured_temperature_c"), F.lit("TEMPERATURE_RANGE_BREACH").alias("alert_type"))


def alert_feed(on_time: DataFrame) -> DataFrame:
    """The alerts as JSON messages keyed by device, with the time at which they were made."""
    names = ("event_id", "device_id", "shipment_id", "event_time", "measured_temperature_c", "alert_type")
    made = alerts(on_time).withColumn("emitted_at", F.unix_millis(F.current_timestamp()))
    return made.select(F.col("device_id").alias("key"), F.to_json(F.struct(*names, "emitted_at")).alias("value"))
