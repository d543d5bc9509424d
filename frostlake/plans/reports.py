"""Reports over the tables: exposure, gaps, rejection rates, current state, verification and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostlake.functions.scalars import complete_minutes


def top_exposure(hourly: DataFrame, most: int = 50) -> DataFrame:
    """Shipment hours with most breaches, newest first; a top-n without a full sort."""
    names = ("shipment_id", "window_start", "temperature_min", "temperature_max", "temperature_avg", "breach_count", "event_count")
    return hourly.where("breach_count > 0").select(*names).orderBy(F.col("breach_count").desc(), F.col("window_start").desc(), "shipment_id").limit(most)


def gps_gaps(enriched: DataFrame, minutes: int = 10) -> DataFrame:
    """Places that came more than so many complete minutes after the device's last one."""
    last = F.lag("event_time").over(Window.partitionBy("device_id").orderBy("event_time", "event_id"))
    rows = enriched.where(F.col("event_type") == "LOCATION").select("shipment_id", "device_id", "event_id", "event_time", "latitude", "longitude", last.alias("previous_event_time"))
    rows = rows.withColumn("gap_minutes", complete_minutes("previous_event_time", "event_time"))
    return rows.where(F.col("gap_minutes") > minutes).select("shipment_id", "device_id", "previous_event_time", "event_time", "gap_minutes", "latitude", "longitude").orderBy(F.col("gap_minutes").desc(), "device_id", "event_time")


def rejection_rate(raw: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rejected rows of each topic and disposition, with their share; topics without rejects are not told."""
    all_rows = raw.groupBy("source_topic").agg(F.count(F.lit(1)).alias("raw_count"))
    gone = rejected.groupBy("source_topic", "disposition").agg(F.count(F.lit(1)).alias("rejected_count"))
    percent = F.round(F.col("rejected_count") * F.lit(100.0) / F.col("raw_count"), 3)
    return all_rows.join(gone, "source_topic").select("source_topic", "disposition", "rejected_count", "raw_count", percent.alias("rejected_percent")).orderBy(F.col("rejected_percent").desc(), "source_topic", "disposition")


def current_device_state(metadata: DataFrame) -> DataFrame:
    """The newest version of each device."""
    order = Window.partitionBy("device_id").orderBy(F.col("effective_from").desc(), F.col("metadata_version").desc())
    names = ("device_id", "shipment_id", "vehicle_id", "origin", "destination", "cargo_type", "status", "min_temperature_c", "max_temperature_c", "effective_from")
    return metadata.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*names).orderBy("shipment_id", "device_id")


def raw_uniqueness(raw: DataFrame) -> DataFrame:
    """A struct counts rows with nulls too, unlike several columns."""
    return raw.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_distinct(F.struct("source_topic", "source_partition", "source_offset")).alias("unique_offsets"))


def enriched_uniqueness(enriched: DataFrame) -> DataFrame:
    return enriched.agg(F.count(F.lit(1)).alias("enriched_rows"), F.count_distinct("event_id").alias("unique_event_ids"))


def disposition_counts(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("disposition", "error_code").agg(F.count(F.lit(1)).alias("records")).orderBy(F.col("disposition").asc_nulls_last(), F.col("records").desc(), "error_code")


def gold_totals(hourly: DataFrame) -> DataFrame:
    return hourly.agg(F.count(F.lit(1)).alias("hourly_rows"), F.sum("event_count").alias("aggregated_events"), F.sum("breach_count").alias("breaches"))


def schema_v2_null_split(enriched: DataFrame) -> DataFrame:
    """Rows of the first telemetry version have no signal strength."""
    return enriched.groupBy(F.col("signal_strength_dbm").isNull().alias("is_v1_row")).agg(F.count(F.lit(1)).alias("records")).orderBy("is_v1_row")


def day_partitions(enriched: DataFrame, most: int = 25) -> DataFrame:
    """Rows of each event day, most first."""
    day = F.expr("event_time div 86400000").alias("epoch_day")
    return enriched.groupBy(day).agg(F.count(F.lit(1)).alias("record_count")).orderBy(F.col("record_count").desc(), "epoch_day").limit(most)


def manifest_counts(validated: DataFrame) -> DataFrame:
    """What was produced, as counters: by topic, repeated, malformed, logically invalid."""
    again = F.count_distinct(F.when(F.col("decode_code").isNull(), F.struct("source_topic", "event_id")))
    return validated.groupBy("source_topic").agg(
        F.count(F.lit(1)).alias("produced_total"),
        (F.count_if(F.col("decode_code").isNull()) - again).alias("duplicates"),
        F.count_if(F.col("decode_code").isNotNull()).alias("invalid_malformed"),
        F.count_if(F.col("decode_code").isNull() & F.col("error_code").isNotNull()).alias("invalid_logical"),
    )


def reconcile(raw: DataFrame, metadata: DataFrame, enriched: DataFrame, rejected: DataFrame, hourly: DataFrame, counters: dict[str, int]) -> DataFrame:
    """(check_name, actual, expected, passed): the tables against the producer's counters. expected is a bound for
    the checks whose names end in _bound."""
    one = (
        raw.agg(F.count(F.lit(1)).alias("raw"), (F.count(F.lit(1)) - F.count_distinct(F.struct("source_topic", "source_partition", "source_offset"))).alias("raw_again"))
        .crossJoin(metadata.agg(F.count(F.lit(1)).alias("metadata")))
        .crossJoin(enriched.agg(F.count(F.lit(1)).alias("enriched"), (F.count(F.lit(1)) - F.count_distinct("event_id")).alias("enriched_again")))
        .crossJoin(rejected.agg(F.count_if((F.col("disposition") == "INVALID") & (F.col("error_code") != "MISSING_METADATA")).alias("invalid"), F.count_if(F.col("disposition") == "TOO_LATE").alias("late")))
        .crossJoin(hourly.agg(F.count(F.lit(1)).alias("hourly")))
    )  # single rows each
    n = lambda key: F.lit(int(counters.get(key, 0))).cast("bigint")
    bad = n("invalid_logical") + n("invalid_malformed")
    checks: list[tuple[str, Column, Column, Column]] = [
        ("raw_rows", F.col("raw"), n("produced_total"), F.col("raw") == n("produced_total")),
        ("raw_duplicates", F.col("raw_again"), F.lit(0), F.col("raw_again") == 0),
        ("metadata_rows", F.col("metadata"), n("metadata"), F.col("metadata") == n("metadata")),
        ("enriched_duplicates", F.col("enriched_again"), F.lit(0), F.col("enriched_again") == 0),
        ("invalid_rows", F.col("invalid"), bad, F.col("invalid") == bad),
        ("late_rows_bound", F.col("late"), n("too_late"), (F.col("late") <= n("too_late")) & ((F.col("late") > 0) | (n("too_late") == 0))),
        ("enriched_rows_bound", F.col("enriched"), n("configured_sensor_events") - bad, (F.col("enriched") > 0) & (F.col("enriched") <= n("configured_sensor_events") - bad)),
        ("hourly_rows_bound", F.col("hourly"), F.lit(1), F.col("hourly") >= 1),
    ]
    rows = F.array(*[F.struct(F.lit(name).alias("check_name"), a.cast("bigint").alias("actual"), e.cast("bigint").alias("expected"), p.alias("passed")) for name, a, e, p in checks])
    return one.select(F.inline(rows))
