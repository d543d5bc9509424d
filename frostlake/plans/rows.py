"""Rows of the flow in the shape of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostlake.sources.schemas import TABLES


def _to(table: str, rows: DataFrame, **columns: Column) -> DataFrame:
    made = rows.withColumns(columns) if columns else rows
    return made.select(*[(F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table].schema.fields])


def _time(name: str) -> Column:
    return F.timestamp_millis(F.col(name))


def bronze(raw: DataFrame) -> DataFrame:
    return _to("bronze.raw_events", raw, kafka_day=F.to_date("kafka_timestamp"))


def metadata_history(metadata: DataFrame) -> DataFrame:
    return _to("silver.device_metadata_history", metadata, effective_from=_time("effective_from"))


def enriched(events: DataFrame) -> DataFrame:
    return _to("silver.enriched_events", events, event_time=_time("event_time"), produced_at=_time("produced_at"), processed_at=F.current_timestamp(), event_day=F.to_date(_time("event_time")))


def rejected(rows: DataFrame) -> DataFrame:
    return _to("silver.rejected_events", rows, event_time=_time("event_time"), rejected_at=F.current_timestamp(), rejected_day=F.current_date())


def hourly(rows: DataFrame) -> DataFrame:
    start = _time("window_start")
    return _to("gold.shipment_hourly_metrics", rows, window_start=start, window_end=_time("window_end"), last_event_time=_time("last_event_time"), updated_at=F.current_timestamp(), window_day=F.to_date(start))
