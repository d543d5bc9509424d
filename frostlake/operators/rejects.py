"""Rows set aside, with the reason: invalid, without metadata, too late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostlake.functions.scalars import one_line_base64
from frostlake.operators.lateness import is_late, is_missing
from frostlake.sources.schemas import SENSOR_TOPICS

COLUMNS = ("disposition", "error_code", "error_message", "event_id", "device_id", "event_time", "source_topic", "source_partition", "source_offset", "kafka_timestamp", "schema_id", "payload_base64", "lateness_ms", "watermark_ms")
#: Dispositions, codes and messages.
INVALID, TOO_LATE = "INVALID", "TOO_LATE"
NO_METADATA = ("MISSING_METADATA", "No metadata version was effective for this event")
OLD = ("EVENT_TIME_TOO_OLD", "Event exceeded the five-minute allowed-lateness boundary")


def _shaped(rows: DataFrame, given: dict[str, Column]) -> DataFrame:
    kinds = {"kafka_timestamp": "timestamp", "schema_id": "int", "lateness_ms": "bigint", "watermark_ms": "bigint", "event_time": "bigint"}
    return rows.select(*[given.get(c, F.lit(None)).cast(kinds.get(c, rows.schema[c].dataType if c in rows.columns else "string")).alias(c) for c in COLUMNS])


def _source() -> dict[str, Column]:
    return {c: F.col(c) for c in ("source_topic", "source_partition", "source_offset")}


def invalid(validated: DataFrame) -> DataFrame:
    """Invalid rows with their payload. Only decoded sensor records tell their event and device."""
    known = F.col("source_topic").isin(*SENSOR_TOPICS) & F.col("decode_code").isNull()
    own = {c: F.when(known, F.col(c)) for c in ("event_id", "device_id", "event_time")}
    rest = {"disposition": F.lit(INVALID), "error_code": F.col("error_code"), "error_message": F.col("error_message"), "kafka_timestamp": F.col("kafka_timestamp"), "schema_id": F.col("schema_id"), "payload_base64": one_line_base64("payload")}
    return _shaped(validated.where(F.col("error_code").isNotNull()), _source() | own | rest)


def set_aside(joined: DataFrame) -> DataFrame:
    """The rejects of the events joined with metadata, in one pass: those without any, and of the others the late ones."""
    rows = joined.where(is_missing() | is_late())
    either = lambda missing, late: F.when(is_missing(), missing).otherwise(late)
    late_by = F.greatest(F.lit(0), F.col("watermark_ms") - F.col("event_time"))
    told = {
        "disposition": either(F.lit(INVALID), F.lit(TOO_LATE)), "error_code": either(F.lit(NO_METADATA[0]), F.lit(OLD[0])), "error_message": either(F.lit(NO_METADATA[1]), F.lit(OLD[1])),
        "lateness_ms": F.when(~is_missing(), late_by), "watermark_ms": F.when(~is_missing(), F.col("watermark_ms")),
    }
    return _shaped(rows, _source() | {c: F.col(c) for c in ("event_id", "device_id", "event_time")} | told)


def union(*parts: DataFrame) -> DataFrame:
    """All rejects together; repeated ones stay."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def feed(rejected: DataFrame, disposition: str) -> DataFrame:
    """JSON messages of one disposition, without payload but with the time at which they were made, keyed by device."""
    names = ("disposition", "error_code", "error_message", "event_id", "device_id", "event_time", "source_topic", "source_partition", "source_offset")
    told = rejected.where(F.col("disposition") == disposition).withColumn("rejected_at", F.unix_millis(F.current_timestamp()))
    return told.select(F.col("device_id").alias("key"), F.to_json(F.struct(*names, "rejected_at")).alias("value"))
