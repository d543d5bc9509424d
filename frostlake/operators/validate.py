"""Validation of decoded records: the first rule that fails gives the code and the message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostlake.functions.scalars import blank, within
from frostlake.sources.schemas import METADATA

#: Event types, codes and messages that rejected rows carry.
EVENT_TYPES = ("TELEMETRY_TEMPERATURE", "TELEMETRY_HUMIDITY", "TELEMETRY_BATTERY", "LOCATION", "DETECTION")
MESSAGES = {
    "MISSING_IDENTITY": "Event and device identifiers are required",
    "INVALID_SEQUENCE": "Sequence number must be positive",
    "UNKNOWN_EVENT_TYPE": "Unsupported event type",
    "INVALID_TIMESTAMP": "Timestamps must be positive",
    "INVALID_COORDINATES": "Latitude or longitude is outside its valid range",
    "INVALID_LOCATION_READING": "Speed or GPS accuracy is outside its valid range",
    "INVALID_DETECTION": "Detection type is required",
    "INVALID_METADATA_VERSION": "Metadata version must be positive",
    "INVALID_METADATA": "Metadata identity and effective timestamp are required",
    "INVALID_TEMPERATURE_RANGE": "Minimum temperature must be below maximum",
}
OUT_OF_RANGE = " is outside its valid range"


def _fails(code: str, message: Column | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(MESSAGES[code]) if message is None else message).alias("message"))


def sensor_rule() -> Column:
    """The failed rule of a sensor record as struct<code, message>; null if it is valid."""
    kind = F.col("event_type")
    measured = lambda name: _fails("INVALID_MEASUREMENT", F.concat(name, F.lit(OUT_OF_RANGE)))
    return (
        F.when(blank("event_id") | blank("device_id"), _fails("MISSING_IDENTITY"))
        .when(F.col("sequence_number") <= 0, _fails("INVALID_SEQUENCE"))
        .when(F.coalesce(~kind.isin(*EVENT_TYPES), F.lit(True)), _fails("UNKNOWN_EVENT_TYPE"))
        .when((F.col("event_time") <= 0) | (F.col("produced_at") <= 0), _fails("INVALID_TIMESTAMP"))
        .when((kind == "TELEMETRY_TEMPERATURE") & ~within("numeric_value", -50, 100), measured(F.lit("temperature")))
        .when(kind.isin("TELEMETRY_HUMIDITY", "TELEMETRY_BATTERY") & ~within("numeric_value", 0, 100), measured(F.lower(kind)))
        .when((kind == "LOCATION") & ~(within("latitude", -90, 90) & within("longitude", -180, 180)), _fails("INVALID_COORDINATES"))
        .when((kind == "LOCATION") & ~(within("speed_kph", 0, 250) & within("accuracy_m", 0, 10_000)), _fails("INVALID_LOCATION_READING"))
        .when((kind == "DETECTION") & blank("detection_type"), _fails("INVALID_DETECTION"))
    )


def metadata_rule() -> Column:
    """The same for device metadata, whose event time is not looked at."""
    low, high = F.col("min_temperature_c"), F.col("max_temperature_c")
    return (
        F.when(blank("event_id") | blank("device_id"), _fails("MISSING_IDENTITY"))
        .when(F.col("sequence_number") <= 0, _fails("INVALID_SEQUENCE"))
        .when(F.col("metadata_version") <= 0, _fails("INVALID_METADATA_VERSION"))
        .when((F.col("effective_from") <= 0) | blank("shipment_id") | blank("vehicle_id"), _fails("INVALID_METADATA"))
        # NaN compares as false, as IEEE has it.
        .when((low >= high) & ~F.isnan(low) & ~F.isnan(high), _fails("INVALID_TEMPERATURE_RANGE"))
    )


def validate(decoded: DataFrame) -> DataFrame:
    """decoded with error_code and error_message: null for valid rows, the decoder's or the first failed rule's otherwise."""
    rule = F.when(F.col("source_topic") == METADATA, metadata_rule()).otherwise(sensor_rule())
    failed = F.when(F.col("decode_code").isNotNull(), F.struct(F.col("decode_code").alias("code"), F.col("decode_message").alias("message"))).otherwise(rule)
    rows = decoded.withColumn("_v", failed)
    return rows.withColumns({"error_code": F.col("_v.code"), "error_message": F.col("_v.message")}).drop("_v")
