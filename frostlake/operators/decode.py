"""Guarded decoding of raw records to one row shape for all topics. No record can fail the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from frostlake.sources import framing
from frostlake.sources.schemas import DETECTION, LOCATION, METADATA, SUPERSET, TELEMETRY

#: Codes of records that are not decodable, and of payloads that are no record.
DECODE_ERROR, NOT_A_RECORD = "AVRO_DECODE_ERROR", "NOT_AVRO_RECORD"
MOST_MESSAGE = 500

_PERMISSIVE = StructType([*SUPERSET.fields, StructField("_corrupt", StringType())])
#: Numbers without which a record of the topic cannot be read.
_REQUIRED = {
    TELEMETRY: ("event_time", "produced_at", "sequence_number", "value"),
    LOCATION: ("event_time", "produced_at", "sequence_number", "latitude", "longitude", "speed_kph", "accuracy_m"),
    DETECTION: ("event_time", "produced_at", "sequence_number"),
    METADATA: ("event_time", "produced_at", "sequence_number", "metadata_version", "effective_from", "min_temperature_c", "max_temperature_c"),
}


def json_record(payload: str | Column = "payload") -> Column:
    """The record in a framed JSON payload as a struct of all topics' fields, with _corrupt where it is none."""
    return F.from_json(F.decode(framing.body(payload), "UTF-8"), _PERMISSIVE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def decode(raw: DataFrame, record: Column | None = None) -> DataFrame:
    """raw with its record's fields, event_type, numeric_value, and decode_code and decode_message of
    those that could not be read. record gives the struct; by default the JSON codec's."""
    rows = raw.withColumn("_r", json_record() if record is None else record)
    topic = F.col("source_topic")
    lacking: Column = F.lit(False)
    for name, fields in _REQUIRED.items():
        missing = F.lit(False)
        for f in fields:
            missing = missing | F.col(f"_r.{f}").isNull()
        lacking = F.when(topic == name, missing).otherwise(lacking)
    code = (
        F.when(F.col("payload").isNull(), F.struct(F.lit(NOT_A_RECORD).alias("code"), F.lit("Payload is not a record").alias("message")))
        .when(F.coalesce(~topic.isin(*_REQUIRED), F.lit(True)), F.struct(F.lit(DECODE_ERROR).alias("code"), F.concat(F.lit("Unsupported topic: "), F.coalesce(topic, F.lit("null"))).alias("message")))
        .when(F.col("schema_id").isNull(), F.struct(F.lit(DECODE_ERROR).alias("code"), F.lit("Payload has no schema header").alias("message")))
        .when(F.col("_r").isNull() | F.col("_r._corrupt").isNotNull(), F.struct(F.lit(DECODE_ERROR).alias("code"), F.lit("Payload does not match its schema").alias("message")))
        .when(lacking, F.struct(F.lit(DECODE_ERROR).alias("code"), F.lit("A required number is missing").alias("message")))
    )
    event_type = F.when(topic == TELEMETRY, F.concat(F.lit("TELEMETRY_"), F.coalesce(F.col("_r.measurement_type"), F.lit("null")))).when(topic == LOCATION, "LOCATION").when(topic == DETECTION, "DETECTION")
    fields = [F.col(f"_r.{f.name}").alias(f.name) for f in SUPERSET.fields if f.name not in ("value", "measurement_type")]
    return rows.withColumn("_c", code).select(
        *raw.columns, *fields, F.col("_r.value").alias("numeric_value"), event_type.alias("event_type"),
        F.col("_c.code").alias("decode_code"), F.substring(F.col("_c.message"), 1, MOST_MESSAGE).alias("decode_message"),
    )
