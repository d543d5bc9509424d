"""The test tables' events as raw telemetry records: one topic for each event type, with every fault that validation
knows at some multiple of the identifier."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from frostlake.sources import avro, framing
from frostlake.sources.schemas import DETECTION, LOCATION, METADATA, PAYLOADS, RAW, SCHEMA_IDS, TELEMETRY, TOPIC_PARTITIONS
from frostlake.sources.shared import made_once

MALFORMED = b"not-confluent-avro"
#: Of the events' identifiers, the modulus and the remainder at which a fault is put in.
FAULTS = {"unframed": (211, 0), "tombstone": (419, 3), "cut off": (431, 5), "sequence": (307, 5), "type": (101, 7), "produced": (223, 9), "detection": (53, 3), "version": (61, 2), "vehicle": (67, 3)}
#: Columns of the records: those of the topics, and the arrival (ms).
CAPTURED = StructType([*RAW.fields, StructField("arrival", LongType())])
UNDECODABLE = ("unframed", "tombstone", "cut off")
LATE, AGAIN = (97, 0), (100, 1)


def faulty(*names: str) -> Column:
    """Whether an event has one of these faults."""
    out: Column = F.lit(False)
    for n in names:
        out = out | (F.col("event_id") % FAULTS[n][0] == FAULTS[n][1])
    return out


def _at(place: tuple[int, int]) -> Column:
    return F.col("event_id") % place[0] == place[1]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, kind, value, k, et) of the test table."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "user_id", "event_type AS kind", "value", "CAST(get_json_object(props, '$.k') AS int) AS k",
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS timestamp_ntz)) div 1000 AS et",
    )


def _good_signup() -> Column:
    return (F.col("kind") == "signup") & ~faulty(*UNDECODABLE, "sequence", "version", "vehicle") & (F.col("k") != 13)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW records and their arrival (ms). Kafka's own timestamp is the event time."""
    e = events(spark, sf_dir)
    signup_ok = _good_signup().cast("int")
    e = e.withColumn("version", F.greatest(F.lit(1), F.sum(signup_ok).over(Window.partitionBy("user_id").orderBy("et", "event_id"))).cast("int"))
    topic = F.when(F.col("kind").isin("click", "view"), TELEMETRY).when(F.col("kind") == "purchase", LOCATION).when(F.col("kind") == "error", DETECTION).otherwise(METADATA)
    magnitude = F.when((F.col("k") >= 84), F.col("value") / 10)
    detection = F.when(F.col("k") < 42, "DOOR_OPEN").when(F.col("k") < 84, "DOOR_CLOSED").otherwise("SHOCK")
    low = 10 + F.col("k") / 10
    fields = {
        "event_id": F.col("event_id").cast("string"),
        "device_id": F.when((F.col("kind") == "error") & (F.col("k") == 0), "").otherwise(F.concat(F.lit("device-"), F.lpad(F.col("user_id").cast("string"), 4, "0"))),
        "event_time": F.col("et"),
        "produced_at": F.when(faulty("produced"), 0).otherwise(F.col("et")),
        "sequence_number": F.when(faulty("sequence"), 0).otherwise(F.col("event_id") + 1),
        "measurement_type": F.when(F.col("kind") == "click", "TEMPERATURE").when(faulty("type"), "PRESSURE").when(F.col("k") < 67, "HUMIDITY").otherwise("BATTERY"),
        "value": F.col("value"),
        "unit": F.when(F.col("kind") == "click", "CELSIUS").otherwise("PERCENT"),
        "signal_strength_dbm": F.when(F.col("event_id") % 2 == 0, -40 - F.col("k")).cast("int"),
        "latitude": (2 * F.col("k") - 90).cast("double"),
        "longitude": F.col("value") - 180,
        "speed_kph": F.col("value"),
        "accuracy_m": F.col("k").cast("double"),
        "detection_type": F.when(faulty("detection"), " ").otherwise(detection),
        "severity": F.when(magnitude > 6, "CRITICAL").when(F.col("k") < 42, "WARNING").otherwise("INFO"),
        "magnitude": magnitude,
        "metadata_version": F.when(faulty("version"), 0).otherwise(F.col("version")),
        "effective_from": F.col("et"),
        "shipment_id": F.concat(F.lit("shipment-"), F.col("user_id").cast("string"), F.lit("-"), (F.col("version") % 3).cast("string")),
        "vehicle_id": F.when(faulty("vehicle"), "").otherwise(F.concat(F.lit("vehicle-"), (F.col("user_id") % 7).cast("string"))),
        "origin": F.lit("Berlin"),
        "destination": F.lit("Paris"),
        "cargo_type": F.lit("vaccines"),
        "min_temperature_c": low,
        "max_temperature_c": F.when(F.col("k") == 13, low).otherwise(11 + F.col("k") / 10 + F.col("value")),
        "status": F.lit("ACTIVE"),
    }
    e = e.withColumn("source_topic", topic)
    record = F.lit(None).cast("string")
    number = F.lit(None).cast("int")
    for name, schema in PAYLOADS.items():
        record = F.when(F.col("source_topic") == name, F.to_json(F.named_struct(*[x for f in schema.names for x in (F.lit(f), fields[f])]))).otherwise(record)
        number = F.when(F.col("source_topic") == name, F.lit(SCHEMA_IDS[name])).otherwise(number)
    delay = F.when(_at(LATE), 900_000).otherwise((F.col("event_id") * 7919) % 60 * 1000)
    parts = F.when(F.col("source_topic") == TELEMETRY, TOPIC_PARTITIONS[TELEMETRY]).otherwise(TOPIC_PARTITIONS[LOCATION])
    cut_off = F.concat(F.lit('{"event_id": "'), F.col("event_id").cast("string"))
    payload = F.when(faulty("tombstone"), F.lit(None).cast("binary")).when(faulty("unframed"), F.lit(MALFORMED)).when(faulty("cut off"), framing.frame(number, cut_off)).otherwise(framing.frame(number, record))
    rows = e.select(
        "event_id", "source_topic", (F.col("user_id") % parts).cast("int").alias("source_partition"), "et", delay.alias("delay"),
        payload.alias("payload"), fields["device_id"].alias("device"),
        F.explode(F.when(_at(AGAIN), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    rows = rows.withColumn("arrival", F.col("et") + F.col("delay") + 1000 * F.col("copy"))
    order = Window.partitionBy("source_topic", "source_partition").orderBy("arrival", "event_id", "copy")
    return rows.select(
        "source_topic", "source_partition", (F.row_number().over(order) - 1).cast("bigint").alias("source_offset"), F.timestamp_millis("et").alias("kafka_timestamp"),
        F.encode("device", "UTF-8").alias("kafka_key"), framing.schema_id("payload").alias("schema_id"), "payload", F.timestamp_millis("arrival").alias("ingested_at"), "arrival",
    )


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw as a stored table, which stands in for the topics: made once for an application, as records are captured once, and
    then read by every query."""
    at = made_once(spark, "captured", f"{sf_dir}/events.parquet", lambda path: raw(spark, sf_dir).write.parquet(path), "_SUCCESS")
    return spark.read.schema(CAPTURED).parquet(at)


def avro_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records with binary bodies; the second telemetry schema where there is a signal strength. What the
    schemas have no symbol for can't be written and is cut off."""

    @F.pandas_udf("binary")
    def encoded(payloads: pd.Series, topics: pd.Series) -> pd.Series:
        out = []
        for p, topic in zip(payloads, topics, strict=True):
            try:
                value = json.loads(bytes(p)[framing.HEADER :]) if p is not None and p[0] == 0 else None
            except json.JSONDecodeError:
                value = {}
            if value is None:
                out.append(p)
                continue
            number = 5 if value.get("signal_strength_dbm") is not None else SCHEMA_IDS[topic]
            try:
                body = avro.write(value, avro.WRITERS[avro.REGISTRY[number]])
            except (ValueError, AttributeError):
                body = b"\x02"
            out.append(b"\0" + number.to_bytes(4, "big") + body)
        return pd.Series(out)

    rows = raw(spark, sf_dir).withColumn("payload", encoded("payload", "source_topic"))
    return rows.withColumn("schema_id", framing.schema_id("payload"))


def manifest(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """What a producer of these records would have counted, from the test table alone and not from the flow."""
    e = events(spark, sf_dir).withColumn("copies", F.when(_at(AGAIN), 2).otherwise(1))
    kind, k, value = F.col("kind"), F.col("k"), F.col("value")
    logical = (
        faulty("sequence") | ((kind == "error") & ((k == 0) | faulty("detection"))) | ((kind != "signup") & faulty("produced")) | ((kind == "view") & faulty("type"))
        | ((kind == "click") & ~value.between(-50, 100)) | ((kind == "view") & ~value.between(0, 100)) | ((kind == "purchase") & ((k > 90) | ~value.between(0, 250)))
        | ((kind == "signup") & (faulty("version", "vehicle") | (k == 13)))
    )
    copies = lambda condition: F.sum(F.when(condition, F.col("copies")).otherwise(0))
    made = e.agg(
        F.sum("copies").alias("produced_total"), (F.sum("copies") - F.count(F.lit(1))).alias("duplicates"), copies(faulty(*UNDECODABLE)).alias("invalid_malformed"), copies(~faulty(*UNDECODABLE) & logical).alias("invalid_logical"),
        copies(_at(LATE)).alias("too_late"), copies(kind != "signup").alias("configured_sensor_events"), F.count_if(_good_signup()).alias("metadata"),
    )
    return made.first().asDict()
