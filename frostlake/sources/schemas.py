"""Record contracts, table definitions and session settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TELEMETRY, LOCATION, DETECTION, METADATA = "telemetry", "location", "detection", "metadata"
SENSOR_TOPICS = (TELEMETRY, LOCATION, DETECTION)
#: Partitions of each input topic.
TOPIC_PARTITIONS = {TELEMETRY: 6, LOCATION: 3, DETECTION: 3, METADATA: 3}
#: Registry ids of the payload schemas.
SCHEMA_IDS = {TELEMETRY: 1, LOCATION: 2, DETECTION: 3, METADATA: 4}

SESSION = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(), "date": T.DateType()}


def _struct(text: str) -> T.StructType:
    """A schema from "name kind, ..."; needs no session, unlike Spark's own parser."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(","))])


COMMON = "event_id string, device_id string, event_time bigint, produced_at bigint, sequence_number bigint"
#: Payload fields by topic. The second telemetry version adds signal_strength_dbm, null in rows of the first.
PAYLOADS = {
    TELEMETRY: _struct(COMMON + ", measurement_type string, value double, unit string, signal_strength_dbm int"),
    LOCATION: _struct(COMMON + ", latitude double, longitude double, speed_kph double, accuracy_m double"),
    DETECTION: _struct(COMMON + ", detection_type string, severity string, magnitude double"),
    METADATA: _struct(COMMON + ", metadata_version int, effective_from bigint, shipment_id string, vehicle_id string, origin string, destination string, cargo_type string, min_temperature_c double, max_temperature_c double, status string"),
}
#: All fields of all topics, for one decoding expression.
SUPERSET = T.StructType(list({f.name: f for s in PAYLOADS.values() for f in s.fields}.values()))

RAW = _struct("source_topic string, source_partition int, source_offset bigint, kafka_timestamp timestamp, kafka_key binary, schema_id int, payload binary, ingested_at timestamp")


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    partition: tuple[str, ...] = ()
    #: Columns that identify a row of an upsert table; none for append tables.
    key: tuple[str, ...] = ()


_SOURCE = "source_topic string, source_partition int, source_offset bigint"
TABLES = {
    t.name: t
    for t in (
        Table("bronze.raw_events", _struct(_SOURCE + ", kafka_timestamp timestamp, kafka_key binary, schema_id int, payload binary, ingested_at timestamp, kafka_day date"), ("kafka_day",)),
        Table(
            "silver.device_metadata_history",
            _struct("event_id string, device_id string, metadata_version int, effective_from timestamp, shipment_id string, vehicle_id string, origin string, destination string, cargo_type string, min_temperature_c double, max_temperature_c double, status string, " + _SOURCE + ", ingested_at timestamp"),
            # An upsert rewrites the buckets of its devices, not the history.
            ("pmod(hash(device_id), 16)",),
            ("device_id", "metadata_version"),
        ),
        Table(
            "silver.enriched_events",
            _struct(
                "event_id string, device_id string, shipment_id string, vehicle_id string, origin string, destination string, cargo_type string, metadata_version int, event_time timestamp, produced_at timestamp, sequence_number bigint, event_type string, numeric_value double, unit string, latitude double, longitude double, speed_kph double, accuracy_m double, detection_type string, severity string, magnitude double, breach boolean, "
                + _SOURCE
                + ", ingested_at timestamp, processed_at timestamp, event_day date, signal_strength_dbm int"
            ),
            ("event_day",),
            ("event_id", "event_day"),
        ),
        Table(
            "silver.rejected_events",
            _struct("disposition string, error_code string, error_message string, event_id string, device_id string, event_time timestamp, " + _SOURCE + ", kafka_timestamp timestamp, schema_id int, payload_base64 string, lateness_ms bigint, watermark_ms bigint, rejected_at timestamp, rejected_day date"),
            ("rejected_day",),
        ),
        Table(
            "gold.shipment_hourly_metrics",
            _struct("shipment_id string, window_start timestamp, window_end timestamp, temperature_min double, temperature_max double, temperature_avg double, humidity_avg double, detection_count bigint, breach_count bigint, event_count bigint, latest_latitude double, latest_longitude double, last_event_time timestamp, updated_at timestamp, window_day date"),
            ("window_day",),
            ("shipment_id", "window_start", "window_day"),
        ),
    )
}
