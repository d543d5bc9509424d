"""Registered queries and the SQL that DuckDB runs for the same rows. Times are epoch milliseconds, so that
neither engine's time zone or type of timestamp matters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostlake.operators import decode, enrich, lateness, rejects, validate
from frostlake.plans import reports, texts
from frostlake.plans import stored as stored_queries
from frostlake.plans.batch import Flow
from frostlake.plans.oracles import MANIFEST, flow
from frostlake.sources import avro, fixtures, framing
from frostlake.sources.schemas import METADATA
from frostlake.sources.shared import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(stored_queries.QUERIES) | texts.QUERIES
ORACLES: dict[str, str] = dict(stored_queries.ORACLES) | texts.ORACLES

_PLACE = ["source_topic", "source_partition", "source_offset"]


def _query(name: str, oracle: str | None = None):
    """Registers a function of the flow, whose raw records are a stored table as they are in the lake."""

    def add(build: Callable[[Flow], DataFrame]) -> Callable[[Flow], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Flow(fixtures.captured(spark, sf_dir)))
        if oracle:
            ORACLES[name] = flow(oracle)
        return build

    return add


@_query("raw_capture", "SELECT source_topic, source_partition, source_offset, et AS kafka_ms, arrival AS ingested_ms, device_id AS kafka_key FROM r")
def raw_capture(f: Flow) -> DataFrame:
    return f.raw.select(*_PLACE, F.unix_millis("kafka_timestamp").alias("kafka_ms"), F.unix_millis("ingested_at").alias("ingested_ms"), F.decode("kafka_key", "UTF-8").alias("kafka_key"))


@_query("schema_id_framing", "SELECT source_topic, CASE WHEN NOT unframed AND NOT tombstone THEN CASE source_topic WHEN 'telemetry' THEN 1 WHEN 'location' THEN 2 WHEN 'detection' THEN 3 ELSE 4 END END AS schema_id, count(*) AS records FROM r GROUP BY ALL")
def schema_id_framing(f: Flow) -> DataFrame:
    return f.raw.groupBy("source_topic", framing.schema_id("payload").alias("schema_id")).agg(F.count(F.lit(1)).alias("records"))


@_query("decode_dispatch", "SELECT source_topic, source_partition, source_offset, CAST(event_id AS VARCHAR) AS event_id, device_id, et AS event_time, event_type FROM r WHERE NOT malformed")
def decode_dispatch(f: Flow) -> DataFrame:
    return f.validated.where("decode_code IS NULL").select(*_PLACE, "event_id", "device_id", "event_time", "event_type")


@_query("validate_sensor", "SELECT source_topic, source_partition, source_offset, code AS error_code FROM v WHERE kind <> 'signup' AND NOT malformed")
def validate_sensor(f: Flow) -> DataFrame:
    return f.validated.where((F.col("source_topic") != METADATA) & F.col("decode_code").isNull()).select(*_PLACE, "error_code")


@_query("validate_metadata", "SELECT source_topic, source_partition, source_offset, code AS error_code FROM v WHERE kind = 'signup' AND NOT malformed")
def validate_metadata(f: Flow) -> DataFrame:
    return f.validated.where((F.col("source_topic") == METADATA) & F.col("decode_code").isNull()).select(*_PLACE, "error_code")


@_query("reject_reasons", """SELECT code AS error_code, CASE WHEN code = 'INVALID_MEASUREMENT' THEN CASE WHEN kind = 'click' THEN 'temperature' ELSE lower(event_type) END || ' is outside its valid range' END AS measurement_message, count(*) AS records
    FROM v WHERE code IS NOT NULL GROUP BY ALL""")
def reject_reasons(f: Flow) -> DataFrame:
    bad = rejects.invalid(f.validated)
    return bad.groupBy("error_code", F.when(F.col("error_code") == "INVALID_MEASUREMENT", F.col("error_message")).alias("measurement_message")).agg(F.count(F.lit(1)).alias("records"))


@_query("reject_payloads", """SELECT source_topic, source_partition, source_offset, code AS error_code,
    CASE WHEN tombstone THEN NULL WHEN unframed THEN to_base64('not-confluent-avro'::BLOB)
         ELSE to_base64(('\\x00\\x00\\x00\\x00' || CASE source_topic WHEN 'telemetry' THEN '\\x01' WHEN 'location' THEN '\\x02' WHEN 'detection' THEN '\\x03' ELSE '\\x04' END)::BLOB || encode('{"event_id": "' || event_id)) END AS payload_base64
    FROM v WHERE malformed""")
def reject_payloads(f: Flow) -> DataFrame:
    return rejects.invalid(f.validated).where("error_code IN ('AVRO_DECODE_ERROR', 'NOT_AVRO_RECORD')").select(*_PLACE, "error_code", "payload_base64")


@_query("decode_detections", """SELECT source_topic, source_partition, source_offset, CASE WHEN no_detection THEN ' ' WHEN k < 42 THEN 'DOOR_OPEN' WHEN k < 84 THEN 'DOOR_CLOSED' ELSE 'SHOCK' END AS detection_type,
    CASE WHEN k >= 84 AND value / 10 > 6 THEN 'CRITICAL' WHEN k < 42 THEN 'WARNING' ELSE 'INFO' END AS severity, CASE WHEN k >= 84 THEN value / 10 END AS magnitude
    FROM r WHERE kind = 'error' AND NOT malformed""")
def decode_detections(f: Flow) -> DataFrame:
    return f.validated.where("source_topic = 'detection' AND decode_code IS NULL").select(*_PLACE, "detection_type", "severity", "magnitude")


@_query("decode_locations", "SELECT source_topic, source_partition, source_offset, CAST(2 * k - 90 AS DOUBLE) AS latitude, value - 180 AS longitude, value AS speed_kph, CAST(k AS DOUBLE) AS accuracy_m FROM r WHERE kind = 'purchase' AND NOT malformed")
def decode_locations(f: Flow) -> DataFrame:
    return f.validated.where("source_topic = 'location' AND decode_code IS NULL").select(*_PLACE, "latitude", "longitude", "speed_kph", "accuracy_m")


@_query("dedup_events", "SELECT CAST(event_id AS VARCHAR) AS event_id, arrival, source_topic, source_partition, source_offset FROM dd")
def dedup_events(f: Flow) -> DataFrame:
    return f.sensors.select("event_id", "arrival", *_PLACE)


@_query("metadata_latest", "SELECT event_id, device_id, metadata_version, effective_from, shipment_id, min_temperature_c, max_temperature_c FROM md")
def metadata_latest(f: Flow) -> DataFrame:
    return f.metadata.select("event_id", "device_id", "metadata_version", "effective_from", "shipment_id", "min_temperature_c", "max_temperature_c")


@_query("asof_enrich", "SELECT event_id, device_id, event_time, event_type, metadata_version, shipment_id, breach FROM ej WHERE metadata_version IS NOT NULL")
def asof_enrich(f: Flow) -> DataFrame:
    return f.joined.where("metadata_version IS NOT NULL").select("event_id", "device_id", "event_time", "event_type", "metadata_version", "shipment_id", "breach")


@_query("missing_metadata", "SELECT event_id, device_id, event_time, source_topic FROM ej WHERE metadata_version IS NULL")
def missing_metadata(f: Flow) -> DataFrame:
    return rejects.set_aside(f.joined).where("disposition = 'INVALID'").select("event_id", "device_id", "event_time", "source_topic")


@_query("breach_alerts", "SELECT event_id, device_id, shipment_id, event_time, numeric_value AS measured_temperature_c, 'TEMPERATURE_RANGE_BREACH' AS alert_type FROM en WHERE breach")
def breach_alerts(f: Flow) -> DataFrame:
    return f.alerts


@_query("late_router", "SELECT event_id, event_time, watermark_ms, greatest(0, watermark_ms - event_time) AS lateness_ms FROM lt")
def late_router(f: Flow) -> DataFrame:
    return rejects.set_aside(f.joined).where("disposition = 'TOO_LATE'").select("event_id", "event_time", "watermark_ms", "lateness_ms")


@_query("arrival_watermark", "SELECT source_topic, source_partition, source_offset, watermark_ms FROM r")
def arrival_watermark(f: Flow) -> DataFrame:
    return f.validated.select(*_PLACE, "watermark_ms")


@_query("rejected_union", "SELECT disposition, error_code, event_id, device_id, event_time, source_topic, source_partition, source_offset, lateness_ms, watermark_ms FROM rj")
def rejected_union(f: Flow) -> DataFrame:
    return f.rejected.select("disposition", "error_code", "event_id", "device_id", "event_time", *_PLACE, "lateness_ms", "watermark_ms")


@_query("dlq_feed", "SELECT device_id AS key, event_id, error_code, count(*) AS messages FROM rj WHERE disposition = 'INVALID' GROUP BY ALL")
def dlq_feed(f: Flow) -> DataFrame:
    sent = rejects.feed(f.rejected, rejects.INVALID)
    return sent.select("key", F.get_json_object("value", "$.event_id").alias("event_id"), F.get_json_object("value", "$.error_code").alias("error_code")).groupBy("key", "event_id", "error_code").agg(F.count(F.lit(1)).alias("messages"))


@_query("late_feed", "SELECT device_id AS key, event_id, event_time FROM rj WHERE disposition = 'TOO_LATE'")
def late_feed(f: Flow) -> DataFrame:
    sent = rejects.feed(f.rejected, rejects.TOO_LATE)
    return sent.select("key", F.get_json_object("value", "$.event_id").alias("event_id"), F.get_json_object("value", "$.event_time").cast("bigint").alias("event_time"))


@_query("hourly_metrics", "SELECT * FROM hm")
def hourly_metrics(f: Flow) -> DataFrame:
    return f.hourly


@_query("hourly_temperature", "SELECT shipment_id, window_start, temperature_min, temperature_max, temperature_avg FROM hm WHERE temperature_min IS NOT NULL")
def hourly_temperature(f: Flow) -> DataFrame:
    return f.hourly.where("temperature_min IS NOT NULL").select("shipment_id", "window_start", "temperature_min", "temperature_max", "temperature_avg")


@_query("hourly_latest_location", "SELECT shipment_id, window_start, latest_latitude, latest_longitude, last_event_time FROM hm WHERE latest_latitude IS NOT NULL")
def hourly_latest_location(f: Flow) -> DataFrame:
    return f.hourly.where("latest_latitude IS NOT NULL").select("shipment_id", "window_start", "latest_latitude", "latest_longitude", "last_event_time")


@_query("top_exposure", "SELECT shipment_id, window_start, temperature_min, temperature_max, temperature_avg, breach_count, event_count FROM hm WHERE breach_count > 0 ORDER BY breach_count DESC, window_start DESC, shipment_id LIMIT 50")
def top_exposure(f: Flow) -> DataFrame:
    return reports.top_exposure(f.hourly)


@_query("gps_gaps", """SELECT shipment_id, device_id, previous_event_time, event_time, (event_time - previous_event_time) // 60000 AS gap_minutes, latitude, longitude
    FROM (SELECT *, lag(event_time) OVER (PARTITION BY device_id ORDER BY event_time, event_id) AS previous_event_time FROM en WHERE event_type = 'LOCATION')
    WHERE (event_time - previous_event_time) // 60000 > 10""")
def gps_gaps(f: Flow) -> DataFrame:
    return reports.gps_gaps(f.enriched)


@_query("rejection_rate", """SELECT source_topic, disposition, rejected_count, raw_count, round(rejected_count * 100.0::DOUBLE / raw_count, 3) AS rejected_percent
    FROM (SELECT source_topic, count(*) AS raw_count FROM r GROUP BY 1) JOIN (SELECT source_topic, disposition, count(*) AS rejected_count FROM rj GROUP BY 1, 2) USING (source_topic)""")
def rejection_rate(f: Flow) -> DataFrame:
    return reports.rejection_rate(f.raw, f.rejected)


@_query("current_device_state", """SELECT device_id, shipment_id, vehicle_id, origin, destination, cargo_type, status, min_temperature_c, max_temperature_c, effective_from
    FROM md QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY effective_from DESC, metadata_version DESC) = 1""")
def current_device_state(f: Flow) -> DataFrame:
    return reports.current_device_state(f.metadata)


@_query("raw_uniqueness", "SELECT count(*) AS raw_rows, count(DISTINCT (source_topic, source_partition, source_offset)) AS unique_offsets FROM r")
def raw_uniqueness(f: Flow) -> DataFrame:
    return reports.raw_uniqueness(f.raw)


@_query("enriched_uniqueness", "SELECT count(*) AS enriched_rows, count(DISTINCT event_id) AS unique_event_ids FROM en")
def enriched_uniqueness(f: Flow) -> DataFrame:
    return reports.enriched_uniqueness(f.enriched)


@_query("disposition_counts", "SELECT disposition, error_code, count(*) AS records FROM rj GROUP BY 1, 2")
def disposition_counts(f: Flow) -> DataFrame:
    return reports.disposition_counts(f.rejected)


@_query("gold_totals", "SELECT count(*) AS hourly_rows, CAST(sum(event_count) AS BIGINT) AS aggregated_events, CAST(sum(breach_count) AS BIGINT) AS breaches FROM hm")
def gold_totals(f: Flow) -> DataFrame:
    return reports.gold_totals(f.hourly)


@_query("schema_v2_null_split", "SELECT signal_strength_dbm IS NULL AS is_v1_row, count(*) AS records FROM en GROUP BY 1")
def schema_v2_null_split(f: Flow) -> DataFrame:
    return reports.schema_v2_null_split(f.enriched)


@_query("day_partitions", "SELECT event_time // 86400000 AS epoch_day, count(*) AS record_count FROM en GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def day_partitions(f: Flow) -> DataFrame:
    return reports.day_partitions(f.enriched)


@_query("manifest_counts", """SELECT source_topic, count(*) AS produced_total, count(*) FILTER (NOT malformed) - count(DISTINCT event_id) FILTER (NOT malformed) AS duplicates,
    count(*) FILTER (malformed) AS invalid_malformed, count(*) FILTER (NOT malformed AND code IS NOT NULL) AS invalid_logical FROM v GROUP BY 1""")
def manifest_counts(f: Flow) -> DataFrame:
    return reports.manifest_counts(f.validated)


@_query("operator_counters", """SELECT (SELECT count(*) FROM v WHERE code IS NOT NULL) AS invalid_records, (SELECT count(*) FROM v WHERE code IS NULL AND kind <> 'signup') - (SELECT count(*) FROM dd) AS duplicate_records,
    (SELECT count(*) FROM ej WHERE metadata_version IS NULL) AS missing_metadata_records, (SELECT count(*) FROM lt) AS too_late_records""")
def operator_counters(f: Flow) -> DataFrame:
    valid = f.validated.agg(F.count_if(F.col("error_code").isNotNull()).alias("invalid_records"), F.count_if(F.col("error_code").isNull() & (F.col("source_topic") != METADATA)).alias("sensors"))
    rest = f.joined.agg(F.count(F.lit(1)).alias("first"), F.count_if(lateness.is_missing()).alias("missing_metadata_records"), F.count_if(~lateness.is_missing() & lateness.is_late()).alias("too_late_records"))
    return valid.crossJoin(rest).select("invalid_records", (F.col("sensors") - F.col("first")).alias("duplicate_records"), "missing_metadata_records", "too_late_records")  # single rows


@_query("metadata_validity", """SELECT device_id, metadata_version, effective_from AS valid_from, lead(effective_from) OVER (PARTITION BY device_id ORDER BY effective_from) AS valid_to FROM mt""")
def metadata_validity(f: Flow) -> DataFrame:
    return enrich.validity(f.metadata).select("device_id", F.col("m.metadata_version").alias("metadata_version"), "valid_from", "valid_to")


@_query("hourly_finalized", "SELECT * FROM hm WHERE window_end - 1 <= (SELECT max(et) - 60001 FROM r)")
def hourly_finalized(f: Flow) -> DataFrame:
    return f.finalized


#: Actual numbers from the flow, expected ones from the events alone.
_CHECKS = f""", n AS (SELECT (SELECT count(*) FROM r) AS raw, (SELECT count(*) FROM md) AS meta, (SELECT count(*) FROM v WHERE code IS NOT NULL) AS bad, (SELECT count(*) FROM lt) AS late,
        (SELECT count(*) FROM r) - (SELECT count(DISTINCT (source_topic, source_partition, source_offset)) FROM r) AS raw_again, (SELECT count(*) - count(DISTINCT event_id) FROM en) AS en_again,
        (SELECT count(*) FROM en) AS enr, (SELECT count(*) FROM hm) AS hrs, mf.* FROM {MANIFEST} mf)
    SELECT check_name, CAST(actual AS BIGINT) AS actual, CAST(expected AS BIGINT) AS expected, passed FROM (
    SELECT 'raw_rows' AS check_name, raw AS actual, produced_total AS expected, raw = produced_total AS passed FROM n UNION ALL SELECT 'raw_duplicates', raw_again, 0, raw_again = 0 FROM n
    UNION ALL SELECT 'metadata_rows', meta, metadata, meta = metadata FROM n UNION ALL SELECT 'enriched_duplicates', en_again, 0, en_again = 0 FROM n
    UNION ALL SELECT 'invalid_rows', bad, logical + malformed, bad = logical + malformed FROM n
    UNION ALL SELECT 'late_rows_bound', late, too_late, late <= too_late AND (late > 0 OR too_late = 0) FROM n
    UNION ALL SELECT 'enriched_rows_bound', enr, configured - logical - malformed, enr > 0 AND enr <= configured - logical - malformed FROM n
    UNION ALL SELECT 'hourly_rows_bound', hrs, 1, hrs >= 1 FROM n)"""
#: Of the raw records those that a run with losses would have; a fiftieth of each partition is gone.
_KEPT = "source_offset % 50 <> 0"


def _reconciled(spark: SparkSession, sf_dir: str, kept: str = "true") -> DataFrame:
    f = Flow(stored(fixtures.captured(spark, sf_dir).where(kept))).store_joined()
    return reports.reconcile(f.raw, f.metadata, f.enriched, f.rejected, f.hourly, fixtures.manifest(spark, sf_dir))


def reconcile_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow's results against what the producer counted."""
    return _reconciled(spark, sf_dir)


def reconcile_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a run that lost records, which the checks must tell."""
    return _reconciled(spark, sf_dir, _KEPT)


def decode_avro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with binary bodies through the decoder and the rules."""
    got = validate.validate(decode.decode(fixtures.avro_raw(spark, sf_dir), avro.record()))
    return got.select(*_PLACE, "error_code", "schema_id", *[F.when(F.col("decode_code").isNull(), F.col(c)).alias(c) for c in ("event_id", "device_id", "event_time", "event_type", "numeric_value", "signal_strength_dbm", "latitude", "severity", "metadata_version")])


QUERIES |= {"reconcile_checks": reconcile_checks, "reconcile_losses": reconcile_losses, "decode_avro": decode_avro}
ORACLES |= {
    "reconcile_checks": flow(_CHECKS),
    "reconcile_losses": flow(_CHECKS, _KEPT),
    "decode_avro": flow("""SELECT source_topic, source_partition, source_offset, CASE WHEN bad AND NOT tombstone THEN 'AVRO_DECODE_ERROR' ELSE code END AS error_code,
        CASE WHEN unframed OR tombstone THEN NULL WHEN kind IN ('click', 'view') THEN CASE WHEN event_id % 2 = 0 AND NOT cut_off THEN 5 ELSE 1 END WHEN kind = 'purchase' THEN 2 WHEN kind = 'error' THEN 3 ELSE 4 END AS schema_id,
        CASE WHEN NOT bad THEN CAST(event_id AS VARCHAR) END AS event_id, CASE WHEN NOT bad THEN device_id END AS device_id, CASE WHEN NOT bad THEN et END AS event_time, CASE WHEN NOT bad THEN event_type END AS event_type,
        CASE WHEN NOT bad AND kind IN ('click', 'view') THEN value END AS numeric_value, CASE WHEN NOT bad AND kind IN ('click', 'view') AND event_id % 2 = 0 THEN -40 - k END AS signal_strength_dbm,
        CASE WHEN NOT bad AND kind = 'purchase' THEN CAST(2 * k - 90 AS DOUBLE) END AS latitude, CASE WHEN NOT bad AND kind = 'error' THEN CASE WHEN k >= 84 AND value / 10 > 6 THEN 'CRITICAL' WHEN k < 42 THEN 'WARNING' ELSE 'INFO' END END AS severity,
        CASE WHEN NOT bad AND kind = 'signup' THEN CASE WHEN no_version THEN 0 ELSE CAST(version AS INT) END END AS metadata_version
        FROM (SELECT *, malformed OR no_type OR no_detection AS bad FROM v)"""),
}
