"""SQL for the rows of the registered queries, from the test tables themselves."""

from __future__ import annotations

#: The flow as common table expressions: fx (records with copies), v (validated, with watermark), md (metadata history),
#: dd (first deliveries), ej (as-of joined), en (enriched in time), lt (late), rj (rejected), hm (hourly).
FLOW = r"""
WITH ev AS (
    SELECT event_id, user_id, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 1000 AS et,
           event_id % 211 = 0 AS unframed, event_id % 419 = 3 AS tombstone, event_id % 431 = 5 AS cut_off, unframed OR tombstone OR cut_off AS malformed,
           event_id % 307 = 5 AS no_sequence, event_id % 223 = 9 AND event_type <> 'signup' AS no_time, event_id % 101 = 7 AND event_type = 'view' AS no_type, event_id % 53 = 3 AND event_type = 'error' AS no_detection,
           event_id % 61 = 2 AND event_type = 'signup' AS no_version, event_id % 67 = 3 AND event_type = 'signup' AS no_vehicle,
           event_type = 'signup' AND NOT (malformed OR no_sequence OR no_version OR no_vehicle) AND k <> 13 AS good_signup
    FROM events),
fx AS (
    SELECT *, 'device-' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS device,
           CASE WHEN kind IN ('click', 'view') THEN 'telemetry' WHEN kind = 'purchase' THEN 'location' WHEN kind = 'error' THEN 'detection' ELSE 'metadata' END AS source_topic,
           greatest(1, sum(CASE WHEN good_signup THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY et, event_id)) AS version,
           et + CASE WHEN event_id % 97 = 0 THEN 900000 ELSE (event_id * 7919) % 60 * 1000 END AS came
    FROM ev),
rw AS (
    SELECT fx.*, c.copy, CAST(user_id % CASE WHEN source_topic = 'telemetry' THEN 6 ELSE 3 END AS INT) AS source_partition, came + 1000 * c.copy AS arrival
    FROM fx JOIN (SELECT 0 AS copy UNION ALL SELECT 1) c ON c.copy = 0 OR event_id % 100 = 1),
ro AS (
    SELECT *, row_number() OVER (PARTITION BY source_topic, source_partition ORDER BY arrival, event_id, copy) - 1 AS source_offset
    FROM rw),
r AS (
    SELECT *, max(et) OVER (ORDER BY arrival, source_topic, source_partition, source_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 60001 AS watermark_ms,
           CASE WHEN kind = 'click' THEN 'TELEMETRY_TEMPERATURE' WHEN no_type THEN 'TELEMETRY_PRESSURE' WHEN kind = 'view' AND k < 67 THEN 'TELEMETRY_HUMIDITY' WHEN kind = 'view' THEN 'TELEMETRY_BATTERY'
                WHEN kind = 'purchase' THEN 'LOCATION' WHEN kind = 'error' THEN 'DETECTION' END AS event_type,
           CASE WHEN kind = 'error' AND k = 0 THEN '' ELSE device END AS device_id
    FROM ro WHERE /*kept*/ true),
v AS (
    SELECT *, CASE WHEN tombstone THEN 'NOT_AVRO_RECORD' WHEN malformed THEN 'AVRO_DECODE_ERROR' WHEN device_id = '' THEN 'MISSING_IDENTITY' WHEN no_sequence THEN 'INVALID_SEQUENCE'
        WHEN no_version THEN 'INVALID_METADATA_VERSION' WHEN no_vehicle THEN 'INVALID_METADATA' WHEN no_type THEN 'UNKNOWN_EVENT_TYPE' WHEN no_time THEN 'INVALID_TIMESTAMP'
        WHEN kind = 'click' AND NOT value BETWEEN -50 AND 100 THEN 'INVALID_MEASUREMENT'
        WHEN kind = 'view' AND NOT value BETWEEN 0 AND 100 THEN 'INVALID_MEASUREMENT'
        WHEN kind = 'purchase' AND NOT (2 * k - 90 BETWEEN -90 AND 90 AND value - 180 BETWEEN -180 AND 180) THEN 'INVALID_COORDINATES'
        WHEN kind = 'purchase' AND NOT (value BETWEEN 0 AND 250 AND k BETWEEN 0 AND 10000) THEN 'INVALID_LOCATION_READING'
        WHEN no_detection THEN 'INVALID_DETECTION' WHEN kind = 'signup' AND k = 13 THEN 'INVALID_TEMPERATURE_RANGE' END AS code
    FROM r),
md AS (
    SELECT CAST(event_id AS VARCHAR) AS event_id, device_id, CAST(version AS INT) AS metadata_version, et AS effective_from, 'shipment-' || user_id || '-' || (version % 3)::INT AS shipment_id,
           'vehicle-' || (user_id % 7) AS vehicle_id, 'Berlin' AS origin, 'Paris' AS destination, 'vaccines' AS cargo_type, 'ACTIVE' AS status,
           10 + k::DOUBLE / 10 AS min_temperature_c, 11 + k::DOUBLE / 10 + value AS max_temperature_c, source_topic, source_partition, source_offset
    FROM v WHERE code IS NULL AND kind = 'signup'
    QUALIFY row_number() OVER (PARTITION BY device_id, version ORDER BY arrival DESC, source_topic DESC, source_partition DESC, source_offset DESC) = 1),
dd AS (
    SELECT * FROM v WHERE code IS NULL AND kind <> 'signup'
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival, source_topic, source_partition, source_offset) = 1),
mt AS (SELECT * FROM md QUALIFY row_number() OVER (PARTITION BY device_id, effective_from ORDER BY metadata_version DESC) = 1),
ej AS (
    SELECT CAST(dd.event_id AS VARCHAR) AS event_id, dd.device_id, dd.et AS event_time, dd.event_type, dd.kind, dd.k, dd.value, dd.arrival,
           dd.source_topic, dd.source_partition, dd.source_offset, dd.watermark_ms, m.metadata_version, m.shipment_id,
           CASE WHEN dd.kind IN ('click', 'view') THEN dd.value END AS numeric_value,
           CASE WHEN dd.kind = 'purchase' THEN CAST(2 * dd.k - 90 AS DOUBLE) END AS latitude, CASE WHEN dd.kind = 'purchase' THEN dd.value - 180 END AS longitude,
           CASE WHEN dd.kind IN ('click', 'view') AND dd.event_id % 2 = 0 THEN -40 - dd.k END AS signal_strength_dbm,
           coalesce(dd.kind = 'click' AND (dd.value < m.min_temperature_c OR dd.value > m.max_temperature_c), false) AS breach
    FROM dd ASOF LEFT JOIN mt m ON dd.device_id = m.device_id AND dd.et >= m.effective_from),
en AS (SELECT * FROM ej WHERE metadata_version IS NOT NULL AND NOT coalesce(event_time < watermark_ms - 300000, false)),
lt AS (SELECT * FROM ej WHERE metadata_version IS NOT NULL AND coalesce(event_time < watermark_ms - 300000, false)),
rj AS (
    SELECT 'INVALID' AS disposition, code AS error_code, CASE WHEN NOT malformed AND kind <> 'signup' THEN CAST(event_id AS VARCHAR) END AS event_id,
           CASE WHEN NOT malformed AND kind <> 'signup' THEN device_id END AS device_id, CASE WHEN NOT malformed AND kind <> 'signup' THEN et END AS event_time,
           source_topic, source_partition, source_offset, CAST(NULL AS BIGINT) AS lateness_ms, CAST(NULL AS BIGINT) AS watermark_ms
    FROM v WHERE code IS NOT NULL
    UNION ALL SELECT 'INVALID', 'MISSING_METADATA', event_id, device_id, event_time, source_topic, source_partition, source_offset, NULL, NULL FROM ej WHERE metadata_version IS NULL
    UNION ALL SELECT 'TOO_LATE', 'EVENT_TIME_TOO_OLD', event_id, device_id, event_time, source_topic, source_partition, source_offset, greatest(0, watermark_ms - event_time), watermark_ms FROM lt),
hm AS (
    SELECT shipment_id, event_time // 3600000 * 3600000 AS window_start, event_time // 3600000 * 3600000 + 3600000 AS window_end,
           min(numeric_value) FILTER (event_type = 'TELEMETRY_TEMPERATURE') AS temperature_min, max(numeric_value) FILTER (event_type = 'TELEMETRY_TEMPERATURE') AS temperature_max,
           round(CAST(sum(CAST(numeric_value AS DECIMAL(28, 6))) FILTER (event_type = 'TELEMETRY_TEMPERATURE') AS DOUBLE) / count(*) FILTER (event_type = 'TELEMETRY_TEMPERATURE'), 6) AS temperature_avg,
           round(CAST(sum(CAST(numeric_value AS DECIMAL(28, 6))) FILTER (event_type = 'TELEMETRY_HUMIDITY') AS DOUBLE) / count(*) FILTER (event_type = 'TELEMETRY_HUMIDITY'), 6) AS humidity_avg,
           count(*) FILTER (event_type = 'DETECTION') AS detection_count, count(*) FILTER (breach) AS breach_count, count(*) AS event_count,
           arg_max(latitude, (event_time, arrival, source_topic, source_partition, source_offset)) FILTER (latitude IS NOT NULL) AS latest_latitude,
           arg_max(longitude, (event_time, arrival, source_topic, source_partition, source_offset)) FILTER (latitude IS NOT NULL) AS latest_longitude, max(event_time) AS last_event_time
    FROM en GROUP BY shipment_id, event_time // 3600000)
"""


#: What a producer would have counted, from the events alone.
MANIFEST = """(SELECT CAST(sum(copies) AS BIGINT) AS produced_total, CAST(sum(copies) - count(*) AS BIGINT) AS duplicates, CAST(sum(copies) FILTER (malformed) AS BIGINT) AS malformed,
    CAST(sum(copies) FILTER (NOT malformed AND (no_sequence OR no_time OR no_type OR no_detection OR no_version OR no_vehicle OR (kind = 'error' AND k = 0) OR (kind = 'click' AND value > 100)
        OR (kind = 'view' AND value > 100) OR (kind = 'purchase' AND (k > 90 OR value > 250)) OR (kind = 'signup' AND k = 13))) AS BIGINT) AS logical,
    CAST(sum(copies) FILTER (event_id % 97 = 0) AS BIGINT) AS too_late, CAST(sum(copies) FILTER (kind <> 'signup') AS BIGINT) AS configured, count(*) FILTER (good_signup) AS metadata
    FROM (SELECT *, CASE WHEN event_id % 100 = 1 THEN 2 ELSE 1 END AS copies FROM ev))"""


def flow(select: str, kept: str = "true") -> str:
    """kept: a condition on the raw records that get into the flow."""
    return FLOW.replace("/*kept*/ true", kept) + select
