"""The telemetry operators on hand-made records."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frostlake.operators import decode, dedup, enrich, hourly, lateness, rejects, validate
from frostlake.plans import reports
from frostlake.sources import fixtures, framing, shared
from frostlake.sources.schemas import PAYLOADS, RAW, SCHEMA_IDS
from tests.conftest import DATA

T0 = 1_700_000_000_000
TELEMETRY = {"event_id": "event-1", "device_id": "device-1", "event_time": T0, "produced_at": T0, "sequence_number": 1, "measurement_type": "TEMPERATURE", "value": 5.5, "unit": "CELSIUS"}
LOCATION = {"event_id": "event-2", "device_id": "device-1", "event_time": T0, "produced_at": T0, "sequence_number": 1, "latitude": 52.5, "longitude": 13.4, "speed_kph": 70.0, "accuracy_m": 5.0}
DETECTION = {"event_id": "event-3", "device_id": "device-1", "event_time": T0, "produced_at": T0, "sequence_number": 1, "detection_type": "SHOCK", "severity": "INFO", "magnitude": 1.0}
METADATA = {"event_id": "meta-1", "device_id": "device-1", "event_time": T0, "produced_at": T0, "sequence_number": 1, "metadata_version": 1, "effective_from": 1000, "shipment_id": "s", "vehicle_id": "v", "origin": "o", "destination": "d", "cargo_type": "c", "min_temperature_c": 2.0, "max_temperature_c": 8.0, "status": "ACTIVE"}
BASE = {"telemetry": TELEMETRY, "location": LOCATION, "detection": DETECTION, "metadata": METADATA}


def framed(topic: str, value: dict) -> bytes:
    return b"\0" + SCHEMA_IDS.get(topic, 9).to_bytes(4, "big") + json.dumps(value).encode()


def raw(spark, records: list[tuple[str, bytes | None]]):
    rows = [(t, 0, i, None, None, None, bytearray(p) if p is not None else None, None) for i, (t, p) in enumerate(records)]
    return spark.createDataFrame(rows, RAW).withColumn("schema_id", framing.schema_id("payload")).withColumn("arrival", F.col("source_offset"))


def codes(spark, changes: list[tuple[str, dict]]):
    got = validate.validate(decode.decode(raw(spark, [(t, framed(t, BASE[t] | c)) for t, c in changes]))).orderBy("source_offset").collect()
    return [(r.error_code, r.error_message) for r in got]


def test_framing(spark):
    payloads = [None, b"\0\0\0\0", b"\0\0\0\0\x2a\x99", b"not-confluent-avro", b"\0\xff\xff\xff\xff"]
    got = raw(spark, [("telemetry", p) for p in payloads]).orderBy("source_offset").collect()
    assert [r.schema_id for r in got] == [None, None, 42, None, -1]


def test_rules_in_order(spark):
    nan = float("nan")
    cases = [
        ("telemetry", {}, None), ("telemetry", {"value": 10000.0}, "INVALID_MEASUREMENT"), ("telemetry", {"value": 100.0}, None), ("telemetry", {"value": -50.01}, "INVALID_MEASUREMENT"),
        ("telemetry", {"measurement_type": "HUMIDITY", "value": -1.0}, "INVALID_MEASUREMENT"), ("telemetry", {"measurement_type": "PRESSURE"}, "UNKNOWN_EVENT_TYPE"),
        ("telemetry", {"event_id": " \t "}, "MISSING_IDENTITY"), ("telemetry", {"device_id": "", "sequence_number": 0}, "MISSING_IDENTITY"), ("telemetry", {"sequence_number": 0, "value": 1e9}, "INVALID_SEQUENCE"),
        ("telemetry", {"event_time": 0}, "INVALID_TIMESTAMP"), ("location", {"latitude": 200.0, "speed_kph": 999.0}, "INVALID_COORDINATES"), ("location", {"speed_kph": 250.5}, "INVALID_LOCATION_READING"),
        ("location", {"latitude": -90.0, "longitude": 180.0, "speed_kph": 0.0, "accuracy_m": 10000.0}, None), ("detection", {"detection_type": " "}, "INVALID_DETECTION"), ("detection", {"magnitude": None}, None),
        ("metadata", {"metadata_version": 0}, "INVALID_METADATA_VERSION"), ("metadata", {"effective_from": 0}, "INVALID_METADATA"), ("metadata", {"vehicle_id": ""}, "INVALID_METADATA"),
        ("metadata", {"min_temperature_c": 8.0}, "INVALID_TEMPERATURE_RANGE"), ("metadata", {"event_time": 0}, None),
    ]
    got = codes(spark, [(t, c) for t, c, _ in cases])
    assert [c for c, _ in got] == [e for *_, e in cases]
    assert got[1][1] == "temperature is outside its valid range" and got[4][1] == "telemetry_humidity is outside its valid range"
    assert not spark.range(1).select(F.lit(nan).alias("x")).select(validate.within("x", 0, 1)).first()[0]


def test_undecodable_records_are_told_and_kept(spark):
    records = [("telemetry", None), ("telemetry", b"not-confluent-avro"), ("telemetry", b"\0\0\0\0\1{broken"), ("elsewhere", framed("telemetry", TELEMETRY)), ("telemetry", framed("telemetry", {k: v for k, v in TELEMETRY.items() if k != "value"})), ("telemetry", b"\0\0\0\0\1" + b"x" * 100)]
    bad = rejects.invalid(validate.validate(decode.decode(raw(spark, records)))).orderBy("source_offset").collect()
    assert [r.error_code for r in bad] == ["NOT_AVRO_RECORD"] + ["AVRO_DECODE_ERROR"] * 5
    assert bad[1].payload_base64 == "bm90LWNvbmZsdWVudC1hdnJv" and "\n" not in bad[5].payload_base64 and bad[0].event_id is None


def test_versions_of_telemetry(spark):
    got = decode.decode(raw(spark, [("telemetry", framed("telemetry", TELEMETRY)), ("telemetry", framed("telemetry", TELEMETRY | {"signal_strength_dbm": -78}))])).orderBy("source_offset").collect()
    assert [r.signal_strength_dbm for r in got] == [None, -78] and got[0].event_type == "TELEMETRY_TEMPERATURE"


def events(spark, rows: list[dict]):
    names = {"event_id": "string", "device_id": "string", "event_time": "bigint", "event_type": "string", "numeric_value": "double", "latitude": "double", "longitude": "double", "arrival": "bigint", "source_topic": "string", "source_partition": "int", "source_offset": "bigint", "shipment_id": "string", "breach": "boolean"}
    return spark.createDataFrame([tuple({"device_id": "d", "source_topic": "telemetry", "source_partition": 0, "arrival": i, "source_offset": i, "event_id": str(i), "shipment_id": "s", "breach": False, **r}.get(n) for n in names) for i, r in enumerate(rows)], ", ".join(f"{n} {t}" for n, t in names.items()))


def metadata(spark, rows: list[tuple]):
    schema = "device_id string, metadata_version int, effective_from bigint, shipment_id string, vehicle_id string, origin string, destination string, cargo_type string, min_temperature_c double, max_temperature_c double"
    return spark.createDataFrame([(d, v, e, f"s{v}", "v", "o", "d", "c", lo, hi) for d, v, e, lo, hi in rows], schema)


def test_as_of_and_breach(spark):
    known = metadata(spark, [("d", 1, 1000, 2.0, 8.0), ("d", 2, 2000, 2.0, 8.0), ("d", 4, 3000, 2.0, 8.0), ("d", 3, 3000, 0.0, 1.0), ("n", 1, 0, float("nan"), float("nan"))])
    kind = {"event_type": "TELEMETRY_TEMPERATURE"}
    rows = [kind | {"event_time": t, "numeric_value": x} for t, x in ((1500, 12.0), (2500, 8.0), (999, 5.0), (1000, 2.0), (3000, 1.9), (5000, None))] + [kind | {"event_time": 5, "numeric_value": 99.0, "device_id": "n"}, {"event_type": "LOCATION", "event_time": 1500}]
    got = enrich.as_of(events(spark, rows).drop("breach", "shipment_id"), known).orderBy("arrival").collect()
    assert [r.metadata_version for r in got] == [1, 2, None, 1, 4, 4, 1, 1]
    assert [r.breach for r in got] == [True, False, False, False, True, False, False, False]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 6)), min_size=1, max_size=6), st.lists(st.integers(0, 7), min_size=1, max_size=5))
def test_as_of_is_the_linear_scan(spark, versions, times):
    held = {v: e for v, e in versions}
    got = enrich.as_of(events(spark, [{"event_time": t, "event_type": "LOCATION"} for t in times]).drop("breach", "shipment_id"), metadata(spark, [("d", v, e, 0.0, 1.0) for v, e in held.items()])).orderBy("arrival").collect()
    best = [max(((e, v) for v, e in held.items() if e <= t), default=(None, None))[1] for t in times]
    assert [r.metadata_version for r in got] == best


def test_as_of_over_many_slots(spark):
    day = enrich.SLOT_MS
    held = {1: 5, 2: 3 * day, 3: 3 * day + 7, 4: 4 * day, 5: 9 * day}
    times = [1, 5, day, 2 * day + 1, 3 * day - 1, 3 * day, 3 * day + 6, 3 * day + 7, 4 * day - 1, 4 * day, 4 * day + 1, 8 * day, 9 * day, 400 * day]
    rows = events(spark, [{"event_time": t, "event_type": "LOCATION"} for t in times]).drop("breach", "shipment_id")
    known = metadata(spark, [("d", v, e, 0.0, 1.0) for v, e in held.items()])
    got = enrich.as_of(rows, known).orderBy("arrival").collect()
    assert [r.metadata_version for r in got] == [max((v for v, e in held.items() if e <= t), default=None) for t in times]
    assert enrich.slotted(known, rows).count() <= len(held) + len({t // day for t in times})


def test_place_gaps_of_any_identifier(spark):
    rows = events(spark, [{"event_id": i, "event_time": t, "event_type": "LOCATION", "latitude": 1.0, "longitude": 2.0} for i, t in (("evt-42-1", 0), ("b8a7-x", 660_000), ("c", 1_319_999))])
    assert [(r.previous_event_time, r.gap_minutes) for r in reports.gps_gaps(rows).collect()] == [(0, 11)]


def test_hourly(spark):
    rows = [{"event_type": "TELEMETRY_TEMPERATURE", "event_time": 1000, "numeric_value": 4.0}, {"event_type": "TELEMETRY_TEMPERATURE", "event_time": 2000, "numeric_value": 10.0, "breach": True}, {"event_type": "TELEMETRY_HUMIDITY", "event_time": 3000, "numeric_value": 60.0}, {"event_type": "LOCATION", "event_time": 4000, "latitude": 52.5, "longitude": 13.4}, {"event_type": "LOCATION", "event_time": 4000, "latitude": 53.0, "longitude": 14.0}, {"event_type": "DETECTION", "event_time": 3_600_000}]
    one, two = hourly.hourly_metrics(events(spark, rows)).orderBy("window_start").collect()
    assert (one.event_count, one.temperature_min, one.temperature_max, one.temperature_avg, one.humidity_avg, one.breach_count) == (5, 4.0, 10.0, 7.0, 60.0, 1)
    assert (one.latest_latitude, one.last_event_time, one.window_end) == (53.0, 4000, 3_600_000)
    assert two.temperature_avg is None and two.detection_count == 1 and two.latest_latitude is None
    assert [r.event_id for r in hourly.alerts(events(spark, rows)).collect()] == ["1"]


def test_watermark_and_late_boundary(spark):
    rows = spark.createDataFrame([(i, "t", 0, i, k) for i, k in enumerate([0, 2_000_000, 1_000_000, 2_000_001])], "arrival bigint, source_topic string, source_partition int, source_offset bigint, k bigint")
    got = lateness.with_watermark(rows.withColumn("kafka_timestamp", F.timestamp_millis("k"))).orderBy("arrival").collect()
    assert [r.watermark_ms for r in got] == [None, -60_001, 1_939_999, 1_939_999]
    spread = rows.withColumns({"arrival": F.col("arrival") * 5_000_000, "kafka_timestamp": F.timestamp_millis("k")})
    assert [r.watermark_ms for r in lateness.with_watermark(spread).orderBy("arrival").collect()] == [None, -60_001, 1_939_999, 1_939_999]
    none = rows.withColumns({"arrival": F.when(F.col("k") != 1_000_000, F.col("arrival") * 5_000_000), "kafka_timestamp": F.timestamp_millis("k")})
    kept = lateness.with_watermark(none).orderBy("source_offset").collect()
    assert [r.watermark_ms for r in kept] == [939_999, 939_999, None, 1_939_999]  # the row without arrival is the first
    edge = spark.createDataFrame([(700_000, 1_000_000), (699_999, 1_000_000), (0, None)], "event_time bigint, watermark_ms bigint")
    assert [r[0] for r in edge.select(lateness.is_late()).collect()] == [False, True, False]


def test_dedup_keeps_the_first_to_arrive(spark):
    rows = events(spark, [{"event_id": "a", "arrival": 5}, {"event_id": "a", "arrival": 3}, {"event_id": "b"}])
    assert sorted((r.event_id, r.arrival) for r in dedup.first_delivery(rows).collect()) == [("a", 3), ("b", 2)]


def test_distinct_places_count_nulls(spark):
    rows = spark.createDataFrame([("t", 0, None), ("t", 0, None), ("t", 0, 1)], "source_topic string, source_partition int, source_offset bigint")
    assert tuple(reports.raw_uniqueness(rows).first()) == (3, 2)


def test_contracts():
    common = PAYLOADS["telemetry"].names[:5]
    assert all(s.names[:5] == common for s in PAYLOADS.values()) and PAYLOADS["telemetry"]["signal_strength_dbm"].nullable


QUICK = ["schema_id_framing", "reject_reasons", "rejected_union", "hourly_metrics", "gps_gaps", "rejection_rate", "current_device_state", "reconcile_checks", "reconcile_losses", "decode_avro", "sql_gps_gaps", "table_partitions", "snapshot_expiry"]


@pytest.mark.parametrize("name", QUICK)
def test_queries_match_their_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry
    from tests.conftest import DATA

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = entry.queries()[name](spark, DATA)
    assert sorted(names) == sorted(got.columns)
    plain = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())


def test_capture_is_made_once_and_again_where_it_has_gone(spark, tmp_path):
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "events.parquet"))
    made = []

    def make(path):
        made.append(path)
        spark.range(3).write.parquet(path)

    source = str(tmp_path / "events.parquet")
    first = shared.made_once(spark, "test", source, make, "_SUCCESS")
    assert shared.made_once(spark, "test", source, make, "_SUCCESS") == first and len(made) == 1
    assert shared.made_once(spark, "other", source, make, "_SUCCESS") != first
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(first)
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    again = shared.made_once(spark, "test", source, make, "_SUCCESS")
    assert again != first and spark.read.parquet(again).count() == 3
    # Other files under the same name are another source.
    spark.createDataFrame([(2,)], "x int").write.mode("overwrite").parquet(source)
    assert shared.made_once(spark, "test", source, make, "_SUCCESS") != again


def test_captured_equals_raw(spark):
    captured, made = fixtures.captured(spark, DATA), fixtures.raw(spark, DATA)
    assert captured.columns == made.columns and captured.count() == made.count()
    assert captured.exceptAll(made).isEmpty() and made.exceptAll(captured).isEmpty()
