"""The streaming queries against the batch flow on the same records."""

from __future__ import annotations

import time
from types import SimpleNamespace

from pyspark.sql import functions as F

from frostlake.operators import hourly
from frostlake.plans import stored
from frostlake.plans.batch import Flow
from frostlake.sources import simulator
from frostlake.sources.schemas import METADATA as METADATA_TOPIC
from frostlake.sources.schemas import RAW
from frostlake.sources.tables import Lake
from frostlake.streaming import jobs, processors
from tests.test_avro import framed as binary
from tests.test_flow import BASE, TELEMETRY, framed, raw


def until(condition, seconds: int = 150) -> None:
    end = time.time() + seconds
    while not condition():
        assert time.time() < end, "the stream did not get there in time"
        time.sleep(1)


COLUMNS = ["source_topic", "source_partition", "source_offset", "kafka_timestamp", "kafka_key", "schema_id", "payload", "ingested_at"]


def hours(rows):
    return {(r.shipment_id, r.window_start): (r.event_count, r.breach_count) for r in rows}


def test_ingest_and_refine_at_once_reach_the_batch_result(spark, tmp_path):
    p = simulator.Profile(event_count=25, device_count=2, duplicate_rate=0.2, invalid_rate=0.2, out_of_order_rate=0.0, too_late_rate=0.0)
    simulator.records(spark, p).select(*COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/made")
    made = spark.read.parquet(f"{tmp_path}/made")
    # Metadata first, for what a stream knows of it when an event comes is final; then one event long before the rest.
    old = framed("telemetry", TELEMETRY | {"event_id": "old", "device_id": "device-0001", "event_time": p.start_ms - 3_000_000, "value": 5.0})
    extra = spark.createDataFrame([("telemetry", 9, 0, None, None, 1, bytearray(old), None)], RAW).withColumns({"kafka_timestamp": F.timestamp_millis(F.lit(p.start_ms + 9)), "ingested_at": F.timestamp_millis(F.lit(p.start_ms + 90_000_000))})
    parts = [made.where("source_topic = 'metadata'"), made.where("source_topic <> 'metadata'"), extra.select(*COLUMNS)]
    lake, counters = Lake(spark, f"file://{tmp_path}/lake"), jobs.Counters()
    spark.streams.addListener(counters)
    (tmp_path / "in").mkdir()
    feed = jobs.folder_feed(f"{tmp_path}/feeds")
    one = jobs.ingest(jobs.raw_stream(spark, f"{tmp_path}/in", 1), lake, feed, f"{tmp_path}/c1", codec="json")
    two = jobs.refine(jobs.bronze_stream(spark, lake, 1), lake, feed, f"{tmp_path}/c2", codec="json")
    try:
        total = 0
        for n, part in enumerate(parts):
            part.coalesce(1).write.parquet(f"{tmp_path}/next{n}")
            (next((tmp_path / f"next{n}").glob("*.parquet"))).rename(tmp_path / "in" / f"{n}.parquet")
            total += part.count()
            until(lambda: lake["bronze.raw_events"].read().count() == total)
            if n == 0:
                until(lambda: two.lastProgress and two.lastProgress["batchId"] >= 0 and lake["silver.enriched_events"].snapshot().marks.get("refine", -1) >= 0)
        raw = spark.read.parquet(f"{tmp_path}/in").withColumn("arrival", F.unix_millis("ingested_at"))
        flow = Flow(raw).store_joined()
        want = sorted(r.event_id for r in flow.enriched.select("event_id").collect())
        until(lambda: lake["silver.enriched_events"].read().count() >= len(want))
        until(lambda: (lake["gold.shipment_hourly_metrics"].read().agg(F.sum("event_count")).first()[0] or 0) >= len(want))
        until(lambda: lake["silver.rejected_events"].read().where("disposition = 'TOO_LATE'").count() == 1)
        until(lambda: counters.told()["too_late_records"] == 1)
    finally:
        one.stop()
        two.stop()
        spark.streams.removeListener(counters)
    assert not one.exception() and not two.exception()
    got = lake["silver.enriched_events"].read()
    assert sorted(r.event_id for r in got.select("event_id").collect()) == want and "old" not in want
    told = lake["gold.shipment_hourly_metrics"].read().withColumn("window_start", F.unix_millis("window_start")).collect()
    assert hours(told) == hours(flow.hourly.collect())
    count = lambda rows: sorted((r.disposition, r.error_code, r["count"]) for r in rows.groupBy("disposition", "error_code").count().collect())
    assert count(lake["silver.rejected_events"].read()) == count(flow.rejected)
    bad = flow.validated.where("error_code IS NOT NULL").count()
    repeated = flow.validated.where("error_code IS NULL AND source_topic <> 'metadata'").count() - flow.sensors.count()
    assert bad > 0 and repeated > 0 and counters.told() == {"invalid_records": bad, "duplicate_records": repeated, "missing_metadata_records": 0, "too_late_records": 1}
    messages = spark.read.json(f"{tmp_path}/feeds/dlq-ingest", schema="key string, value string").select(F.get_json_object("value", "$.rejected_at").alias("at"))
    assert messages.count() == bad and messages.where("at IS NULL").count() == 0
    alerts = spark.read.json(f"{tmp_path}/feeds/breaches", schema="key string, value string")
    assert alerts.where(F.get_json_object("value", "$.emitted_at").isNull()).count() == 0 and alerts.count() == flow.alerts.count()


def test_replayed_batch_changes_nothing(spark, tmp_path):
    p = simulator.Profile(event_count=20, device_count=2)
    simulator.records(spark, p).drop("category", "duplicate", "id").write.parquet(f"{tmp_path}/in")
    batch = jobs.classified(spark.read.parquet(f"{tmp_path}/in"), "json")
    lake = Lake(spark, f"file://{tmp_path}/lake").create()
    write = jobs.ingest_batch(lake, jobs.folder_feed(f"{tmp_path}/feeds"))
    write(batch, 0)
    before = {n: lake[n].versions() for n in ("bronze.raw_events", "silver.device_metadata_history", "silver.rejected_events")}
    write(batch, 0)
    assert before == {n: lake[n].versions() for n in before}
    # The folder that streams read holds the batch once, and nothing of compaction's.
    lake["bronze.raw_events"].append(lake["bronze.raw_events"].read())
    lake["bronze.raw_events"].optimize()
    tail = spark.read.option("recursiveFileLookup", "true").parquet(lake["bronze.raw_events"].tail("ingest"))
    assert tail.count() == batch.count()


def test_binary_records_of_a_batch(spark, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}/lake").create()
    good = [(t, binary(n, BASE[t])) for n, t in ((1, "telemetry"), (2, "location"), (3, "detection"), (4, "metadata"))]
    rows = raw(spark, [*good, ("telemetry", b"\0\0\0\0\1{}")]).withColumns({"ingested_at": F.timestamp_millis(F.lit(5)), "kafka_timestamp": F.timestamp_millis(F.lit(5))})
    jobs.ingest_batch(lake, jobs.folder_feed(f"{tmp_path}/feeds"))(jobs.classified(rows, "avro"), 0)
    assert lake["silver.rejected_events"].read().count() == 1 and lake["silver.device_metadata_history"].read().first().shipment_id == "s"


class Held:
    """Stands for the state and the timers of one key."""

    def __init__(self) -> None:
        self.map, self.list, self.timers = {}, [], []

    def getMapState(self, *_):  # noqa: N802
        held = self.map
        return type("Map", (), {"updateValue": lambda _, k, v: held.__setitem__(k, v), "iterator": lambda _: iter(held.items())})()

    def getListState(self, *_):  # noqa: N802
        held = self.list
        return type("List", (), {"exists": lambda _: bool(held), "get": lambda _: iter(list(held)), "put": lambda _, v: held.__setitem__(slice(None), v), "clear": lambda _: held.clear()})()

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def listTimers(self):  # noqa: N802
        return iter(self.timers)


def test_events_wait_for_metadata_and_leave_when_the_timer_expires():
    now = type("Now", (), {"getCurrentProcessingTimeInMs": lambda _: 1000, "getCurrentWatermarkInMs": lambda _: 0})()
    event = lambda i, at: processors._row({"source_topic": "telemetry", "event_id": i, "device_id": "d", "event_time": at})
    version = lambda n, at: processors._row({"source_topic": METADATA_TOPIC, "device_id": "d", "metadata_version": n, "effective_from": at, "shipment_id": f"s{n}"})
    state, enrich = Held(), processors.Enrich()
    enrich.init(state)
    assert list(enrich.handleInputRows(("d",), iter([event("a", 50), event("b", 150)]), now)) == []
    assert state.timers == [1000 + processors.WAIT_MS]
    got = list(enrich.handleInputRows(("d",), iter([event("c", 120), version(1, 100)]), now))
    assert {(r.event_id, r.metadata_version, r.shipment_id) for r in got} == {("b", 1, "s1"), ("c", 1, "s1")}
    assert list(enrich.handleInputRows(("d",), iter([event("e", 60)]), now)) == [] and len(state.timers) == 1
    left = list(enrich.handleExpiredTimer(key=("d",), timerValues=now, expiredTimerInfo=None))
    assert {(r.event_id, r.metadata_version) for r in left} == {("a", None), ("e", None)} and state.list == []


def test_first_deliveries_share_a_call_of_the_state():
    now = type("Now", (), {"getCurrentWatermarkInMs": lambda _: 70})()
    event = lambda i, arrival, offset=0: processors.Row(*processors.EVENT.names, "_key")(*[{"arrival": arrival, "source_topic": "t", "source_partition": 0, "source_offset": offset, "event_id": i}.get(n) for n in processors.EVENT.names], i)
    calls = []
    held = []
    seen = type("Seen", (), {"get": lambda _: iter(list(held)), "appendValue": lambda _, v: (calls.append(v), held.append(v))})()
    first = processors.FirstDelivery()
    first.init(type("Handle", (), {"getListState": lambda *_, **__: seen})())
    batch = [event(f"e\",{i}", at, at) for at in (2, 1) for i in range(500)]
    got = list(first.handleInputRows((7,), iter(batch), now))
    assert sorted((r.event_id, r.arrival, r.watermark_ms) for r in got) == sorted((f"e\",{i}", 1, 70) for i in range(500)) and len(calls) == 1
    again = list(first.handleInputRows((7,), iter([event("e\",3", 0), event("new", 9)]), now))
    assert [r.event_id for r in again] == ["new"] and len(calls) == 2
    assert list(first.handleInputRows((7,), iter([event("new", 0)]), now)) == [] and len(calls) == 2


def test_a_long_batch_is_waited_for(monkeypatch):
    clock = [0.0]
    monkeypatch.setattr(stored, "time", SimpleNamespace(time=lambda: clock[0], sleep=lambda s: clock.__setitem__(0, clock[0] + 100)))

    class Slow:
        """Its first batch ends after 2,000 seconds."""

        isActive, stopped = True, False  # noqa: N815
        recentProgress = property(lambda _: [{"numInputRows": n} for n, at in ((9, 2000), (0, 2100)) if clock[0] >= at])  # noqa: N815

        def exception(self):
            return None

        def stop(self):
            self.stopped = True

    query = Slow()
    stored._drained(query)
    assert query.stopped and clock[0] >= 2100


def test_kafka_columns(spark):
    schema = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, timestampType int"
    got = spark.createDataFrame([(bytearray(b"d"), bytearray(b"\0\0\0\0\2x"), "location", 3, 7, None, 0), (None, None, "metadata", 0, 0, None, 0)], schema)
    rows = jobs.from_kafka(got).orderBy("source_offset").collect()
    assert [(r.source_topic, r.source_partition, r.source_offset, r.schema_id) for r in rows] == [("metadata", 0, 0, None), ("location", 3, 7, 2)] and rows[1].ingested_at is not None
    assert sorted(rows[0].asDict()) == sorted(f.name for f in RAW.fields)
    sent = jobs.to_kafka(spark.createDataFrame([("d", "{}"), (None, "{}")], "key string, value string"))
    assert [f.dataType.typeName() for f in sent.schema] == ["binary", "binary"]


def test_closed_windows_only(spark):
    rows = spark.createDataFrame([("s", 0, 3_600_000), ("s", 3_600_000, 7_200_000)], "shipment_id string, window_start long, window_end long")
    assert [hourly.finalized(rows, at).count() for at in (None, 3_599_998, 3_599_999, 7_200_000)] == [0, 0, 1, 2]


def test_producer_keeps_to_its_rate(spark, tmp_path):
    p = simulator.Profile(event_count=30, device_count=2, events_per_second=10, duplicate_rate=0.0)
    began = time.time()
    query = simulator.produce(spark, p, f"{tmp_path}/in", f"{tmp_path}/check")
    try:
        until(lambda: len(list((tmp_path / "in").glob("batch=2/_SUCCESS"))) == 1)
    finally:
        query.stop()
    assert time.time() - began > 1.9
    read = lambda at: spark.read.parquet(f"{tmp_path}/in/batch={at}")
    assert read("metadata").count() == 2 and [read(n).count() for n in range(3)] == [10, 10, 10]
