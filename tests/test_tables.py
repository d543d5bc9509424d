"""Versioned tables, the simulator, and reconciliation."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from frostlake.plans import reports, rows
from frostlake.plans.batch import Flow
from frostlake.sources import simulator
from frostlake.sources.schemas import _struct
from frostlake.sources.tables import Conflict, Lake, LakeTable, Table

KEYED = Table("silver.things", _struct("k int, day string, v int"), ("day",), ("k", "day"))


@pytest.fixture
def things(spark, tmp_path):
    return LakeTable(spark, f"file://{tmp_path}", KEYED).create()


def made(spark, data):
    return spark.createDataFrame(data, "k int, day string, v int")


def content(table, **at):
    return sorted(tuple(r) for r in table.read(**at).select("k", "day", "v").collect())


def test_upsert_time_travel_and_replay(spark, things):
    first = things.upsert(made(spark, [(1, "a", 1), (2, "b", 1), (1, "a", 0)]), ["v"], ("job", 0))
    things.upsert(made(spark, [(1, "a", 2), (3, "a", 2)]), ["v"], ("job", 1))
    assert content(things) == [(1, "a", 2), (2, "b", 1), (3, "a", 2)] and content(things, version=first.version) == [(1, "a", 1), (2, "b", 1)]
    again = things.upsert(made(spark, [(1, "a", 9)]), ["v"], ("job", 1))
    assert again.version == first.version + 1 and things.snapshots().count() == 3
    assert {(r.partition, r.record_count) for r in things.partitions().collect()} == {('{"day": "a"}', 2), ('{"day": "b"}', 1)}
    assert things.read(where={"day": "b"}).count() == 1
    with pytest.raises(ValueError):
        things.read(version=99)


def test_compaction_expiry_orphans_and_evolution(spark, things):
    for i in range(3):
        things.append(made(spark, [(i, "a", i)]))
    before = content(things)
    assert things.optimize().operation == "replace" and content(things) == before and len(things.snapshot().files) == 1
    assert things.expire_snapshots(0, now_ms=2**53) == [0, 1, 2, 3] and things.versions() == [4]
    assert len(things.remove_orphans(0, now_ms=2**53)) == 3 and content(things) == before and things.remove_orphans() == []
    things.add_column("w", "int")
    things.set_partitioning("day", "pmod(hash(k), 8)")
    things.append(spark.createDataFrame([(9, "a", 9, 7)], "k int, day string, v int, w int"))
    assert sorted((r.k, r.w) for r in things.read().collect()) == [(0, None), (1, None), (2, None), (9, 7)]
    things.upsert(made(spark, [(1, "a", 5), (9, "a", 6)]))
    assert content(things) == [(0, "a", 0), (1, "a", 5), (2, "a", 2), (9, "a", 6)]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    table = LakeTable(spark, f"file://{tmp_path}", KEYED).create()
    batches = [made(spark, [(10 * w + i, "ab"[i % 2], w) for i in range(4)]) for w in range(4)]
    failures = []

    def run(w: int) -> None:
        own = LakeTable(spark, f"file://{tmp_path}", KEYED)
        try:
            (own.upsert if w % 2 else own.append)(batches[w], mark=(f"writer{w}", 0))
        except Exception as e:  # noqa: BLE001
            failures.append(e)

    threads = [threading.Thread(target=run, args=(w,)) for w in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures and [k for k, *_ in content(table)] == [10 * w + i for w in range(4) for i in range(4)]
    base = table.snapshot()
    table._commit("append", list(base.files), {}, base)
    with pytest.raises(Conflict):
        table._commit("append", list(base.files), {}, base)


def test_published_batch_is_not_written_again(spark, things):
    """A batch that was published but not committed before a failure is committed as it is."""
    things._write(made(spark, [(1, "a", 1)]), things.schema(), ("day",), f"data/job/{0:020d}")
    things.append(made(spark, [(1, "a", 1)]), ("job", 0))
    things.append(made(spark, [(1, "a", 1)]), ("job", 0))
    assert content(things) == [(1, "a", 1)] and len(things.versions()) == 2


def test_profiles():
    assert simulator.profile("demo", event_count=10).event_count == 10 and simulator.PROFILES["benchmark"].event_count == 300_000
    assert [simulator.PROFILES[n].events_per_second for n in ("demo", "benchmark")] == [500, 1000]
    for name in ("duplicate_rate", "invalid_rate", "out_of_order_rate", "too_late_rate"):
        with pytest.raises(ValueError):
            simulator.Profile(**{name: 1.1})


def test_simulated_run_reconciles(spark, tmp_path):
    p = simulator.Profile(event_count=400, device_count=5, duplicate_rate=0.1, invalid_rate=0.1, out_of_order_rate=0.1, too_late_rate=0.1, schema_version=2)
    records = simulator.records(spark, p).persist()
    assert records.exceptAll(simulator.records(spark, p)).count() == 0
    assert records.where("category = 'metadata'").count() == 5 and records.where("duplicate").count() > 10
    signal = records.where("source_topic <> 'telemetry' AND category <> 'invalid_malformed'").where(F.decode("payload", "UTF-8").contains("signal_strength"))
    assert signal.count() == 0
    counters = simulator.manifest(records, p)
    arrival = F.when(F.col("category") == "metadata", F.lit(0)).otherwise(F.lit(p.start_ms) + F.col("id") * (p.span_seconds * 1000 // p.event_count) + F.col("duplicate").cast("int"))
    flow = Flow(records.withColumn("arrival", arrival)).store_joined()
    lake = Lake(spark, f"file://{tmp_path}")
    lake["bronze.raw_events"].append(rows.bronze(flow.raw))
    lake["silver.device_metadata_history"].upsert(rows.metadata_history(flow.metadata))
    lake["silver.enriched_events"].upsert(rows.enriched(flow.enriched), ["processed_at"])
    lake["silver.rejected_events"].append(rows.rejected(flow.rejected))
    lake["gold.shipment_hourly_metrics"].upsert(rows.hourly(flow.hourly))
    names = ("bronze.raw_events", "silver.device_metadata_history", "silver.enriched_events", "silver.rejected_events", "gold.shipment_hourly_metrics")
    checks = reports.reconcile(*[lake[n].read() for n in names], counters).collect()
    assert len(checks) == 8 and all(r.passed for r in checks), checks
    # Every check but the loosest fails for some damage: lost, repeated and misjudged rows.
    bronze, history, events, gone, hours = [lake[n].read() for n in names]
    damaged = [(bronze.where("source_offset % 9 <> 0"), history, events, gone, hours), (bronze.unionByName(bronze.limit(1)), history.limit(3), events.unionByName(events.limit(1)), gone.limit(1), hours.limit(0)), (bronze, history, events.limit(0), gone.where("disposition = 'INVALID'"), hours)]
    failed = {r.check_name for tables in damaged for r in reports.reconcile(*tables, counters).collect() if not r.passed}
    assert failed == {r.check_name for r in checks}
    assert lake.tables().count() == 5
    records.unpersist()
