"""The analytical surface as SQL texts over views of the lake's tables, and its metadata as tables.

The lake is written once a session for each folder of test tables; every text then reads what is stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostlake.plans import rows
from frostlake.plans.batch import Flow
from frostlake.plans.oracles import flow
from frostlake.sources import fixtures
from frostlake.sources.shared import made_once, scratch
from frostlake.sources.tables import Lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def written(f: Flow, lake: Lake) -> Lake:
    """All tables of a flow."""
    f.store_joined()
    lake["bronze.raw_events"].append(rows.bronze(f.raw))
    lake["silver.device_metadata_history"].upsert(rows.metadata_history(f.metadata))
    lake["silver.enriched_events"].upsert(rows.enriched(f.enriched), ["processed_at"])
    lake["silver.rejected_events"].append(rows.rejected(f.rejected))
    lake["gold.shipment_hourly_metrics"].upsert(rows.hourly(f.hourly))
    return lake


def _lake(spark: SparkSession, sf_dir: str) -> Lake:
    make = lambda path: written(Flow(fixtures.captured(spark, sf_dir)), Lake(spark, path))
    return Lake(spark, made_once(spark, "lake", f"{sf_dir}/events.parquet", make))


def _text(name: str, sql: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _lake(spark, sf_dir).register()
        return spark.sql(sql)

    QUERIES[name], ORACLES[name] = run, flow(oracle)


# Texts ---------------------------------------------------------------------------------------------------------

_text(
    "sql_top_exposure",
    """SELECT shipment_id, unix_millis(window_start) AS window_start, temperature_max, breach_count, event_count
       FROM gold_shipment_hourly_metrics WHERE breach_count > 0 ORDER BY breach_count DESC, 2 DESC, shipment_id LIMIT 50""",
    "SELECT shipment_id, window_start, temperature_max, breach_count, event_count FROM hm WHERE breach_count > 0 ORDER BY breach_count DESC, window_start DESC, shipment_id LIMIT 50",
)
_text(
    "sql_gps_gaps",
    """WITH places AS (
           SELECT shipment_id, device_id, event_time, lag(event_time) OVER (PARTITION BY device_id ORDER BY event_time, event_id) AS last_seen
           FROM silver_enriched_events WHERE event_type = 'LOCATION')
       SELECT shipment_id, device_id, unix_millis(last_seen) AS previous_event_time, unix_millis(event_time) AS event_time, timestampdiff(MINUTE, last_seen, event_time) AS gap_minutes
       FROM places WHERE timestampdiff(MINUTE, last_seen, event_time) > 10 ORDER BY gap_minutes DESC NULLS LAST""",
    """SELECT shipment_id, device_id, previous_event_time, event_time, (event_time - previous_event_time) // 60000 AS gap_minutes
       FROM (SELECT *, lag(event_time) OVER (PARTITION BY device_id ORDER BY event_time, event_id) AS previous_event_time FROM en WHERE event_type = 'LOCATION')
       WHERE (event_time - previous_event_time) // 60000 > 10""",
)
_text(
    "sql_rejection_rate",
    """WITH came AS (SELECT source_topic, count(*) AS raw_count FROM bronze_raw_events GROUP BY 1),
            gone AS (SELECT source_topic, disposition, count(*) AS rejected_count FROM silver_rejected_events GROUP BY 1, 2)
       SELECT source_topic, disposition, rejected_count, raw_count, round(rejected_count * 100D / raw_count, 3) AS rejected_percent
       FROM came JOIN gone USING (source_topic) ORDER BY rejected_percent DESC NULLS LAST""",
    """SELECT source_topic, disposition, rejected_count, raw_count, round(rejected_count * 100.0::DOUBLE / raw_count, 3) AS rejected_percent
       FROM (SELECT source_topic, count(*) AS raw_count FROM r GROUP BY 1) JOIN (SELECT source_topic, disposition, count(*) AS rejected_count FROM rj GROUP BY 1, 2) USING (source_topic)""",
)
_text(
    "sql_device_state",
    """SELECT device_id, shipment_id, vehicle_id, cargo_type, status, unix_millis(effective_from) AS effective_from
       FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY effective_from DESC, metadata_version DESC) AS age FROM silver_device_metadata_history)
       WHERE age = 1 ORDER BY shipment_id NULLS LAST""",
    "SELECT device_id, shipment_id, vehicle_id, cargo_type, status, effective_from FROM md QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY effective_from DESC, metadata_version DESC) = 1",
)
_text(
    "sql_raw_uniqueness",
    "SELECT count(*) AS raw_rows, count(DISTINCT struct(source_topic, source_partition, source_offset)) AS unique_offsets FROM bronze_raw_events",
    "SELECT count(*) AS raw_rows, count(DISTINCT (source_topic, source_partition, source_offset)) AS unique_offsets FROM r",
)
_text(
    "sql_enriched_uniqueness",
    "SELECT count(*) AS enriched_rows, count(DISTINCT event_id) AS unique_event_ids FROM silver_enriched_events",
    "SELECT count(*) AS enriched_rows, count(DISTINCT event_id) AS unique_event_ids FROM en",
)
_text(
    "sql_dispositions",
    "SELECT disposition, error_code, count(*) AS records FROM silver_rejected_events GROUP BY 1, 2 ORDER BY 1 NULLS LAST, 3 DESC",
    "SELECT disposition, error_code, count(*) AS records FROM rj GROUP BY 1, 2",
)
_text(
    "sql_gold_totals",
    "SELECT count(*) AS hourly_rows, sum(event_count) AS aggregated_events, sum(breach_count) AS breaches FROM gold_shipment_hourly_metrics",
    "SELECT count(*) AS hourly_rows, CAST(sum(event_count) AS BIGINT) AS aggregated_events, CAST(sum(breach_count) AS BIGINT) AS breaches FROM hm",
)
_text(
    "sql_schema_split",
    "SELECT signal_strength_dbm IS NULL AS is_v1_row, count(*) AS records FROM silver_enriched_events GROUP BY 1 ORDER BY 1",
    "SELECT signal_strength_dbm IS NULL AS is_v1_row, count(*) AS records FROM en GROUP BY 1",
)


# Metadata and maintenance --------------------------------------------------------------------------------------


def _table(name: str, oracle: str):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLES[name] = build, oracle
        return build

    return add


@_table("table_list", "SELECT * FROM (VALUES ('bronze', 'raw_events'), ('gold', 'shipment_hourly_metrics'), ('silver', 'device_metadata_history'), ('silver', 'enriched_events'), ('silver', 'rejected_events')) t(table_schema, table_name)")
def table_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lake(spark, sf_dir).tables()


@_table("table_snapshots", flow("SELECT 0 AS snapshot_id, CAST(NULL AS BIGINT) AS parent_id, 'create' AS operation, CAST(NULL AS BIGINT) AS added_rows UNION ALL SELECT 1, 0, 'append', count(*) FROM rj"))
def table_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of the table of rejects, newest first."""
    got = _lake(spark, sf_dir)["silver.rejected_events"].snapshots().orderBy(F.col("committed_ms").desc())
    return got.select("snapshot_id", "parent_id", "operation", F.try_element_at("summary", F.lit("added_rows")).cast("bigint").alias("added_rows"))


@_table("table_partitions", flow("""SELECT '{"event_day": "' || strftime(make_timestamp(event_time * 1000), '%Y-%m-%d') || '"}' AS partition, count(*) AS record_count FROM en GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"""))
def table_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest partitions by the table's own metadata, without reading its rows."""
    return _lake(spark, sf_dir)["silver.enriched_events"].partitions().orderBy(F.col("record_count").desc(), "partition").limit(25).select("partition", "record_count")


@_table("column_evolution", flow("SELECT coalesce(CAST(event_time // 86400000 AS INT), -1) AS epoch_day, count(*) AS records, count(*) FILTER (breach) AS noted FROM en GROUP BY 1"))
def column_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column added to a table with rows: old rows are null in it, rows upserted since have it."""
    events = _lake(spark, sf_dir)["silver.enriched_events"].read()
    table = Lake(spark, scratch(spark))["silver.enriched_events"]
    table.upsert(events, ["processed_at"])
    table.add_column("note", "string")
    table.upsert(events.where("breach").withColumn("note", F.lit("seen")), ["processed_at"])
    return table.read().groupBy(F.unix_date("event_day").alias("epoch_day")).agg(F.count(F.lit(1)).alias("records"), F.count("note").alias("noted"))


@_table("partition_evolution", flow("SELECT event_type, count(*) AS records, 2 AS layouts FROM en GROUP BY 1"))
def partition_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days first, then days and buckets of devices; both layouts are read as one table."""
    events = _lake(spark, sf_dir)["silver.enriched_events"].read()
    table = Lake(spark, scratch(spark))["silver.enriched_events"]
    table.append(events.where("source_offset % 2 = 0"))
    table.set_partitioning("to_date(event_time)", "pmod(hash(device_id), 8)")
    table.append(events.where("source_offset % 2 <> 0"))
    layouts = len({tuple(sorted(f["values"])) for f in table.snapshot().files})
    return table.read().groupBy("event_type").agg(F.count(F.lit(1)).alias("records")).withColumn("layouts", F.lit(layouts))


@_table("snapshot_expiry", flow("SELECT 1 AS versions_left, count(*) AS row_count, true AS orphans_removed FROM rj"))
def snapshot_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction, then expiry of all versions but the newest, then removal of the files that only they had."""
    gone = _lake(spark, sf_dir)["silver.rejected_events"].read()
    table = Lake(spark, scratch(spark))["silver.rejected_events"]
    for part in range(2):
        table.append(gone.where(F.col("source_offset") % 2 == part))
    table.optimize()
    far = 1 << 53
    table.expire_snapshots(0, now_ms=far)
    removed = len(table.remove_orphans(0, now_ms=far))
    return table.read().agg(F.lit(len(table.versions())).alias("versions_left"), F.count(F.lit(1)).alias("row_count"), F.lit(removed > 0).alias("orphans_removed"))
