"""Registered queries that write tables or run streams, and read back what they converge to."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from frostlake.plans import rows
from frostlake.plans.batch import Flow
from frostlake.plans.oracles import flow
from frostlake.sources import fixtures
from frostlake.sources.schemas import METADATA, SENSOR_TOPICS
from frostlake.sources.shared import scratch
from frostlake.sources.tables import Lake
from frostlake.streaming import jobs
from frostlake.streaming.processors import EVENT, first_deliveries


def _flow(spark: SparkSession, sf_dir: str) -> Flow:
    return Flow(fixtures.captured(spark, sf_dir))


def upsert_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits: all versions, then every second one again; the history holds each once."""
    f = _flow(spark, sf_dir)
    table = Lake(spark, scratch(spark))["silver.device_metadata_history"]
    table.upsert(rows.metadata_history(f.metadata))
    table.upsert(rows.metadata_history(f.metadata.where("metadata_version % 2 = 0")))
    return table.read().select("event_id", "device_id", "metadata_version", F.unix_millis("effective_from").alias("effective_from"), "shipment_id", "max_temperature_c")


def upsert_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flow(spark, sf_dir).store_joined()
    table = Lake(spark, scratch(spark))["silver.enriched_events"]
    table.upsert(rows.enriched(f.enriched), ["processed_at"])
    table.upsert(rows.enriched(f.enriched.where("event_type = 'DETECTION'")), ["processed_at"])
    return table.read().select("event_id", F.unix_millis("event_time").alias("event_time"), "metadata_version", "breach")


def time_travel_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each version of the history: versions 1 first, then all."""
    f = _flow(spark, sf_dir)
    table = Lake(spark, scratch(spark))["silver.device_metadata_history"]
    one = table.upsert(rows.metadata_history(f.metadata.where("metadata_version = 1")))
    two = table.upsert(rows.metadata_history(f.metadata))
    counted = [table.read(version=s.version).agg(F.lit(i).alias("version_number"), F.count(F.lit(1)).alias("row_count")) for i, s in enumerate((one, two))]
    return counted[0].unionByName(counted[1])


def compaction_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and their hash before and after small files are put together, and whether there are fewer files."""
    f = _flow(spark, sf_dir)
    table = Lake(spark, scratch(spark))["bronze.raw_events"]
    for topics in ((METADATA,), SENSOR_TOPICS):
        table.append(rows.bronze(f.raw.where(F.col("source_topic").isin(*topics))))
    before = table.snapshot()
    after = table.optimize()
    made = lambda v: table.read(version=v).agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.xxhash64("source_topic", "source_partition", "source_offset").cast("decimal(38,0)")).alias("h"))
    both = made(before.version).join(made(after.version).select("h", F.col("row_count").alias("rows_after")), "h")
    return both.select("row_count", "rows_after", F.lit(len(after.files) < len(before.files)).alias("fewer_files"))


def _drained(query: StreamingQuery) -> None:
    """Waits until the stream has nothing new to read, however long its batches take, and stops it. All input is there before
    it starts."""
    try:
        while True:
            if query.exception():
                raise query.exception()
            seen = query.recentProgress
            if seen and seen[-1]["numInputRows"] == 0:
                return
            if not query.isActive:
                raise RuntimeError("the stream ended before it was drained")
            time.sleep(0.5)
    finally:
        query.stop()


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor events through the keyed state of first deliveries."""
    at = scratch(spark)
    f = _flow(spark, sf_dir)
    valid = f.validated.where(F.col("error_code").isNull() & F.col("source_topic").isin(*SENSOR_TOPICS))
    shaped = valid.withColumn("watermark_ms", F.lit(None).cast("bigint")).select("kafka_timestamp", *[F.col(x.name).cast(x.dataType).alias(x.name) for x in EVENT.fields])
    shaped.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(shaped.schema).parquet(f"{at}/in").withWatermark("kafka_timestamp", "60 seconds")
    first = first_deliveries(stream, F.col("event_id"))
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        _drained(first.writeStream.outputMode("append").option("checkpointLocation", f"{at}/check").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}")).start())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    return spark.read.parquet(f"{at}/out").select("event_id", "event_time", "event_type")


def stream_hourly(spark: SparkSession, sf_dir: str, seconds: int = 600) -> DataFrame:
    """Hourly metrics of a stream of enriched events, each update replacing the last of its key."""
    at = scratch(spark)
    f = _flow(spark, sf_dir)
    f.enriched.withColumn("event_ts", F.timestamp_millis("event_time")).repartition(2).write.parquet(f"{at}/in")
    made = spark.read.parquet(f"{at}/in")
    counted = jobs.hourly_stream(spark.readStream.schema(made.schema).parquet(f"{at}/in"))
    query = counted.writeStream.outputMode("update").option("checkpointLocation", f"{at}/check").foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{at}/out/b={n}")).trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError("the stream was not done in time")
    if query.exception():
        raise query.exception()
    told = spark.read.schema(StructType([*counted.schema.fields, StructField("n", IntegerType())])).parquet(f"{at}/out")
    last = told.groupBy("shipment_id", "window_start").agg(F.max_by(F.struct(*[c for c in counted.columns if c not in ("shipment_id", "window_start")]), "n").alias("x"))
    return last.select("shipment_id", "window_start", "x.*")


QUERIES = {
    "upsert_metadata": upsert_metadata,
    "upsert_enriched": upsert_enriched,
    "time_travel_count": time_travel_count,
    "compaction_invariance": compaction_invariance,
    "stream_dedup": stream_dedup,
    "stream_hourly": stream_hourly,
}
ORACLES = {
    "upsert_metadata": flow("SELECT event_id, device_id, metadata_version, effective_from, shipment_id, max_temperature_c FROM md"),
    "upsert_enriched": flow("SELECT event_id, event_time, metadata_version, breach FROM en"),
    "time_travel_count": flow("SELECT 0 AS version_number, count(*) FILTER (metadata_version = 1) AS row_count FROM md UNION ALL SELECT 1, count(*) FROM md"),
    "compaction_invariance": flow("SELECT count(*) AS row_count, count(*) AS rows_after, true AS fewer_files FROM r"),
    "stream_dedup": flow("SELECT CAST(event_id AS VARCHAR) AS event_id, et AS event_time, event_type FROM dd"),
    "stream_hourly": flow("SELECT * FROM hm"),
}
