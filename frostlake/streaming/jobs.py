"""The two streaming queries: ingest (stateless, raw to bronze, metadata and invalid rows) and refine (stateful, bronze
to silver, gold, alerts). Each micro-batch writes with its own mark, so a replayed one changes nothing, and both may run
at once: they share the table of rejects, whose commits start again when the other was first."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from frostlake.operators import decode, dedup, enrich, hourly, lateness, rejects, validate
from frostlake.plans import rows
from frostlake.sources import avro, framing
from frostlake.sources.schemas import METADATA, RAW, TABLES
from frostlake.sources.tables import Lake, LakeTable
from frostlake.streaming.processors import EVENT, Enrich, first_deliveries

#: How bodies are encoded: binary by the registered schemas, or JSON.
CODECS: dict[str, Callable[[], Column]] = {"avro": avro.record, "json": decode.json_record}
#: (name, messages with key and value, batch) to wherever a batch's messages go.
Feed = Callable[[str, DataFrame, int], None]


# Sources and feeds ---------------------------------------------------------------------------------------------


def raw_stream(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """RAW records from a folder of Parquet files, oldest first."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files).parquet(path)


def from_kafka(got: DataFrame) -> DataFrame:
    """RAW records of the columns that Spark's Kafka source has."""
    return got.select(
        F.col("topic").alias("source_topic"), F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"), F.col("timestamp").alias("kafka_timestamp"),
        F.col("key").alias("kafka_key"), framing.schema_id("value").alias("schema_id"), F.col("value").alias("payload"), F.current_timestamp().alias("ingested_at"),
    )


def kafka_stream(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """RAW records from Kafka, committed ones only, from the beginning; needs Spark's Kafka connector."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topics, "startingOffsets": "earliest", "kafka.isolation.level": "read_committed"}
    return from_kafka(spark.readStream.format("kafka").options(**options).load())


def folder_feed(path: str) -> Feed:
    """JSON lines below a folder; a batch's are written again in full if the batch is."""
    return lambda name, messages, batch: messages.write.mode("overwrite").json(f"{path}/{name}/batch={batch}")


def to_kafka(messages: DataFrame) -> DataFrame:
    """key and value as Spark's Kafka sink takes them."""
    return messages.select(F.encode("key", "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value"))


def kafka_feed(servers: str, topics: dict[str, str]) -> Feed:
    """To the topic of each feed, at least once; needs Spark's Kafka connector. Consumers tell a replayed message by its
    event_id and error_code."""
    return lambda name, messages, batch: to_kafka(messages).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topics[name]).save()


# Counters ------------------------------------------------------------------------------------------------------


class Counters(StreamingQueryListener):
    """Totals of what the queries observe: register it with spark.streams.addListener before they start."""

    def __init__(self) -> None:
        self.totals: Counter = Counter()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for row in event.progress.observedMetrics.values():
            self.totals.update({k: v or 0 for k, v in row.asDict().items()})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def told(self) -> dict[str, int]:
        t = self.totals
        return {"invalid_records": t["invalid"], "duplicate_records": t["readings"] - t["first"], "missing_metadata_records": t["missing"], "too_late_records": t["late"]}


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


# Ingest --------------------------------------------------------------------------------------------------------


def classified(raw: DataFrame, codec: str) -> DataFrame:
    return validate.validate(decode.decode(raw.withColumn("arrival", F.unix_millis("ingested_at")), CODECS[codec]()))


def ingest_batch(lake: Lake, feed: Feed) -> Callable[[DataFrame, int], None]:
    """What is done with a batch of classified records."""

    def write(batch: DataFrame, number: int) -> None:
        mark = ("ingest", number)
        seen = batch.persist()
        try:
            lake["bronze.raw_events"].append(rows.bronze(seen), mark)
            good = seen.where(F.col("error_code").isNull() & (F.col("source_topic") == METADATA))
            lake["silver.device_metadata_history"].upsert(rows.metadata_history(dedup.last_version(good)), mark=mark)
            bad = rejects.invalid(seen)
            lake["silver.rejected_events"].append(rows.rejected(bad), mark)
            feed("dlq-ingest", rejects.feed(bad, rejects.INVALID), number)
        finally:
            seen.unpersist()

    return write


def ingest(raw: DataFrame, lake: Lake, feed: Feed, checkpoint: str, codec: str = "avro") -> StreamingQuery:
    lake.create()
    seen = classified(raw, codec).observe("ingest", _count(F.col("error_code").isNotNull(), "invalid"))
    return seen.writeStream.queryName("ingest").foreachBatch(ingest_batch(lake, feed)).option("checkpointLocation", checkpoint).start()


# Refine --------------------------------------------------------------------------------------------------------


def bronze_stream(spark: SparkSession, lake: Lake, files: int = 16) -> DataFrame:
    """The batches that ingest has appended to the bronze table, whole and once each; compaction's files are elsewhere."""
    folder = lake["bronze.raw_events"].tail("ingest")
    return spark.readStream.schema(TABLES["bronze.raw_events"].schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(folder)


def refined(bronze: DataFrame, codec: str = "avro") -> DataFrame:
    """First deliveries with metadata, as it came or after a wait, and the watermark of their arrival."""
    seen = classified(bronze.withWatermark("kafka_timestamp", f"{lateness.OUT_OF_ORDER_MS} milliseconds"), codec)
    valid = seen.where(F.col("error_code").isNull())
    key = F.when(F.col("source_topic") == METADATA, F.concat_ws("/", "source_topic", "source_partition", "source_offset")).otherwise(F.col("event_id"))
    shaped = valid.withColumn("watermark_ms", F.lit(None).cast("bigint")).select(key.alias("_key"), "kafka_timestamp", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT.fields])
    reading = F.col("source_topic") != METADATA
    first = first_deliveries(shaped.observe("readings", _count(reading, "readings")), F.col("_key"))
    settled = first.observe("first", _count(reading, "first")).groupBy("device_id").transformWithState(Enrich(), EVENT, "Append", "ProcessingTime")
    return settled.observe("settled", _count(lateness.is_missing(), "missing"), _count(~lateness.is_missing() & lateness.is_late(), "late"))


def _hours(silver: LakeTable, events: DataFrame) -> DataFrame:
    """Hourly metrics, anew from silver, of the shipment hours that events touch."""
    days = [r.d for r in events.select(F.to_date(F.timestamp_millis("event_time")).cast("string").alias("d")).distinct().collect()]  # days of one batch
    parts = [silver.read(where={"event_day": d}) for d in days]
    if not parts:
        return hourly.hourly_metrics(events)
    all_rows = rejects.union(*parts).withColumns({"event_time": F.unix_millis("event_time"), "arrival": F.unix_millis("ingested_at")})
    touched = events.select("shipment_id", F.expr("event_time div 3600000").alias("_h")).distinct()
    return hourly.hourly_metrics(all_rows.withColumn("_h", F.expr("event_time div 3600000")).join(touched, ["shipment_id", "_h"], "left_semi"))


def refine_batch(lake: Lake, feed: Feed) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        mark = ("refine", number)
        joined = batch.withColumn("breach", enrich.breach()).persist()
        try:
            on_time, gone = lateness.on_time(joined), rejects.set_aside(joined)
            silver = lake["silver.enriched_events"]
            silver.upsert(rows.enriched(on_time), ["processed_at"], mark)
            lake["silver.rejected_events"].append(rows.rejected(gone), mark)
            lake["gold.shipment_hourly_metrics"].upsert(rows.hourly(_hours(silver, on_time)), mark=mark)
            feed("dlq-refine", rejects.feed(gone, rejects.INVALID), number)
            feed("late", rejects.feed(gone, rejects.TOO_LATE), number)
            feed("breaches", hourly.alert_feed(on_time), number)
        finally:
            joined.unpersist()

    return write


def refine(bronze: DataFrame, lake: Lake, feed: Feed, checkpoint: str, codec: str = "avro") -> StreamingQuery:
    lake.create()
    return refined(bronze, codec).writeStream.queryName("refine").outputMode("append").foreachBatch(refine_batch(lake, feed)).option("checkpointLocation", checkpoint).start()


def hourly_stream(events: DataFrame, delay: str = "6 minutes") -> DataFrame:
    """Hourly metrics of a stream of enriched events, with their time as the timestamp event_ts, for update mode: state
    is held for the disorder and the allowed lateness together. In append mode it gives closed windows only."""
    return hourly.hourly_metrics(events.withWatermark("event_ts", delay), time="event_ts")
