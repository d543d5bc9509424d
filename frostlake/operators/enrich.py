"""As-of enrichment: the metadata version that was effective at each event's own time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CARRIED = ("metadata_version", "shipment_id", "vehicle_id", "origin", "destination", "cargo_type", "min_temperature_c", "max_temperature_c")
#: Events and versions meet inside such stretches of a device's time.
SLOT_MS = 86_400_000


def validity(metadata: DataFrame) -> DataFrame:
    """Versions as intervals [valid_from, valid_to) of a device's time; of versions effective at the same time the
    highest holds."""
    top = metadata.groupBy("device_id", "effective_from").agg(F.max_by(F.struct(*CARRIED), "metadata_version").alias("m"))
    after = F.lead("effective_from").over(Window.partitionBy("device_id").orderBy("effective_from"))
    return top.select("device_id", F.col("effective_from").alias("valid_from"), after.alias("valid_to"), "m")


def breach() -> Column:
    """A temperature outside the shipment's range; the bounds are inside, NaN bounds exclude nothing."""
    low = (F.col("numeric_value") < F.col("min_temperature_c")) & ~F.isnan("min_temperature_c")
    high = (F.col("numeric_value") > F.col("max_temperature_c")) & ~F.isnan("max_temperature_c")
    return F.coalesce((F.col("event_type") == "TELEMETRY_TEMPERATURE") & (low | high), F.lit(False))


def _slot(time: str) -> Column:
    return F.floor(F.col(time) / SLOT_MS)


def slotted(metadata: DataFrame, seen: DataFrame) -> DataFrame:
    """(device_id, slot, valid_from, valid_to, m): the versions that begin in a slot, and for each slot of seen
    (device_id, event_time) the one that holds where it begins. At most a row for each version and each slot seen."""
    spans = validity(metadata).select("device_id", _slot("valid_from").alias("slot"), F.struct("valid_from", "valid_to", "m").alias("span"))
    wanted = seen.select("device_id", _slot("event_time").alias("slot")).distinct()
    # A slot's own versions come after its beginning, also one that is effective just then.
    both = spans.select("device_id", "slot", F.col("span.valid_from").alias("at"), F.lit(1).alias("kind"), "span").unionByName(wanted.select("device_id", "slot", (F.col("slot") * SLOT_MS).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(spans.schema["span"].dataType).alias("span")))
    so_far = Window.partitionBy("device_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("span", F.last("span", ignorenulls=True).over(so_far)).where(F.col("span").isNotNull())
    return held.select("device_id", "slot", "span.valid_from", "span.valid_to", "span.m")


def as_of(events: DataFrame, metadata: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """events with the version effective at event_time and the breach flag; metadata_version is null where none was.

    Both sides meet by device and slot of time, so that an event is compared with the few versions of its slot and not
    with all of its device's: work grows with events plus versions. A slot of a busy device is a join key that
    Spark can split, and few versions are broadcast as their size allows. seen gives the events' devices and
    times, or more, where that is cheaper to read than events."""
    spans = slotted(metadata, events if seen is None else seen).withColumnsRenamed({"device_id": "_device", "slot": "_held"})
    plain = events.drop(*CARRIED, "effective_from", "status")
    held = (F.col("device_id") == F.col("_device")) & (F.col("_slot") == F.col("_held")) & (F.col("event_time") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("event_time") < F.col("valid_to")))
    joined = plain.withColumn("_slot", _slot("event_time")).join(spans, held, "left").select(*plain.columns, *[F.col(f"m.{c}").alias(c) for c in CARRIED])
    return joined.withColumn("breach", breach())
