"""The first delivery of each event, in arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ARRIVAL = ("arrival", "source_topic", "source_partition", "source_offset")


def first_delivery(events: DataFrame) -> DataFrame:
    """Runs before enrichment, so a first copy that is rejected later keeps its redelivery out too."""
    order = Window.partitionBy("event_id").orderBy(*ARRIVAL)
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def last_version(metadata: DataFrame) -> DataFrame:
    """Of each device's metadata version the row that came last; metadata is not deduplicated by event."""
    order = Window.partitionBy("device_id", "metadata_version").orderBy(*[F.col(c).desc() for c in ARRIVAL])
    return metadata.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
