"""The batch flow from raw records to every table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostlake.operators import decode, dedup, enrich, hourly, lateness, rejects, validate
from frostlake.sources.schemas import METADATA
from frostlake.sources.shared import stored


@dataclass
class Flow:
    """raw: RAW records with arrival (ms), the order in which they came; a stored table, for it is read more than once.
    Records are decoded and validated once, which is stored; everything else filters that, or the one as-of join."""

    raw: DataFrame

    @cached_property
    def validated(self) -> DataFrame:
        """All records with their fields, their error if any, and the watermark. Only invalid ones keep their payload."""
        rows = validate.validate(decode.decode(lateness.with_watermark(self.raw)))
        return stored(rows.withColumn("payload", F.when(F.col("error_code").isNotNull(), F.col("payload"))))

    @cached_property
    def metadata(self) -> DataFrame:
        """The history of valid metadata, one row for each device and version."""
        return dedup.last_version(self._valid.where(F.col("source_topic") == METADATA))

    @cached_property
    def _valid(self) -> DataFrame:
        return self.validated.where(F.col("error_code").isNull())

    @cached_property
    def _readings(self) -> DataFrame:
        return self._valid.where(F.col("source_topic") != METADATA)

    @cached_property
    def sensors(self) -> DataFrame:
        """Valid sensor events, first deliveries."""
        return dedup.first_delivery(self._readings)

    @cached_property
    def joined(self) -> DataFrame:
        """Sensor events with the metadata of their time, and their watermark."""
        return enrich.as_of(self.sensors, self.metadata, self._readings)

    def store_joined(self) -> Flow:
        """For flows of which several results are wanted."""
        self.joined = stored(self.joined)
        return self

    @cached_property
    def enriched(self) -> DataFrame:
        """Events with metadata that came in time."""
        return lateness.on_time(self.joined)

    @cached_property
    def rejected(self) -> DataFrame:
        return rejects.union(rejects.invalid(self.validated), rejects.set_aside(self.joined))

    @cached_property
    def hourly(self) -> DataFrame:
        return hourly.hourly_metrics(self.enriched)

    @cached_property
    def finalized(self) -> DataFrame:
        """Hourly rows of windows that the last watermark has closed."""
        last = self.raw.agg(F.max(F.unix_millis("kafka_timestamp")).alias("t")).first().t
        return hourly.finalized(self.hourly, None if last is None else last - lateness.OUT_OF_ORDER_MS - 1)

    @cached_property
    def alerts(self) -> DataFrame:
        return hourly.alerts(self.enriched)
