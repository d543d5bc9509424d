"""Keyed state of the refining stream: first deliveries, and metadata with a short wait for it."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from frostlake.operators.enrich import CARRIED
from frostlake.sources.schemas import METADATA, _struct

DAY_MS = 24 * 3600 * 1000
WAIT_MS = 10_000
#: Keys of the state of first deliveries: events share one by their hash, for each key costs calls between Python and the state.
BUCKETS = 1 << 14

#: What travels through the stateful stages, metadata rows included.
EVENT = _struct(
    "source_topic string, source_partition int, source_offset bigint, ingested_at timestamp, arrival bigint, watermark_ms bigint, event_id string, device_id string, event_time bigint, produced_at bigint, sequence_number bigint, event_type string, numeric_value double, unit string, "
    "signal_strength_dbm int, latitude double, longitude double, speed_kph double, accuracy_m double, detection_type string, severity string, magnitude double, metadata_version int, effective_from bigint, shipment_id string, vehicle_id string, origin string, destination string, cargo_type string, min_temperature_c double, max_temperature_c double"
)
_VERSION = StructType([f for f in EVENT.fields if f.name == "effective_from" or f.name in CARRIED])


_EVENT_ROW = Row(*EVENT.names)


def _row(values: dict) -> Row:
    return _EVENT_ROW(*[values.get(n) for n in EVENT.names])


class FirstDelivery(StatefulProcessor):
    """The first row of each _key within a day of processing time; later ones don't prolong it. The watermark of
    the moment goes along as a column, for the stages behind see none. The state's keys are buckets of _key: a batch adds
    to a bucket one list (JSON) of the keys that are new, which expires by itself, so that calls grow with buckets and not with events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", _struct("keys string"), ttlDurationMs=DAY_MS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        order = lambda r: (r["arrival"], r["source_topic"], r["source_partition"], r["source_offset"])
        first: dict[str, dict] = {}
        for r in map(Row.asDict, rows):
            best = first.get(r["_key"])
            if best is None or order(r) < order(best):
                first[r["_key"]] = r
        for (keys,) in self.seen.get():
            for k in json.loads(keys):
                first.pop(k, None)
        if not first:
            return
        self.seen.appendValue((json.dumps(list(first)),))
        mark = timerValues.getCurrentWatermarkInMs() or None
        for r in first.values():
            yield _row(r | {"watermark_ms": mark})

    def close(self) -> None:
        pass


def first_deliveries(events: DataFrame, key: Column) -> DataFrame:
    """EVENT rows of a stream, the first of each key."""
    rows = events.withColumn("_key", key).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)))
    return rows.groupBy("_bucket").transformWithState(FirstDelivery(), EVENT, "Append", "ProcessingTime")


class Enrich(StatefulProcessor):
    """Each event with the best version that is known. Events without one wait for metadata, ten seconds at
    most from the device's first waiting event, and then leave without."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.versions = handle.getMapState("versions", _struct("metadata_version int"), _VERSION)
        self.waiting = handle.getListState("waiting", EVENT)

    def _best(self, known: list[dict], at: int) -> dict | None:
        fit = [v for v in known if v["effective_from"] <= at]
        return max(fit, key=lambda v: (v["effective_from"], v["metadata_version"])) if fit else None

    def _known(self) -> list[dict]:
        return [dict(zip(_VERSION.names, v, strict=True)) for _, v in self.versions.iterator()]

    def _settle(self, rows: list[dict], known: list[dict]) -> tuple[list[dict], list[dict]]:
        done, open_ = [], []
        for r in rows:
            best = self._best(known, r["event_time"])
            (done if best else open_).append(r | ({c: best[c] for c in CARRIED} if best else {}))
        return done, open_

    def _held(self) -> list[dict]:
        return [dict(zip(EVENT.names, r, strict=True)) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        events, told = [], False
        for r in rows:
            d = r.asDict()
            if d["source_topic"] == METADATA:  # before the batch's events: iteration order is not arrival order
                self.versions.updateValue((d["metadata_version"],), tuple(d[n] for n in _VERSION.names))
                told = True
            else:
                events.append(d)
        known, before = self._known(), self._held()
        done, open_ = self._settle(events, known)
        if told and before:
            more, before = self._settle(before, known)
            done += more
        if before or open_:
            self.waiting.put([tuple(r.get(n) for n in EVENT.names) for r in before + open_])
            if not list(self.handle.listTimers()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + WAIT_MS)
        else:
            self.waiting.clear()
        yield from map(_row, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        done, open_ = self._settle(self._held(), self._known())
        self.waiting.clear()
        yield from map(_row, done + open_)

    def close(self) -> None:
        pass
