"""The binary codec: round trips, the decoder on it, and damaged bodies."""

from __future__ import annotations

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frostlake.operators import decode, validate
from frostlake.sources import avro
from tests.test_flow import BASE, raw


def framed(number: int, value: dict) -> bytes:
    return b"\0" + number.to_bytes(4, "big") + avro.write(value, avro.WRITERS[avro.REGISTRY[number]])


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(sorted(avro.REGISTRY)), st.integers(-(2**62), 2**62), st.text(max_size=20), st.floats(allow_nan=False), st.one_of(st.none(), st.integers(-100, 0)))
def test_round_trip(number, n, text, x, signal):
    topic, version = avro.REGISTRY[number]
    value = BASE[topic] | {"event_time": n, "event_id": text} | {k: x for k in ("value", "latitude", "magnitude") if k in BASE[topic]} | ({"signal_strength_dbm": signal} if version == 2 else {})
    assert avro.read(avro.write(value, avro.WRITERS[topic, version]), avro.WRITERS[topic, version]) == value


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=60))
def test_damaged_bodies_only_raise_what_is_caught(body):
    for fields in avro.WRITERS.values():
        try:
            avro.read(body, fields)
        except (ValueError, IndexError, struct.error):
            pass


def test_decoder(spark):
    good = [("telemetry", framed(1, BASE["telemetry"])), ("telemetry", framed(5, BASE["telemetry"] | {"signal_strength_dbm": -78})), ("location", framed(2, BASE["location"])), ("detection", framed(3, BASE["detection"])), ("metadata", framed(4, BASE["metadata"]))]
    bad = [("location", framed(1, BASE["telemetry"])), ("telemetry", b"\0\0\0\0\1abc"), ("telemetry", b"\0\0\0\0\x63abc"), ("telemetry", b"not-confluent-avro"), ("telemetry", None)]
    got = validate.validate(decode.decode(raw(spark, good + bad), avro.record())).orderBy("source_offset").collect()
    assert [r.error_code for r in got] == [None] * 5 + ["AVRO_DECODE_ERROR"] * 4 + ["NOT_AVRO_RECORD"]
    assert [r.signal_strength_dbm for r in got[:2]] == [None, -78] and got[0].numeric_value == pytest.approx(5.5)
