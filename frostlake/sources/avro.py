"""Binary Avro bodies of the five payload schemas, for the guarded decoder: a body that does not fit gives a
struct with _corrupt, never an error."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from frostlake.sources.framing import HEADER
from frostlake.sources.schemas import DETECTION, LOCATION, METADATA, PAYLOADS, SUPERSET, TELEMETRY

#: The symbols of enumerations, in the order of their numbers.
SYMBOLS = {
    "measurement_type": ("TEMPERATURE", "HUMIDITY", "BATTERY"),
    "unit": ("CELSIUS", "PERCENT"),
    "detection_type": ("DOOR_OPEN", "DOOR_CLOSED", "SHOCK"),
    "severity": ("INFO", "WARNING", "CRITICAL"),
    "status": ("ACTIVE", "DELIVERED", "MAINTENANCE"),
}
#: Fields that may be null: a branch number comes first.
NULLABLE = frozenset(("magnitude", "signal_strength_dbm"))
#: Fields of each topic and schema version.
WRITERS = {(TELEMETRY, 1): PAYLOADS[TELEMETRY].names[:-1], (TELEMETRY, 2): PAYLOADS[TELEMETRY].names, (LOCATION, 1): PAYLOADS[LOCATION].names, (DETECTION, 1): PAYLOADS[DETECTION].names, (METADATA, 1): PAYLOADS[METADATA].names}
#: Writers by registry id.
REGISTRY = {1: (TELEMETRY, 1), 2: (LOCATION, 1), 3: (DETECTION, 1), 4: (METADATA, 1), 5: (TELEMETRY, 2)}
_KIND = {f.name: f.dataType.typeName() for f in SUPERSET.fields}
RECORD = StructType([*SUPERSET.fields, StructField("_corrupt", StringType())])


def _long(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not b & 0x80:
            return (out >> 1) ^ -(out & 1), at
        if shift > 63:
            raise ValueError("number of more than 64 bits")


def read(body: bytes, fields: list[str]) -> dict:
    """The record in body; ValueError, IndexError or struct.error if there is none."""
    out, at = {}, 0
    for name in fields:
        if name in NULLABLE:
            branch, at = _long(body, at)
            if branch not in (0, 1):
                raise ValueError(f"{name} has no branch {branch}")
            if branch == 0:
                out[name] = None
                continue
        if name in SYMBOLS:
            number, at = _long(body, at)
            if not 0 <= number < len(SYMBOLS[name]):
                raise ValueError(f"{name} has no symbol {number}")
            out[name] = SYMBOLS[name][number]
        elif _KIND[name] == "double":
            out[name] = struct.unpack_from("<d", body, at)[0]
            at += 8
        elif _KIND[name] == "string":
            n, at = _long(body, at)
            if n < 0 or at + n > len(body):
                raise ValueError(f"{name} is longer than the body")
            out[name], at = body[at : at + n].decode(), at + n
        else:
            out[name], at = _long(body, at)
    return out


def write(value: dict, fields: list[str]) -> bytes:
    """The body of a record; what read undoes."""
    out = bytearray()

    def number(n: int) -> None:
        z = (n << 1) ^ (n >> 63)
        while z & ~0x7F:
            out.append(z & 0x7F | 0x80)
            z >>= 7
        out.append(z)

    for name in fields:
        v = value.get(name)
        if name in NULLABLE:
            number(int(v is not None))
            if v is None:
                continue
        if name in SYMBOLS:
            number(SYMBOLS[name].index(v))
        elif _KIND[name] == "double":
            out.extend(struct.pack("<d", v))
        elif _KIND[name] == "string":
            raw = v.encode()
            number(len(raw))
            out.extend(raw)
        else:
            number(v)
    return bytes(out)


def record(payload: str = "payload", schema: str = "schema_id", topic: str = "source_topic") -> Column:
    """The record of a framed payload by its writer's schema, for `operators.decode.decode`. A schema of another
    topic fits no record."""

    @F.pandas_udf(RECORD)
    def decoded(payloads: pd.Series, ids: pd.Series, topics: pd.Series) -> pd.DataFrame:
        rows = []
        for p, i, t in zip(payloads, ids, topics, strict=True):
            row: dict = {}
            if p is not None and not pd.isna(i):
                try:
                    own, version = REGISTRY[int(i)]
                    if own != t:
                        raise ValueError(f"schema {int(i)} is not one of {t}")
                    row = read(bytes(p)[HEADER:], WRITERS[own, version])
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    row = {"_corrupt": str(e) or type(e).__name__}
            rows.append([row.get(n) for n in RECORD.names])
        table = pd.DataFrame(rows, columns=RECORD.names, dtype=object)
        for f in SUPERSET.fields:
            kind = f.dataType.typeName()
            if kind != "string":
                table[f.name] = table[f.name].astype({"long": "Int64", "integer": "Int32", "double": "Float64"}[kind])
        return table

    return decoded(payload, schema, topic)
