"""Wire framing of payloads: a zero byte, a big-endian schema id of four bytes, the body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = 5


def _column(payload: str | Column) -> Column:
    return F.col(payload) if isinstance(payload, str) else payload


def schema_id(payload: str | Column) -> Column:
    """The schema id as a signed 32-bit number; null without payload, below five bytes or without the zero byte."""
    p = _column(payload)
    number = F.conv(F.hex(F.substring(p, 2, 4)), 16, 10).cast("bigint")
    signed = F.when(number >= 1 << 31, number - (1 << 32)).otherwise(number).cast("int")
    return F.when((F.octet_length(p) >= HEADER) & (F.substring(p, 1, 1) == F.unhex(F.lit("00"))), signed)


def body(payload: str | Column) -> Column:
    """What follows the header."""
    p = _column(payload)
    return F.substring(p, F.lit(HEADER + 1), F.octet_length(p))


def frame(schema: str | Column, content: Column) -> Column:
    """content, a string, behind the header for a schema id."""
    return F.concat(F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(_column(schema).cast("bigint")), 8, "0")), F.encode(content, "UTF-8"))
