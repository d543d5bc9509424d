"""Column functions that several operators share, with the null, NaN and blank cases that telemetry brings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(name: str) -> Column:
    """Null, empty, or white space only (as Java counts it)."""
    return F.coalesce(F.col(name).rlike(r"\A\p{javaWhitespace}*\z"), F.lit(True))


def within(name: str, low: float, high: float) -> Column:
    """A finite number between the bounds, which are in. Null and NaN are not."""
    return F.coalesce(F.col(name).between(F.lit(float(low)), F.lit(float(high))), F.lit(False))


def one_line_base64(payload: str | Column) -> Column:
    """Base64 without the line breaks that Spark puts in."""
    return F.regexp_replace(F.base64(payload), "[\r\n]", "")


def complete_minutes(since: str, until: str) -> Column:
    """Whole minutes from one epoch millisecond to another."""
    return F.expr(f"({until} - {since}) div 60000")


def steady_mean(value: Column) -> Column:
    """An average that does not depend on the order of summation: values have a few decimals."""
    return F.round(F.sum(value.cast("decimal(28,6)")).cast("double") / F.count(value), 6)
