"""Dates, time parts and cyclic encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(start: Column, end: Column) -> Column:
    """Whole days of 24 hours from start to end, towards zero."""
    return F.timestamp_diff("DAY", start, end)


def hour_part(start: Column, end: Column) -> Column:
    """The hours of end - start that don't make a day, 0 to 23."""
    return (F.timestamp_diff("HOUR", start, end) % 24).cast("long")


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def parsed(text: Column, *formats: str) -> Column:
    """The first format that fits, then a plain cast, else null."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats), text.try_cast("timestamp"))


#: The formats of times with an offset and with the name of a zone.
ZONED = ("yyyy-MM-dd HH:mm:ss Z", "yyyy-MM-dd HH:mm:ss VV")


def zoned(text: Column) -> Column:
    """A time with an offset such as -0400 or a zone such as UTC, else what a plain cast gives, else null."""
    return parsed(text, *ZONED)
