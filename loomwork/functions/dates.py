"""Dates and times out of text and epochs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats tried in this order after the ISO cast; month-first before day-first.  Eight digits alone are an id, no date.
FORMATS = ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "d/M/yyyy H:mm", "d/M/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy/MM/dd")


def parse_time(text: Column) -> Column:
    """The first reading of a text as a time, or null; a bare year is no time."""
    t = F.trim(text.cast("string"))
    iso = F.when(~t.rlike(r"^[+-]?\d{1,6}$"), t.try_cast("timestamp_ntz"))
    return F.coalesce(iso, *[F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in FORMATS])


def from_epoch(value: Column) -> Column:
    """Seconds, milliseconds or microseconds since 1970 by their size."""
    v = value.cast("double")
    seconds = F.when(F.abs(v) >= 1e14, v / 1e6).when(F.abs(v) >= 1e11, v / 1e3).otherwise(v)
    return F.timestamp_micros((seconds * 1e6).cast("bigint")).cast("timestamp_ntz")


def weeks_between(start: Column, end: Column) -> Column:
    """Monday boundaries between two times."""
    return (F.datediff(F.date_trunc("week", end), F.date_trunc("week", start)) / 7).cast("int")
