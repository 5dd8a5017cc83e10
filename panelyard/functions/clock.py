"""Time-zone free handling of instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400


def utc_instant(wall_clock: Column) -> Column:
    """The instant of a zone-less timestamp read as UTC, whatever the session time zone."""
    seconds = F.unix_date(F.to_date(wall_clock)) * DAY_SECONDS + F.hour(wall_clock) * 3600 + F.minute(wall_clock) * 60
    micros = F.extract(F.lit("SECOND"), wall_clock) * 1_000_000
    return F.timestamp_micros(seconds.cast("bigint") * 1_000_000 + micros.cast("bigint"))


def utc_date(instant: Column) -> Column:
    """The UTC day of an instant, whatever the session time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / DAY_SECONDS).cast("int"))


def local_midnight(date: Column, offset_hours: int) -> Column:
    """The instant a day starts at a fixed UTC offset."""
    return F.timestamp_seconds(F.unix_date(date).cast("bigint") * DAY_SECONDS - offset_hours * 3600)
