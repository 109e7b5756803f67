"""Calendar days of a zone that is a value like any other, so that one job can hold many zones.

Nothing here depends on the time zone of the session. Hours are elapsed time in every zone and need none of this.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmetrics.functions.windows import utc_day

_DAY_MICROS = 86_400_000_000


def day_in(event_time: Column, zone: Column) -> Column:
    """The calendar day of an instant in a zone."""
    return utc_day(F.from_utc_timestamp(event_time, zone))


def day_start(day: Column, zone: Column) -> Column:
    """The first instant of a calendar day in a zone."""
    midnight = F.timestamp_micros(F.unix_date(day).cast("bigint") * _DAY_MICROS)
    return F.to_utc_timestamp(midnight, zone)


def days_before(anchor: Column, days: int, zone: Column) -> Column:
    """The instant with the same time on the clock ``days`` calendar days before.

    Of a time that the clock shows twice, the one with the anchor's own offset if that is one of them, else the first; a time that it skips is
    as much later as was skipped.
    """
    clock = F.unix_micros(F.from_utc_timestamp(anchor, zone)) - days * _DAY_MICROS
    same_offset = F.timestamp_micros(F.unix_micros(anchor) - days * _DAY_MICROS)
    shown = F.timestamp_micros(clock)
    return F.when(F.from_utc_timestamp(same_offset, zone) == shown, same_offset).otherwise(F.to_utc_timestamp(shown, zone))
