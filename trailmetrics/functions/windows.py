"""Trailing windows, report instants and day buckets as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO_INSTANT = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})")
_PUNCTUATION = "[^a-zA-Z0-9]"


@dataclass(frozen=True)
class Trailing:
    """Length of a window that ends at the report instant, closed on both ends.

    Days are calendar days of the session zone; hours are elapsed time. A day-time interval
    literal would turn 24 hours into one calendar day, so the two stay separate here.
    """

    days: int = 0
    hours: int = 0

    @property
    def interval(self) -> Column:
        return F.make_interval(days=F.lit(self.days), hours=F.lit(self.hours))


LAST_24H = Trailing(hours=24)
LAST_7D = Trailing(days=7)
LAST_30D = Trailing(days=30)


def normalise_report_ts(report_ts: str | datetime | None = None) -> str:
    """Report instant as ``YYYY-MM-DDTHH:MM:SSZ``; the current second when none is given.

    Only this form sorts by time once it is turned into a run id, so bare dates, zone-less
    times and fractions of a second are refused.
    """
    if report_ts is None:
        moment = datetime.now(timezone.utc).replace(microsecond=0)
    elif isinstance(report_ts, datetime):
        moment = report_ts
        if moment.tzinfo is None or moment.microsecond:
            raise ValueError(f"report_ts needs a zone and whole seconds: {report_ts!r}")
    elif _ISO_INSTANT.fullmatch(report_ts):
        moment = datetime.fromisoformat(report_ts)
    else:
        raise ValueError(f"report_ts is not an ISO-8601 instant to the second: {report_ts!r}")
    return moment.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def instant(report_ts: str) -> Column:
    return F.lit(report_ts).cast("timestamp")


def in_window(event_time: Column, anchor: Column, window: Trailing) -> Column:
    """True from ``anchor - window`` to ``anchor``, both included; NULL times never match."""
    return event_time.between(anchor - window.interval, anchor)


def day_bucket(event_time: Column) -> Column:
    return event_time.cast("date")


def utc_day(event_time: Column) -> Column:
    """UTC calendar day whatever the session zone; the partition key of stored facts."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(event_time) / 86400).cast("int"))


def trailing_days(anchor: Column, days: int) -> Column:
    """Array of the ``days`` calendar dates that end with the date of ``anchor``."""
    first = day_bucket(anchor - Trailing(days=days - 1).interval)
    return F.sequence(first, day_bucket(anchor), F.expr("INTERVAL 1 DAY"))


def run_id(report_ts: Column) -> Column:
    """Run identifier: the report instant without its punctuation."""
    return F.regexp_replace(report_ts, _PUNCTUATION, "")


def run_id_of(report_ts: str) -> str:
    return re.sub(_PUNCTUATION, "", report_ts)
