from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.conftest import R, at
from trailmetrics.functions import windows
from trailmetrics.session import session_zone


@pytest.mark.parametrize("bad", ["not-a-ts", "2026-03-07", "2026-03-07T12:00:00", "2026-03-07 12:00:00Z",
                                 "2026-03-07T12:00:00.5Z", "2026-13-07T12:00:00Z", ""])
def test_bad_anchor_is_refused(bad):
    with pytest.raises(ValueError):
        windows.normalise_report_ts(bad)


@pytest.mark.parametrize("good", [R, "2026-03-07T12:00:00+00:00", "2026-03-07T07:00:00-05:00", at(R)])
def test_anchor_is_normalised_to_utc(good):
    assert windows.normalise_report_ts(good) == R


def test_datetime_anchor_needs_zone_and_whole_seconds():
    for bad in (datetime(2026, 3, 7), datetime(2026, 3, 7, 0, 0, 0, 5, timezone.utc)):
        with pytest.raises(ValueError):
            windows.normalise_report_ts(bad)


def test_default_anchor_is_now_to_the_second():
    before = datetime.now(timezone.utc).replace(microsecond=0)
    found = at(windows.normalise_report_ts())
    assert before <= found <= datetime.now(timezone.utc)


@pytest.mark.parametrize("anchor, tz, day_7, hour_24", [
    (R, "UTC", 604_800, 86_400),
    ("2026-03-10T03:30:00Z", "America/New_York", 601_200, 86_400),
    # The clock changes within the last 24 hours: still 24 elapsed hours, yet a shorter day.
    ("2026-03-08T12:00:00Z", "America/New_York", 601_200, 86_400),
    ("2025-11-02T12:00:00Z", "America/New_York", 608_400, 86_400),
])
def test_days_follow_the_calendar_and_hours_the_clock(spark, anchor, tz, day_7, hour_24):
    with session_zone(spark, tz):
        start = windows.instant(anchor)
        lengths = spark.range(1).select(*[
            (F.unix_seconds(start) - F.unix_seconds(start - w.interval))
            for w in (windows.LAST_7D, windows.LAST_24H)
        ])
    assert tuple(lengths.first()) == (day_7, hour_24)


@pytest.mark.parametrize("anchor, tz, first, last", [
    ("2026-03-08T00:03:02Z", "UTC", date(2026, 2, 7), date(2026, 3, 8)),
    ("2026-03-08T00:03:02Z", "America/New_York", date(2026, 2, 6), date(2026, 3, 7)),
    ("2026-03-10T03:30:00Z", "America/New_York", date(2026, 2, 8), date(2026, 3, 9)),
    ("2026-03-08T00:03:02Z", "America/Los_Angeles", date(2026, 2, 6), date(2026, 3, 7)),
    ("2024-03-01T00:00:00Z", "UTC", date(2024, 2, 1), date(2024, 3, 1)),
])
def test_spine_has_30_consecutive_days(spark, anchor, tz, first, last):
    with session_zone(spark, tz):
        days = spark.range(1).select(windows.trailing_days(windows.instant(anchor), 30)).first()[0]
    assert days == [first + timedelta(i) for i in range(30)]
    assert days[-1] == last


def test_run_id_drops_punctuation_and_sorts_by_time(spark):
    stamps = ["2026-03-07T22:49:59Z", "2026-03-08T10:15:30Z"]
    df = spark.createDataFrame([(s,) for s in stamps], "ts string")
    found = [r[0] for r in df.select(windows.run_id(F.col("ts"))).collect()]
    assert found == ["20260307T224959Z", "20260308T101530Z"] == sorted(found)


@pytest.mark.parametrize("tz", ["UTC", "Asia/Tokyo", "America/Los_Angeles"])
def test_utc_day_ignores_the_session_zone(spark, tz):
    times = [at("1969-12-31T23:59:59Z"), at("1970-01-01T00:00:00Z"), at("2026-03-07T23:59:59Z"), None]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp")
    with session_zone(spark, tz):
        found = [r[0] for r in df.select(windows.utc_day(F.col("ts"))).collect()]
    assert found == [date(1969, 12, 31), date(1970, 1, 1), date(2026, 3, 7), None]


def test_session_zone_is_restored_and_fixed_at_analysis(spark):
    df = spark.createDataFrame([(at("2026-03-08T00:03:02Z"),)], "ts timestamp")
    with session_zone(spark, "America/New_York"):
        day = df.select(F.col("ts").cast("date"))
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert day.first()[0] == date(2026, 3, 7)
