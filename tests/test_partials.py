"""Rollups out of stored hourly counts, scans through the index of files, and series in many zones."""

from __future__ import annotations

from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import R, at, rows
from tests.test_plans import plan
from trailmetrics.functions import windows, zones
from trailmetrics.operators import catalog, rollup, zoned
from trailmetrics.plans import partials
from trailmetrics.session import session_zone
from trailmetrics.sources import facts as source

US = timedelta(microseconds=1)
ZONES = ["UTC", "America/New_York", "Asia/Kolkata", "Australia/Lord_Howe"]


def spread(make_facts, n=900, step=timedelta(minutes=53), end=R):
    anchor = at(end)
    made = [(f"s{i % 7}" if i % 11 else None, anchor - i * step, f"T{i % 4}" if i % 13 else None) for i in range(n)]
    made += [("edge", anchor - timedelta(days=d) + shift, "T") for d in (0, 1, 7, 30) for shift in (-US, timedelta(0), US)]
    return make_facts([*made, ("s", None, "T"), ("later", anchor + timedelta(hours=2), "T")])


def same(found, want):
    assert sorted(rows(found.select(*want.columns)), key=repr) == sorted(rows(want), key=repr)


@pytest.mark.parametrize("tz", ZONES)
@pytest.mark.parametrize("report_ts", [R, "2026-03-07T12:34:56Z", "2026-03-20T00:00:00Z"])
def test_a_rollup_from_partials_equals_one_from_the_facts(spark, make_facts, root, tz, report_ts):
    facts = spread(make_facts).persist()
    partials.write_partials(facts, root)
    same(partials.rollup_from_partials(facts, root, report_ts, tz), rollup.rollup(facts, report_ts, tz))
    facts.unpersist()


def test_only_edge_hours_are_read_from_the_facts(spark, make_facts, root):
    facts = spread(make_facts)
    source.write_facts(facts, f"{root}/facts")
    stored = source.read_facts(spark, f"{root}/facts")
    partials.write_partials(stored, f"{root}/counts")
    whole = plan(partials.rollup_from_partials(stored, f"{root}/counts", "2026-03-07T12:00:00Z"))
    assert whole.count("site, timestamp") <= 2 or "PushedFilters: [IsNotNull(timestamp)" in whole
    lost = stored.where(F.lit(False))  # without the facts, all but the edge hour of the report instant are still there
    found = partials.rollup_from_partials(lost, f"{root}/counts", "2026-03-07T12:00:00Z")
    want = rollup.rollup(stored.where(F.col("timestamp") < F.lit("2026-03-07T12:00:00Z").cast("timestamp")), "2026-03-07T12:00:00Z")
    same(found, want)


def test_late_rows_have_their_hours_and_no_others_counted_anew(spark, make_facts, root):
    anchor = at(R)
    first = make_facts([(f"s{i % 3}", anchor - timedelta(hours=i), "T") for i in range(100)])
    late = make_facts([("late", anchor - timedelta(hours=h, minutes=m), "L") for h in (5, 6, 40) for m in (1, 2)])
    both = first.unionByName(late).persist()
    partials.write_partials(first, root)
    before = {p: p.read_bytes() for p in Path(f"{root}/data").rglob("*.parquet")}
    hour = int(anchor.timestamp()) // 3600
    assert partials.refresh_partials(both, root, late) == [(hour - 41, hour - 41), (hour - 7, hour - 6)]
    assert {p: p.read_bytes() for p in before} == before
    again = spark.read.parquet(f"{root}/data").where(F.col("version").startswith("000000000002"))
    assert {r.hour for r in again.select("hour").distinct().collect()} == {hour - 41, hour - 7, hour - 6}
    same(partials.rollup_from_partials(both, root, R), rollup.rollup(both, R))
    assert partials.refresh_partials(both, root, late.where("false")) == []
    both.unpersist()


def test_commits_are_folded_and_a_version_without_a_commit_counts_nothing(spark, make_facts, root, monkeypatch):
    monkeypatch.setattr(partials, "FOLD_AFTER", 2)
    anchor = at(R)
    facts = make_facts([("s", anchor - timedelta(hours=i), "T") for i in range(9)])
    partials.write_partials(facts, root)
    for i in range(4):
        partials.refresh_partials(facts, root, facts.limit(1 + i))
    assert len([p for p in Path(f"{root}/commits").glob("*.all.json")]) >= 2
    commits, held = partials._commits(spark, root)
    assert len(commits) < 3 and sum(b - a + 1 for a, b, _ in held) == 9
    (some, *_) = Path(f"{root}/data").glob("version=*/*.parquet")
    torso = some.parent.parent / "version=000000000099-x"
    torso.mkdir()
    (torso / "part-0.parquet").write_bytes(some.read_bytes())
    same(partials.rollup_from_partials(facts, root, R), rollup.rollup(facts, R))


def test_without_facts_or_partials(spark, make_facts, root):
    none = make_facts([])
    assert partials.write_partials(none, root) is None
    assert rows(partials.rollup_from_partials(none, root, R)) == []
    facts = spread(make_facts, 50)
    same(partials.rollup_from_partials(facts, f"{root}/nothing", R), rollup.rollup(facts, R))


def test_files_outside_a_window_are_not_read(spark, make_facts, root):
    path = f"{root}/failure facts"
    source.write_facts(spread(make_facts), path)
    index = source.index_facts(spark, path)
    assert index.agg(F.sum("untimed")).first()[0] == 1
    assert source.index_facts(spark, path).count() == index.count()  # known files are not indexed twice
    first, last = windows.instant("2026-02-20T00:00:00Z"), windows.instant("2026-02-21T00:00:00Z")
    found = source.read_facts_between(spark, path, first, last)
    everything = source.read_facts(spark, path)
    assert 0 < len(found.inputFiles()) < len(everything.inputFiles()) / 4
    inside = F.col("timestamp").between(first, last)
    same(found.where(inside), everything.where(inside))
    assert found.columns == everything.columns
    assert source.read_facts_between(spark, path, windows.instant("2020-01-01T00:00:00Z"), windows.instant("2020-01-02T00:00:00Z")).count() == 0


def test_files_the_index_does_not_know_are_read(spark, make_facts, root):
    root = f"{root}/facts"
    source.write_facts(make_facts([("a", at(R), "T")]), root)
    source.index_facts(spark, root)
    source.write_facts(make_facts([("b", at(R) - timedelta(9), "T")]), root, mode="append")
    ends = windows.instant("2026-02-01T00:00:00Z"), windows.instant("2026-03-01T00:00:00Z")
    assert [r.site for r in source.read_facts_between(spark, root, *ends).collect()] == ["b"]
    source.index_facts(spark, root)
    assert [r.site for r in source.read_facts_between(spark, root, *ends).collect()] == ["b"]
    assert source.read_facts(spark, root).count() == 2  # the index is no part of the table


def test_a_changed_time_or_day_is_not_pruned_by(spark, make_facts, root):
    old, root = at(R) - timedelta(60), f"{root}/facts"
    source.write_facts(make_facts([("s", old + timedelta(hours=i), "T") for i in range(40)]), root)
    stored = source.read_facts(spark, root)
    assert source.day_column(stored) == "event_date"
    assert source.day_column(stored.where("site = 's'").select("*", F.lit(1).alias("x"))) == "event_date"
    moved = stored.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1400 HOURS"))
    redated = stored.withColumn("event_date", F.lit("2020-01-01").cast("date"))
    foreign = make_facts([("f", at(R), "T")]).withColumn("event_date", F.lit("2020-01-01").cast("date"))
    both = stored.unionByName(foreign)
    for changed in (moved, redated, both, moved.withColumnRenamed("event_date", "d"), stored.drop("event_date")):
        assert source.day_column(changed) is None
        want = rows(rollup.rollup(changed.select(*source.FACT_SCHEMA.names), R))
        assert sorted(rows(rollup.rollup(changed, R)), key=repr) == sorted(want, key=repr)
    assert catalog.metric("failures_last_7d", moved, R).first()[0] == moved.where("timestamp BETWEEN '2026-02-28 12:00:00' AND '2026-03-07 12:00:00'").count() > 0


CLOCKS = ["2026-03-08T06:30:00Z", "2026-03-08T07:30:00Z", "2026-11-01T05:30:00Z", "2026-11-01T06:30:00Z", "2026-04-07T06:30:00Z", "2026-04-04T15:15:00Z", "2026-10-03T15:45:00Z", R]


@pytest.mark.parametrize("tz", [*ZONES, "America/Sao_Paulo", "Pacific/Apia"])
def test_zone_expressions_equal_those_of_a_session_in_that_zone(spark, tz):
    stamps = spark.createDataFrame([(ts,) for ts in CLOCKS] + [("2018-11-04T03:00:00Z",), ("2011-12-31T12:00:00Z",)], "ts string")
    moment = F.col("ts").cast("timestamp")
    with session_zone(spark, tz):
        want = stamps.select(
            "ts", windows.day_bucket(moment).alias("day"),
            *[F.unix_micros(moment - windows.Trailing(days=n).interval).alias(f"d{n}") for n in (0, 1, 7, 30, 150)],
            F.unix_micros(windows.day_bucket(moment).cast("timestamp")).alias("start"),
        )
    with session_zone(spark, "Asia/Tokyo"):
        zone = F.lit(tz)
        found = stamps.select(
            "ts", zones.day_in(moment, zone).alias("day"),
            *[F.unix_micros(zones.days_before(moment, n, zone)).alias(f"d{n}") for n in (0, 1, 7, 30, 150)],
            F.unix_micros(zones.day_start(zones.day_in(moment, zone), zone)).alias("start"),
        )
    assert rows(found) == rows(want)


@pytest.mark.parametrize("report_ts", [R, "2026-11-10T06:30:00Z", "2026-03-20T23:59:59Z"])
def test_a_trend_in_many_zones_equals_one_in_each(spark, make_facts, report_ts):
    facts = spread(make_facts, step=timedelta(minutes=47), end=report_ts).persist()
    found = zoned.trend_by_zone(facts, report_ts, [*ZONES, "UTC"])
    assert "CartesianProduct" not in plan(found) and "NestedLoop" not in plan(found)
    for tz in ZONES:
        rolled = rollup.rollup(facts, report_ts, tz).persist()
        want = rollup.metrics_of(rolled, report_ts, tz=tz)["trend_30d"]
        assert rows(found.where(F.col("zone") == tz).select("date", "failures").orderBy("date")) == rows(want), tz
        rolled.unpersist()
    facts.unpersist()
