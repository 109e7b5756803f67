from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import R, at, rows
from trailmetrics import fixed_values as fixed
from trailmetrics.functions.windows import LAST_7D, LAST_30D
from trailmetrics.operators import catalog, rollup, windowed

US = timedelta(microseconds=1)


def by_catalog(facts, report_ts=R, k=10, tz="UTC"):
    return catalog.all_metrics(facts, report_ts, k, tz)


def by_rollup(facts, report_ts=R, k=10, tz="UTC"):
    return rollup.metrics_of(rollup.rollup(facts, report_ts, tz), report_ts, k, tz)


def by_shared_scan(facts, report_ts=R, k=10, tz="UTC"):
    rolled = rollup.rollup(facts, report_ts, tz, shared_scan=True)
    return rollup.metrics_of(rolled, report_ts, k, tz)


@pytest.fixture(params=[by_catalog, by_rollup, by_shared_scan])
def metrics(request):
    return request.param


def bounds():
    anchor = at(R)
    edges = [anchor - d for d in (timedelta(0), timedelta(hours=24), timedelta(7), timedelta(30))]
    return [anchor + US, edges[0]] + [t for e in edges[1:] for t in (e, e - US)]


def test_windows_are_closed_on_both_ends(make_facts, metrics):
    facts = make_facts([("s", t, "T") for t in bounds()])
    found = metrics(facts)
    assert rows(found["failures_last_24h"]) == [(2,)]
    assert rows(found["failures_last_7d"]) == [(4,)]
    assert rows(found["top_sites_by_failures"]) == [("s", 4)]
    assert rows(found["top_sites_30d"]) == [("s", 6)]
    assert rows(found["exceptions_7d"]) == [("T", 4)]


def test_partial_first_day_counts_in_the_window_only(make_facts, metrics):
    anchor = at(R)
    found = metrics(make_facts([("s", anchor - timedelta(30) + timedelta(hours=1), "T"), ("s", anchor, "T")]))
    assert rows(found["top_sites_30d"]) == [("s", 2)]
    assert sum(n for _, n in rows(found["trend_30d"])) == 1


def test_empty_input(make_facts, metrics):
    found = metrics(make_facts([]))
    assert rows(found["failures_last_24h"]) == rows(found["failures_last_7d"]) == [(0,)]
    for name in ("top_sites_by_failures", "top_sites_30d", "exceptions_7d"):
        assert rows(found[name]) == []
    assert rows(found["trend_30d"]) == [(date(2026, 2, 6) + timedelta(i), 0) for i in range(30)]


def test_ties_at_the_last_rank_go_by_name(make_facts, metrics):
    sites = [f"site_{c}" for c in "lkjihgfedcba"]
    found = metrics(make_facts([(s, at(R), "T") for s in sites for _ in range(3)]))
    expected = [(s, 3) for s in sorted(sites)[:10]]
    assert rows(found["top_sites_by_failures"]) == rows(found["top_sites_30d"]) == expected


def test_k_is_a_parameter(make_facts, metrics):
    found = metrics(make_facts([(f"s{i}", at(R), "T") for i in range(5)]), k=2)
    assert rows(found["top_sites_30d"]) == [("s0", 1), ("s1", 1)]


def test_null_keys_form_groups_and_null_times_never_count(make_facts, metrics):
    anchor = at(R)
    found = metrics(make_facts([(None, anchor, "T"), ("s", anchor, None), ("s2", None, "T2")]))
    assert rows(found["failures_last_24h"]) == [(2,)]
    assert rows(found["top_sites_by_failures"]) == [("s", 1), (None, 1)]
    assert rows(found["exceptions_7d"]) == [("T", 1), (None, 1)]


def test_older_rows_leave_no_zero_groups(make_facts, metrics):
    old = at(R) - timedelta(20)
    found = metrics(make_facts([("old", old, "OLD"), ("new", at(R), "NEW")]))
    assert rows(found["top_sites_by_failures"]) == [("new", 1)]
    assert rows(found["exceptions_7d"]) == [("NEW", 1)]
    assert rows(found["top_sites_30d"]) == [("new", 1), ("old", 1)]


@pytest.mark.parametrize("tz, first", [("UTC", date(2026, 2, 7)), ("America/New_York", date(2026, 2, 6))])
def test_days_belong_to_the_zone_of_the_report(make_facts, metrics, tz, first):
    report_ts = "2026-03-08T00:03:02Z"
    found = rows(metrics(make_facts([("s", at(report_ts), "T")]), report_ts, tz=tz)["trend_30d"])
    assert [d for d, _ in found] == [first + timedelta(i) for i in range(30)]
    assert [n for _, n in found] == [0] * 29 + [1]


def test_windows_across_a_clock_change(make_facts, metrics):
    report_ts, tz = "2026-03-08T12:00:00Z", "America/New_York"
    anchor = at(report_ts)
    edges = [anchor - timedelta(hours=24), anchor - timedelta(hours=24) - US,
             anchor - timedelta(seconds=601_200), anchor - timedelta(seconds=601_200) - US]
    found = metrics(make_facts([("s", t, "T") for t in edges]), report_ts, tz=tz)
    assert rows(found["failures_last_24h"]) == [(1,)]
    assert rows(found["failures_last_7d"]) == [(3,)]


def test_rollup_tells_totals_from_null_keys(make_facts):
    rolled = rollup.rollup(make_facts([(None, at(R), None)]), R)
    found = {r.grain: (r.site, r.failure_type, r.date, r.n_30d) for r in rolled.collect()}
    day = date(2026, 3, 7)
    assert found == {rollup.BY_SITE: (None, None, None, 1), rollup.BY_TYPE_AND_DATE: (None, None, day, 1)}
    found = {r.grain: (r.site, r.failure_type, r.date, r.n_30d) for r in rollup.by_each_key(rolled).collect()}
    assert found == {
        rollup.BY_SITE: (None, None, None, 1), rollup.BY_TYPE: (None, None, None, 1),
        rollup.BY_DATE: (None, None, day, 1), rollup.TOTAL: (None, None, None, 1),
    }


def test_catalog_names_what_is_missing(tmp_path):
    for name in fixed.REQUIRED_METRICS[2:]:
        (tmp_path / f"{name}.sql").write_text("SELECT 1")
    with pytest.raises(catalog.MissingMetric, match="failures_last_24h, failures_last_7d"):
        catalog.load_catalog(tmp_path)


def test_report_ts_is_a_parameter_not_text(make_facts):
    with pytest.raises(ValueError):
        catalog.metric("failures_last_7d", make_facts([]), "2026-03-07T12:00:00Z' OR '1'='1")


def test_building_blocks_take_any_key_window_and_day_count(spark, make_facts):
    anchor = at(R)
    facts = make_facts([("a", anchor, "T"), ("b", anchor - timedelta(3), "T"), ("b", anchor - timedelta(9), "U")])
    per_type = windowed.counts_by(facts, "failure_type", R, LAST_30D, "n")
    assert rows(windowed.top_k(per_type, "failure_type", "n", k=1)) == [("T", 2)]
    spine = windowed.date_spine(spark.range(1), F.lit(R).cast("timestamp"), days=4).select("date")
    series = windowed.zero_filled(spine, windowed.daily_counts(facts, R, LAST_7D))
    assert sorted(rows(series)) == [(date(2026, 3, 4), 1), (date(2026, 3, 5), 0), (date(2026, 3, 6), 0), (date(2026, 3, 7), 1)]
