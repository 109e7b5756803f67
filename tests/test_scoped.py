from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import R, at, rows
from tests.test_metrics import US, bounds
from tests.test_plans import plan
from trailmetrics import fixed_values as fixed
from trailmetrics.functions.windows import instant
from trailmetrics.operators import documents, rollup, scoped
from trailmetrics.plans import backfill, history, publish
from trailmetrics.sources.facts import read_facts, write_facts


@pytest.fixture(scope="module")
def client_facts(make_facts):
    anchor = at(R)
    facts = make_facts([
        (f"site_{i % 15}", anchor - timedelta(hours=5 * i), f"TYPE_{i % 4}") for i in range(200)
    ] + [(None, anchor, None)])
    return facts.withColumn("client", F.when(F.col("site") < "site_2", "acme").otherwise("zen")).persist()


def test_metrics_per_client_equal_those_of_its_facts_alone(spark, client_facts):
    clients = spark.createDataFrame([("acme",), ("zen",), ("quiet",)], "client string")
    rolled = rollup.rollup(client_facts, R, scope=["client"]).persist()
    found = scoped.metrics_by(rolled, ["client"], clients, instant(R))
    for client in ("acme", "zen", "quiet"):
        alone = rollup.metrics_of(rollup.rollup(client_facts.where(F.col("client") == client), R), R)
        for name in fixed.REQUIRED_METRICS:
            want = alone[name]
            mine = found[name].where(F.col("client") == client).drop("client", "position")
            assert sorted(rows(mine.select(*want.columns)), key=repr) == sorted(rows(want), key=repr), (client, name)


def test_positions_follow_count_and_name(client_facts):
    rolled = rollup.rollup(client_facts, R, scope=["client"])
    found = scoped.metrics_by(rolled, ["client"], client_facts.select("client").distinct(), instant(R), k=3)
    for client in ("acme", "zen"):
        ranked = rows(found["top_sites_30d"].where(F.col("client") == client).orderBy("position"))
        assert [r[1] for r in ranked] == [1, 2, 3]
        assert ranked == sorted(ranked, key=lambda r: (-r[3], r[2] is None, r[2]))


def test_ranking_limits_each_task_before_the_shuffle(client_facts):
    rolled = rollup.rollup(client_facts, R, scope=["client"])
    found = scoped.metrics_by(rolled, ["client"], client_facts.select("client").distinct(), instant(R))
    assert "WindowGroupLimit" in plan(found["top_sites_30d"])


ANCHORS = ["2026-03-07T12:00:00Z", "2026-03-06T12:00:00Z", "2026-03-06T13:30:00Z", "2026-02-20T12:00:00Z",
           "2026-01-01T00:00:00Z", "2026-03-08T12:00:00Z"]


@pytest.fixture(scope="module")
def edge_facts(make_facts):
    anchor = at(R)
    steps = [t + timedelta(d) for t in bounds() for d in (-1, 0, 1)]
    spread = [anchor - timedelta(hours=7 * i) for i in range(-20, 150)]
    return make_facts([(f"s{i % 5}" if i % 9 else None, t, f"T{i % 3}") for i, t in enumerate(steps + spread)] + [("s", None, "T")]).persist()


@pytest.mark.parametrize("tz", ["UTC", "America/New_York"])
def test_backfill_equals_one_rollup_per_report(edge_facts, tz):
    found = backfill.backfill_rollup(edge_facts, ANCHORS, tz).persist()
    columns = ["site", "failure_type", "date", "grain", "n_24h", "n_7d", "n_30d"]
    for ts in ANCHORS:
        want = rows(rollup.rollup(edge_facts, ts, tz).select(*columns))
        mine = rows(found.where(F.col("report_ts") == ts).select(*columns))
        assert sorted(mine, key=repr) == sorted(want, key=repr), ts


def test_backfill_counts_window_edges_once_on_each_side(make_facts):
    later = at(R) + timedelta(7)
    facts = make_facts([("s", t, "T") for t in (at(R) - US, at(R), at(R) + US)])
    found = backfill.backfill_rollup(facts, [R, later.strftime("%Y-%m-%dT%H:%M:%SZ")])
    n_7d = {r.report_ts: r.n_7d for r in found.where(F.col("grain") == rollup.BY_SITE).collect()}
    assert n_7d == {R: 2, "2026-03-14T12:00:00Z": 2}


def test_backfill_of_facts_on_and_beside_the_edges(make_facts):
    anchor = at("2026-03-07T12:00:00Z")
    offsets = [0, 1, -1, 3_600_000_000, -86_400_000_000, -86_400_000_001, -7 * 86_400_000_000, -30 * 86_400_000_000 - 1]
    facts = make_facts([("s", anchor + timedelta(microseconds=n), "T") for n in offsets])
    stamps = ["2026-03-07T12:00:00Z", "2026-03-07T12:00:01Z", "2026-03-06T12:00:00Z"]
    rolled = backfill.backfill_rollup(facts, stamps)
    for stamp in stamps:
        want = rollup.rollup(facts, stamp)
        found = rolled.where(F.col("report_ts") == stamp).select(*want.columns)
        assert sorted(rows(found), key=repr) == sorted(rows(want), key=repr)


def test_backfill_reads_only_the_days_its_windows_touch(spark, edge_facts, root):
    write_facts(edge_facts.where("timestamp IS NOT NULL"), f"{root}/facts")
    stored = read_facts(spark, f"{root}/facts")
    rolled = backfill.backfill_rollup(stored, ["2026-02-10T12:00:00Z"])
    text = plan(rolled)
    assert "PartitionFilters: [isnotnull(event_date" in text and "CartesianProduct" not in text and "NestedLoop" not in text
    want = rollup.rollup(edge_facts, "2026-02-10T12:00:00Z")
    assert sorted(rows(rolled.select(*want.columns)), key=repr) == sorted(rows(want), key=repr)


def test_backfilled_runs_equal_published_ones_and_a_backfill_goes_on(spark, edge_facts, root):
    facts = edge_facts.where("site IS NOT NULL")
    stamps = [ANCHORS[1], ANCHORS[0], ANCHORS[4]]
    publish.publish_run(spark, facts, f"{root}/one", stamps[0], "g")
    publish.publish_run(spark, facts, f"{root}/one", stamps[1], "g")
    publish.publish_run(spark, facts, f"{root}/one", stamps[2], "g")
    publish.publish_run(spark, facts, f"{root}/many", stamps[0], "g")
    added = backfill.backfill_runs(spark, facts, f"{root}/many", [*stamps, stamps[0]], "g")
    assert [run.report_ts for run in added] == sorted(stamps[1:])
    assert backfill.backfill_runs(spark, facts, f"{root}/many", stamps, "g") == []
    one, many = (
        sorted(
            rows(
                history.documents_of_runs(spark, r, history.committed_runs(spark, r)).select("run_id", "artifact", "value")
            )
        )
        for r in (f"{root}/one", f"{root}/many")
    )
    assert one == many and len(one) == 15
    current = history.open_current(spark, f"{root}/many")
    assert {r.run_id for r in current.collect()} == {"20260307T120000Z"}
    assert documents.from_json(current, fixed.TREND_30D).count() == 1
