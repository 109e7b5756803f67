"""The physical plans the engine counts on at scale."""

from __future__ import annotations

import pytest

from checks.bindings import EVENTS
from tests.conftest import SMALL
from trailmetrics.functions.windows import LAST_24H
from trailmetrics.operators import catalog, rollup, windowed
from trailmetrics.plans import history, publish
from trailmetrics.sources import facts as source

REPORT_TS = EVENTS.report_ts


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def facts(spark):
    return EVENTS.facts(spark, SMALL)


@pytest.fixture(scope="module")
def stored(spark, facts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("facts") / "facts")
    source.write_facts(facts, path)
    return source.read_facts(spark, path)


def test_bounds_and_columns_reach_the_scan(facts):
    text = plan(catalog.metric("top_sites_by_failures", facts, REPORT_TS))
    assert "GreaterThanOrEqual(ts,2024-01-23T12:00), LessThanOrEqual(ts,2024-01-30T12:00)" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text
    assert "TakeOrderedAndProject" in text


def test_counts_read_the_time_column_only(facts):
    for name in ("failures_last_24h", "failures_last_7d", "trend_30d"):
        assert "ReadSchema: struct<ts:timestamp_ntz>" in plan(catalog.metric(name, facts, REPORT_TS))


def test_no_metric_reads_document_ids(stored):
    for df in (*catalog.all_metrics(stored, REPORT_TS).values(), rollup.rollup(stored, REPORT_TS)):
        assert "document_id" not in plan(df)


def test_stored_facts_are_pruned_by_day(stored):
    for df in (
        *catalog.all_metrics(stored, REPORT_TS).values(),
        rollup.rollup(stored, REPORT_TS),
        windowed.counts_by(stored, "site", REPORT_TS, LAST_24H),
    ):
        partition_filters = [line for line in plan(df).splitlines() if "PartitionFilters" in line]
        assert partition_filters and all("event_date" in line for line in partition_filters)


def test_each_metric_opens_no_more_days_than_its_window_needs(stored):
    first_day = {"failures_last_24h": "2024-01-28", "failures_last_7d": "2024-01-22",
                 "top_sites_by_failures": "2024-01-22", "exceptions_7d": "2024-01-22",
                 "trend_30d": "2023-12-30", "top_sites_30d": "2023-12-30"}
    for name, day in first_day.items():
        assert "(event_date#" in (text := plan(catalog.metric(name, stored, REPORT_TS)))
        assert f">= {day})" in text and "<= 2024-01-31)" in text, name


def test_rollup_reads_two_columns_per_branch_and_shuffles_counts_only(facts):
    text = plan(rollup.rollup(facts, REPORT_TS))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in text
    assert text.split("\n\n")[0].count("Exchange") == 2 and "Expand" not in text


def test_rollup_over_a_shared_scan_is_one_scan_and_one_shuffle(facts):
    tree = plan(rollup.rollup(facts, REPORT_TS, shared_scan=True)).split("\n\n")[0]
    assert tree.count("Scan parquet") == 1
    assert tree.count("Exchange") == 1


def test_daily_series_is_joined_without_a_shuffle_of_its_own(facts):
    tree = plan(catalog.metric("trend_30d", facts, REPORT_TS)).split("\n\n")[0]
    assert "BroadcastHashJoin LeftOuter" in tree
    assert "SortMergeJoin" not in tree


def test_no_cross_join_anywhere(facts):
    from checks.queries import _event_documents

    metrics = rollup.metrics_of(rollup.rollup(facts, REPORT_TS), REPORT_TS)
    for df in (*metrics.values(), *_event_documents(facts.sparkSession, SMALL).values()):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_current_view_reads_only_the_folders_of_its_run(spark, facts, root):
    publish.publish_run(spark, facts, root, REPORT_TS)
    runs = history.committed_runs(spark, root)
    text = plan(history.current_documents(runs, history.stored_documents(spark, root)))
    assert "dynamicpruning" in text
