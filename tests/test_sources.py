from __future__ import annotations

from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from checks.bindings import EVENTS
from tests.conftest import R, SMALL, at, rows
from trailmetrics import fixed_values as fixed
from trailmetrics.functions.windows import LAST_24H
from trailmetrics.operators import catalog
from trailmetrics.session import materialise, shared_folder
from trailmetrics.sources import facts as source
from trailmetrics.sources.synthetic import synthetic_failures


def test_a_missing_table_fails_before_any_job(spark):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        source.read_facts(spark, "/tmp/no-such-table")


def test_zone_less_times_must_be_bound_first(spark):
    table = spark.read.parquet(f"{SMALL}/events.parquet").withColumnRenamed("ts", "timestamp")
    with pytest.raises(source.FactSchemaError, match="timestamp: expected timestamp, found timestamp_ntz"):
        source.check_fact_schema(table)


def test_facts_are_stored_by_utc_day_and_read_back_whole(spark, root):
    facts = EVENTS.facts(spark, SMALL)
    path = f"{root}/facts"
    source.write_facts(facts, path)
    back = source.read_facts(spark, path)
    assert sorted(rows(back.select(*facts.columns))) == sorted(rows(facts))
    assert back.where(F.col("event_date") != F.to_date("timestamp")).isEmpty()
    assert len(list(Path(path).glob("event_date=*"))) == 30


def test_day_pruning_changes_no_result(spark, make_facts, root):
    anchor = at(R)
    times = [anchor - timedelta(hours=h) for h in range(-60, 40 * 24, 5)]
    facts = make_facts([(f"s{i % 7}", t, f"T{i % 3}") for i, t in enumerate(times)])
    path = f"{root}/facts"
    source.write_facts(facts, path)
    stored = source.read_facts(spark, path)
    for tz in ("UTC", "Pacific/Kiritimati", "Pacific/Pago_Pago"):
        want, found = catalog.all_metrics(facts, R, tz=tz), catalog.all_metrics(stored, R, tz=tz)
        assert {n: rows(d) for n, d in found.items()} == {n: rows(d) for n, d in want.items()}


def test_only_the_days_of_the_window_are_listed(spark, make_facts, root):
    facts = make_facts([("s", at(R) - timedelta(i), "T") for i in range(40)])
    path = f"{root}/facts"
    source.write_facts(facts, path)
    pruned = source.prune_days(source.read_facts(spark, path), R, LAST_24H)
    days = sorted(r[0] for r in pruned.select("event_date").distinct().collect())
    assert days == [date(2026, 3, d) for d in (5, 6, 7)]


def test_synthetic_failures_do_not_depend_on_partitions(spark):
    ids = spark.range(1_000)
    one, many = (synthetic_failures(ids.repartition(n)) for n in (1, 7))
    assert sorted(rows(one)) == sorted(rows(many))
    assert one.schema.simpleString() == source.FACT_SCHEMA.simpleString()


def test_synthetic_failures_are_uniform_over_keys_and_time(spark):
    facts = synthetic_failures(spark.range(50_000)).persist()
    for key, values in (("site", fixed.SYNTHETIC_SITES), ("failure_type", fixed.SYNTHETIC_FAILURE_TYPES)):
        counts = dict(rows(facts.groupBy(key).count()))
        assert set(counts) == set(values)
        assert all(abs(n - 10_000) < 500 for n in counts.values())
    anchor = at(R)
    low, high, mean = facts.agg(
        F.min("timestamp"), F.max("timestamp"), F.avg(F.unix_seconds("timestamp"))
    ).first()
    assert anchor.timestamp() - 864_000 <= low.timestamp() <= high.timestamp() <= anchor.timestamp()
    assert abs(mean - (anchor.timestamp() - 432_000)) < 5_000
    assert facts.where(~F.col("document_id").rlike(r"^doc_\d{6}_[1-9]\d{3}$")).isEmpty()
    assert facts.select("document_id").distinct().count() == 50_000


def test_seeds_differ(spark):
    one, two = (synthetic_failures(spark.range(50), seed=s) for s in (1, 2))
    assert sorted(rows(one)) != sorted(rows(two))


def test_materialised_tables_go_to_the_shared_folder(spark):
    table = materialise(spark.range(3), "test")
    assert table.inputFiles()[0].removeprefix("file:").removeprefix("//").startswith(
        shared_folder(spark).removeprefix("file:").rstrip("/")
    )
    assert sorted(rows(table)) == [(0,), (1,), (2,)]
