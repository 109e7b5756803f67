"""Every registered query against its SQL in DuckDB, and the known counts of the given tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as registered
from checks import oracles, queries
from checks.bindings import EVENTS, LINEITEM, ORDERS
from checks.compare import differences, oracle
from tests.conftest import SMALL, rows
from trailmetrics.operators import rollup

BINDINGS = {b.table: b for b in (EVENTS, LINEITEM, ORDERS)}

# scale, table, 24 h, 7 d, 30 d, trend sum, days without failures
KNOWN = [
    ("0.001", "events", 39, 206, 985, 985, 0),
    ("0.001", "lineitem", 3, 24, 71, 71, 5),
    ("0.001", "orders", 0, 3, 20, 20, 17),
    ("0.01", "events", 312, 2331, 9826, 9826, 0),
    ("0.01", "lineitem", 47, 194, 729, 705, 0),
    ("0.01", "orders", 11, 44, 178, 167, 0),
    ("0.1", "events", 3320, 23328, 98310, 98310, 0),
    ("0.1", "lineitem", 474, 1931, 7396, 7154, 0),
    ("0.1", "orders", 103, 484, 1941, 1874, 0),
]


@pytest.fixture(scope="module")
def duck():
    return oracle(SMALL)


def test_every_query_has_an_oracle():
    assert queries.all_queries().keys() == oracles.all_oracles().keys()
    assert queries.all_queries().keys() <= registered.queries().keys()


@pytest.mark.parametrize("name", queries.all_queries())
def test_query_equals_its_oracle(spark, duck, name):
    result = queries.all_queries()[name](spark, SMALL)
    assert differences(result, duck, oracles.all_oracles()[name]) == []


def test_entry(spark):
    assert registered.entry(spark).count() == 30


@pytest.mark.parametrize("scale, table, n_24h, n_7d, n_30d, trend, quiet", KNOWN)
def test_known_counts(spark, scale, table, n_24h, n_7d, n_30d, trend, quiet):
    binding = BINDINGS[table]
    rolled = rollup.rollup(binding.facts(spark, f"/root/testdata/sf{scale}"), binding.report_ts).persist()
    (total,) = rollup.by_each_key(rolled).where(f"grain = {rollup.TOTAL}").collect()
    assert (total.n_24h, total.n_7d, total.n_30d) == (n_24h, n_7d, n_30d)
    series = rows(rollup.metrics_of(rolled, binding.report_ts)["trend_30d"])
    assert sum(n for _, n in series) == trend
    assert sum(n == 0 for _, n in series) == quiet
    rolled.unpersist()
