"""Random facts: both ways to compute the metrics against a plain count, and their invariants."""

from __future__ import annotations

from collections import Counter
from datetime import timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.conftest import R, at, rows
from tests.test_metrics import bounds
from trailmetrics.operators import catalog, rollup, windowed
from trailmetrics.functions.windows import LAST_7D

ANCHOR = at(R)
SITES = [f"site_{i}" for i in range(30)]
TYPES = [f"TYPE_{i}" for i in range(8)]

times = st.one_of(
    st.none(),
    st.sampled_from(bounds()),
    st.integers(-40 * 86_400 * 10**6, 40 * 86_400 * 10**6).map(lambda us: ANCHOR + timedelta(microseconds=us)),
)


@st.composite
def fact_rows(draw):
    sites = st.one_of(st.none(), st.sampled_from(SITES[: draw(st.integers(1, 30))]))
    types = st.one_of(st.none(), st.sampled_from(TYPES[: draw(st.integers(1, 8))]))
    return draw(st.lists(st.tuples(sites, times, types), max_size=300))


def ranked(counts: Counter, k: int | None = None) -> list[tuple]:
    order = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0] is None, kv[0] or ""))
    return order[:k]


def expected(facts: list[tuple]) -> dict[str, list[tuple]]:
    within = {
        name: [(s, t, f) for s, t, f in facts if t is not None and ANCHOR - length <= t <= ANCHOR]
        for name, length in (("24h", timedelta(hours=24)), ("7d", timedelta(7)), ("30d", timedelta(30)))
    }
    days = Counter(t.date() for _, t, _ in within["30d"])
    return {
        "failures_last_24h": [(len(within["24h"]),)],
        "failures_last_7d": [(len(within["7d"]),)],
        "top_sites_by_failures": ranked(Counter(s for s, _, _ in within["7d"]), 10),
        "top_sites_30d": ranked(Counter(s for s, _, _ in within["30d"]), 10),
        "exceptions_7d": ranked(Counter(f for _, _, f in within["7d"])),
        "trend_30d": [(d, days[d]) for d in (ANCHOR.date() - timedelta(29 - i) for i in range(30))],
    }


@settings(max_examples=10, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(data=fact_rows(), partitions=st.integers(1, 8))
def test_metrics_equal_a_plain_count(make_facts, data, partitions):
    facts = make_facts(data).repartition(partitions)
    want = expected(data)
    table = rollup.rollup(facts, R)
    shared = rollup.rollup(facts, R, shared_scan=True)
    assert table.columns == shared.columns
    assert sorted(rows(table), key=repr) == sorted(rows(shared), key=repr)
    rolled = rollup.metrics_of(table, R)
    for name, df in catalog.all_metrics(facts, R).items():
        found = rows(df)
        assert found == want[name], name
        assert rows(rolled[name]) == found, name

    total_24h, total_7d = want["failures_last_24h"][0][0], want["failures_last_7d"][0][0]
    sites = rows(windowed.counts_by(facts, "site", R, LAST_7D))
    total_30d = sum(r.n_30d for r in table.where(f"grain = {rollup.BY_SITE}").collect())
    assert sum(n for _, n in sites) == sum(n for _, n in want["exceptions_7d"]) == total_7d
    assert total_24h <= total_7d <= total_30d
    assert sum(n for _, n in want["trend_30d"]) <= total_30d
