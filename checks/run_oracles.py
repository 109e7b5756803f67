"""DuckDB SQL for the queries on histories of many runs."""

from __future__ import annotations

from checks import oracles as o
from checks.bindings import CLIENT_ORDERS_SQL, EVENTS, ORDERS
from checks.run_queries import DAILY, LARGE_K, MANY, TYPES_A_PAGE
from trailmetrics import fixed_values as fixed


def _runs(instants: tuple[str, ...]) -> str:
    values = ", ".join(f"('{ts}', '{o.run_id_of(ts)}', {o.instant_of(ts)})" for ts in instants)
    return f"(VALUES {values}) r(report_ts, run_id, anchor)"


def _counts(instants: tuple[str, ...], window: str, keys: str) -> str:
    """``run_id, <keys>, failures`` of every run; a run without failures has no row."""
    key = f", {keys}" if keys else ""
    return f"SELECT run_id{key}, count(*) AS failures FROM facts JOIN {_runs(instants)} ON {o.in_run(window)} GROUP BY ALL"


def _total(instants: tuple[str, ...], window: str) -> str:
    counts = _counts(instants, window, "")
    return f"SELECT run_id, coalesce(c.failures, 0) AS n FROM {_runs(instants)} LEFT JOIN ({counts}) c USING (run_id)"


def _items(scope: str, spine: str, counts) -> str:
    """Every item of all documents, for each ``scope``; ``counts(window, keys)`` counts by scope and keys."""

    def ranked(artifact: str, window: str, key: str, limit: str) -> str:
        return (
            f"SELECT {scope}, '{artifact}' AS artifact, row_number() OVER (PARTITION BY {scope}"
            f" ORDER BY failures DESC, {key} ASC NULLS LAST) AS position, {key} AS item, failures AS n"
            f" FROM ({counts(window, key)}) {limit}"
        )

    top = f"QUALIFY position <= {fixed.TOP_K}"
    days = counts("30d", 'CAST("timestamp" AS DATE) AS date')
    same = f"d.{scope} IS NOT DISTINCT FROM s.{scope} AND d.date = s.date"
    trend = (
        f"SELECT s.{scope}, '{fixed.TREND_30D}' AS artifact, row_number() OVER (PARTITION BY s.{scope} ORDER BY s.date) AS position,"
        f" CAST(s.date AS VARCHAR) AS item, coalesce(d.failures, 0) AS n FROM ({spine}) s LEFT JOIN ({days}) d ON {same}"
    )
    parts = [
        ranked(fixed.SUMMARY, "7d", "site", top), trend, ranked(fixed.TOP_SITES, "30d", "site", top),
        ranked(fixed.EXCEPTIONS, "7d", "failure_type", ""),
    ]
    return " UNION ALL ".join(f"({part})" for part in parts)


def _run_items(instants: tuple[str, ...]) -> str:
    spine = (
        "SELECT run_id, CAST(unnest(generate_series(anchor - INTERVAL 29 DAY, anchor, INTERVAL 1 DAY)) AS DATE) AS date"
        f" FROM {_runs(instants)}"
    )
    return _items("run_id", spine, lambda window, keys: _counts(instants, window, keys))


def _client_items() -> str:
    ts = ORDERS.report_ts

    def counts(window: str, keys: str) -> str:
        return f"SELECT client, {keys}, count(*) AS failures FROM facts WHERE {o.between(ts, window)} GROUP BY ALL"

    spine = f"SELECT client, date FROM (SELECT DISTINCT client FROM facts) CROSS JOIN ({o.spine(ts)})"
    return _items("client", spine, counts)


_CHOSEN = f"({_total(DAILY, '24h')})"
_TYPES = f"(SELECT run_id, count(*) AS types FROM ({_counts(DAILY, '7d', 'failure_type')}) GROUP BY run_id)"
_ARTIFACTS = "(VALUES {}) a(i, artifact)".format(", ".join(f"({i}, '{name}')" for i, name in enumerate(fixed.PAYLOAD_ARTIFACTS)))

_MISSING = f"""
    SELECT run_id, artifact, CASE WHEN n % 7 = i THEN 'not listed' WHEN n % 5 = i THEN 'not stored' ELSE 'stored in part' END AS reason
    FROM {_CHOSEN} CROSS JOIN {_ARTIFACTS} LEFT JOIN {_TYPES} t USING (run_id)
    WHERE n % 7 = i OR n % 5 = i
       OR (artifact = '{fixed.EXCEPTIONS}' AND n % 3 = 0 AND coalesce(types, 0) > {TYPES_A_PAGE})"""

_DIGESTS = f"""
    SELECT run_id, '{fixed.TREND_30D}#0' AS page, 'altered' AS reason FROM {_CHOSEN} WHERE n % 4 = 0
    UNION ALL SELECT run_id, '{fixed.EXCEPTIONS}#0', 'missing' FROM {_CHOSEN} WHERE n % 5 = 0
    UNION ALL SELECT run_id, '{fixed.MANIFEST}#0', 'not noted' FROM {_CHOSEN} WHERE n % 3 = 0
    UNION ALL SELECT run_id, NULL, 'digests do not add up' FROM {_CHOSEN} WHERE n % 2 = 0"""

_LATEST = f"""
    SELECT run_id, '{DAILY[-1]}' AS report_ts, '{fixed.STATUS_SUCCESS}' AS status, d.n AS failures_last_24h,
           w.n AS failures_last_7d, {len(DAILY)} AS runs
    FROM ({_total(DAILY[-1:], '24h')}) d JOIN ({_total(DAILY[-1:], '7d')}) w USING (run_id)"""

_RECOVERED = f"""
    SELECT run_id, '{fixed.STATUS_SUCCESS}' AS status, n AS failures_last_24h, false AS second, 1 AS refused
    FROM ({_total(DAILY[-7:], '24h')})"""

_LARGE_K = f"""
    SELECT client, row_number() OVER (PARTITION BY client ORDER BY failures DESC, site ASC NULLS LAST) AS position, site, failures
    FROM (SELECT client, site, count(*) AS failures FROM facts GROUP BY ALL) QUALIFY position <= {LARGE_K}"""


#: Hours between UTC and the clock of each zone, and where the window of 30 days opens.
_CLOCKS = {
    "America/New_York": ("CASE WHEN t < TIMESTAMP '1998-10-25 06:00:00' THEN -240 ELSE -300 END", "1998-10-11 11:00:00"),
    "Asia/Kolkata": ("330", "1998-10-11 12:00:00"),
    "UTC": ("0", "1998-10-11 12:00:00"),
}
_ZONED = " UNION ALL ".join(
    f"""SELECT '{zone}' AS zone, CAST(CAST(s.day AS DATE) AS VARCHAR) AS date, count(f.day) AS failures
    FROM (SELECT unnest(generate_series(DATE '1998-11-10' - INTERVAL 29 DAY, DATE '1998-11-10', INTERVAL 1 DAY)) AS day) s
    LEFT JOIN (
        SELECT CAST(t + to_minutes({minutes}) AS DATE) AS day FROM shipped
        WHERE t BETWEEN TIMESTAMP '{opened}' AND TIMESTAMP '1998-11-10 12:00:00'
    ) f ON f.day = CAST(s.day AS DATE)
    GROUP BY s.day"""
    for zone, (minutes, opened) in _CLOCKS.items()
)
_MOVED = (
    "SELECT count(*) AS failures_last_7d FROM (SELECT CASE WHEN CAST(document_id AS BIGINT) % 3 = 0"
    ' THEN "timestamp" + INTERVAL 480 HOUR ELSE "timestamp" END AS "timestamp" FROM facts)'
    f" WHERE {o.between(EVENTS.report_ts, '7d')}"
)


def run_oracles() -> dict[str, str]:
    on_events = {
        "rollup_from_partials": o.fused(EVENTS.report_ts),
        "fact_scan_indexed": f'SELECT document_id, site, "timestamp" FROM facts WHERE {o.between(EVENTS.report_ts, "7d")}',
        "metric_moved_timestamp": _MOVED,
        "backfill_prefix_sums": o.backfill_sql(MANY),
        "backfill_documents": _run_items(DAILY),
        "latest_run_compacted": _LATEST,
        "commit_recovery": _RECOVERED,
        "missing_artifacts": _MISSING,
        "stored_digests": _DIGESTS,
        "run_metrics_observed": o.run_log(EVENTS.report_ts),
    }
    by_client = {"client_documents": _client_items(), "top_sites_by_client_k5000": _LARGE_K}
    shipped = "SELECT CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_orderkey % 24 AS BIGINT)) AS t FROM lineitem"
    return {"trend_by_zone": f"WITH shipped AS ({shipped}) {_ZONED}"} | {name: f"WITH facts AS ({EVENTS.facts_sql}) {sql}" for name, sql in on_events.items()} | {
        name: f"WITH facts AS ({CLIENT_ORDERS_SQL}) {sql}" for name, sql in by_client.items()
    }
