"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

from checks.bindings import CLIENT_ORDERS_SQL, EVENTS, LINEITEM, ORDERS, Binding
from checks.queries import BACKFILL, EARLIER_TS, GENERATED_AT
from trailmetrics import fixed_values as fixed

_WINDOWS = {"24h": "24 HOUR", "7d": "7 DAY", "30d": "30 DAY"}


def instant_of(report_ts: str) -> str:
    """The event columns have no zone, so neither has the literal."""
    return f"TIMESTAMP '{report_ts.removesuffix('Z').replace('T', ' ')}'"


def between(report_ts: str, window: str) -> str:
    anchor = instant_of(report_ts)
    return f'"timestamp" BETWEEN {anchor} - INTERVAL {_WINDOWS[window]} AND {anchor}'


def spine(report_ts: str) -> str:
    anchor = instant_of(report_ts)
    return (
        f"SELECT CAST(unnest(generate_series({anchor} - INTERVAL 29 DAY, {anchor}, INTERVAL 1 DAY))"
        " AS DATE) AS date"
    )


def _total(name: str, report_ts: str, window: str) -> str:
    return f"SELECT count(*) AS {name} FROM facts WHERE {between(report_ts, window)}"


def _counts(key: str, report_ts: str, window: str, count: str = "failures") -> str:
    return (
        f"SELECT {key}, count(*) AS {count} FROM facts"
        f" WHERE {between(report_ts, window)} GROUP BY {key}"
    )


def _top_sites(report_ts: str, window: str) -> str:
    return (
        f"{_counts('site', report_ts, window)}"
        f" ORDER BY failures DESC, site ASC NULLS LAST LIMIT {fixed.TOP_K}"
    )


def _daily(report_ts: str) -> str:
    return (
        'SELECT CAST("timestamp" AS DATE) AS date, count(*) AS failures FROM facts'
        f" WHERE {between(report_ts, '30d')} GROUP BY 1"
    )


def _trend(report_ts: str) -> str:
    return (
        "SELECT CAST(s.date AS VARCHAR) AS date, coalesce(d.failures, 0) AS failures"
        f" FROM ({spine(report_ts)}) s LEFT JOIN ({_daily(report_ts)}) d ON s.date = d.date"
    )


def fused(report_ts: str) -> str:
    return f"""
        SELECT site, failure_type, CAST(date AS VARCHAR) AS date,
               GROUPING(site, failure_type, date) AS grain,
               count(*) FILTER (WHERE {between(report_ts, '24h')}) AS n_24h,
               count(*) FILTER (WHERE {between(report_ts, '7d')}) AS n_7d,
               count(*) AS n_30d
        FROM (SELECT *, CAST("timestamp" AS DATE) AS date FROM facts
              WHERE {between(report_ts, '30d')})
        GROUP BY GROUPING SETS ((site), (failure_type), (date), ())"""


def _on_facts(binding: Binding) -> dict[str, str]:
    ts = binding.report_ts
    queries = {
        "fact_scan": "SELECT * FROM facts",
        "day_bucket": (
            'SELECT document_id, CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS date FROM facts'
        ),
        "daily_counts_30d": (
            f"SELECT CAST(date AS VARCHAR) AS date, failures FROM ({_daily(ts)})"
        ),
        "date_spine_30d": """
            SELECT site, CAST(CAST(unnest(generate_series(
                       last - INTERVAL 29 DAY, last, INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS date
            FROM (SELECT site, max("timestamp") AS last FROM facts GROUP BY site)""",
        "fused_rollup": fused(ts),
        "failures_last_24h": _total("failures_last_24h", ts, "24h"),
        "failures_last_7d": _total("failures_last_7d", ts, "7d"),
        "top_sites_by_failures": _top_sites(ts, "7d"),
        "top_sites_30d": _top_sites(ts, "30d"),
        "exceptions_7d": _counts("failure_type", ts, "7d", '"count"'),
        "trend_30d": _trend(ts),
        "site_counts_7d": _counts("site", ts, "7d"),
        "site_counts_30d": _counts("site", ts, "30d"),
        **{
            f"window_filter_{w}": f"SELECT * FROM facts WHERE {between(ts, w)}" for w in _WINDOWS
        },
    }
    return {name: _with_facts(binding, sql) for name, sql in queries.items()}


def _with_facts(binding: Binding, sql: str) -> str:
    return f"WITH facts AS ({binding.facts_sql}) {sql}"


def _stamps(report_ts: str) -> str:
    return (
        f"'{fixed.SCHEMA_VERSION}' AS schema_version, '{GENERATED_AT}' AS generated_at,"
        f" '{report_ts}' AS report_ts"
    )


def _position(count: str, key: str) -> str:
    return f"row_number() OVER (ORDER BY {count} DESC, {key} ASC NULLS LAST) AS position"


def _site_items(report_ts: str, window: str) -> str:
    return (
        f"SELECT {_position('failures', 'site')}, site, failures"
        f" FROM ({_top_sites(report_ts, window)})"
    )


def _day_items(report_ts: str) -> str:
    return (
        "SELECT row_number() OVER (ORDER BY date) AS position, date, failures"
        f" FROM ({_trend(report_ts)})"
    )


def _type_items(report_ts: str) -> str:
    return (
        f"""SELECT {_position('"count"', 'failure_type')}, failure_type, "count" """
        f"""FROM ({_counts('failure_type', report_ts, '7d', '"count"')})"""
    )


def _payloads(report_ts: str) -> dict[str, str]:
    return {
        "payload_summary": (
            f"SELECT {_stamps(report_ts)}, n24.*, n7.*, items.*"
            f" FROM ({_site_items(report_ts, '7d')}) items,"
            f" ({_total('failures_last_24h', report_ts, '24h')}) n24,"
            f" ({_total('failures_last_7d', report_ts, '7d')}) n7"
        ),
        "payload_trend_30d": f"SELECT {_stamps(report_ts)}, * FROM ({_day_items(report_ts)})",
        "payload_top_sites": (
            f"SELECT {_stamps(report_ts)}, {fixed.TOP_SITES_WINDOW_DAYS} AS window_days, *"
            f" FROM ({_site_items(report_ts, '30d')})"
        ),
        "payload_exceptions": (
            f"SELECT {_stamps(report_ts)}, {fixed.EXCEPTIONS_WINDOW_DAYS} AS window_days, *"
            f" FROM ({_type_items(report_ts)})"
        ),
    }


def run_id_of(report_ts: str) -> str:
    return "".join(filter(str.isalnum, report_ts))


def _all_items(report_ts: str) -> str:
    parts = {
        fixed.SUMMARY: f"position, site AS item, failures AS n FROM ({_site_items(report_ts, '7d')})",
        fixed.TREND_30D: f"position, date AS item, failures AS n FROM ({_day_items(report_ts)})",
        fixed.TOP_SITES: (
            f"position, site AS item, failures AS n FROM ({_site_items(report_ts, '30d')})"
        ),
        fixed.EXCEPTIONS: (
            f'position, failure_type AS item, "count" AS n FROM ({_type_items(report_ts)})'
        ),
    }
    return " UNION ALL ".join(f"SELECT '{a}' AS artifact, {rest}" for a, rest in parts.items())


def _run_items(report_ts: str) -> str:
    return f"SELECT '{run_id_of(report_ts)}' AS run_id, * FROM ({_all_items(report_ts)})"


def _rules(**subqueries: str) -> str:
    """Rows ``(rule, violations)`` from one counting expression per rule."""
    return " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, CAST(({count}) AS BIGINT) AS violations"
        for rule, count in subqueries.items()
    )


_STAMP_RULES = {
    "schema_version is missing": "0",
    "generated_at is missing": "0",
    "report_ts is missing": "0",
}


def _item_rules(array: str, key: str, count: str, rows: str) -> dict[str, str]:
    return {
        f"{array} is missing": "0",
        f"{array} item is missing": "0",
        f"{array}.{key} is missing": f"SELECT count(*) FROM ({rows}) WHERE {key} IS NULL",
        f"{array}.{count} is not a count": (
            f'SELECT count(*) FROM ({rows}) WHERE "{count}" IS NULL OR "{count}" < 0'
        ),
    }


def _contracts(ts: str) -> dict[str, str]:
    n24 = _total("n", ts, "24h")
    n7 = _total("n", ts, "7d")
    days = f"SELECT CAST(date AS DATE) AS date, failures FROM ({_trend(ts)})"
    missing = {"document is missing": "0"}
    return {
        "contract_summary": _rules(
            **_STAMP_RULES,
            **{
                "failures_last_24h is not a count": f"SELECT count(*) FROM ({n24}) WHERE n < 0",
                "failures_last_7d is not a count": f"SELECT count(*) FROM ({n7}) WHERE n < 0",
                "failures_last_7d is below failures_last_24h": (
                    f"SELECT count(*) FROM ({n7}) a, ({n24}) b WHERE a.n < b.n"
                ),
            },
            **_item_rules("top_sites", "site", "failures", _top_sites(ts, "7d")),
            **missing,
        ),
        "contract_trend_30d": _rules(
            **_STAMP_RULES,
            **{
                "days is missing": "0",
                "days.date is missing": f"SELECT count(*) FROM ({days}) WHERE date IS NULL",
                "days.failures is not a count": (
                    f"SELECT count(*) FROM ({days}) WHERE failures IS NULL OR failures < 0"
                ),
                "days are not 30": (
                    f"SELECT CASE WHEN count(*) = {fixed.TREND_DAYS} THEN 0 ELSE 1 END"
                    f" FROM ({days})"
                ),
                "days are not consecutive": (
                    "SELECT CASE WHEN count(DISTINCT date) = count(*)"
                    " AND max(date) - min(date) = count(*) - 1 THEN 0 ELSE 1 END"
                    f" FROM ({days})"
                ),
            },
            **missing,
        ),
        "contract_top_sites": _rules(
            **_STAMP_RULES,
            **{"window_days is below 1": "0"},
            **_item_rules("sites", "site", "failures", _top_sites(ts, "30d")),
            **missing,
        ),
        "contract_exceptions": _rules(
            **_STAMP_RULES,
            **{"window_days is below 1": "0"},
            **_item_rules(
                "exceptions",
                "failure_type",
                "count",
                _counts("failure_type", ts, "7d", '"count"'),
            ),
            **missing,
        ),
    }


# Checks of stored documents have no table to count in: nothing may be wrong in them.
_MANIFEST_RULES = (
    *_STAMP_RULES,
    "run_id is missing",
    "artifacts is missing",
    "status is unknown",
    "artifacts item is missing",
    "document is missing",
)
_CONSISTENCY_RULES = ("report_ts differs within a run", "generated_at differs within a run")
_STORED_VALUES = {
    fixed.SUMMARY: (
        "failures_last_24h",
        "failures_last_7d",
        "generated_at",
        "report_ts",
        "schema_version",
        "top_sites",
        "top_sites.failures",
        "top_sites.site",
    ),
    fixed.TREND_30D: (
        "days",
        "generated_at",
        "report_ts",
        "schema_version",
        "days.date",
        "days.failures",
    ),
    fixed.TOP_SITES: (
        "generated_at",
        "report_ts",
        "schema_version",
        "sites",
        "window_days",
        "sites.failures",
        "sites.site",
    ),
    fixed.EXCEPTIONS: (
        "exceptions",
        "generated_at",
        "report_ts",
        "schema_version",
        "window_days",
        "exceptions.count",
        "exceptions.failure_type",
    ),
    fixed.MANIFEST: (
        "artifacts",
        "generated_at",
        "report_ts",
        "run_id",
        "schema_version",
        "status",
        "artifacts item",
    ),
}
_STORED_ITEMS = {
    fixed.SUMMARY: ("top_sites item keys differ",),
    fixed.TREND_30D: ("days item keys differ",),
    fixed.TOP_SITES: ("sites item keys differ",),
    fixed.EXCEPTIONS: ("exceptions item keys differ",),
    fixed.MANIFEST: ("status is unknown",),
}


def _stored_json() -> str:
    def rules(artifact: str) -> list[str]:
        values = [f"{name} has a wrong value" for name in _STORED_VALUES[artifact]]
        rest = ("text is not JSON", "keys differ", "document is missing")
        return [*rest, *values, *_STORED_ITEMS[artifact]]

    return " UNION ALL ".join(
        f"SELECT '{artifact}' AS artifact, '{rule}' AS rule, CAST(0 AS BIGINT) AS violations"
        for artifact in fixed.ALL_ARTIFACTS
        for rule in rules(artifact)
    )


def _event_contracts() -> dict[str, str]:
    def events(condition: str) -> str:
        return f"SELECT count(*) FROM events WHERE {condition}"

    def differing(users: str, value: str) -> str:
        return (
            f"SELECT count(*) FROM (SELECT user_id FROM events WHERE {users} GROUP BY user_id"
            f" HAVING count(DISTINCT {value}) > 1)"
        )

    manifests = dict.fromkeys(_MANIFEST_RULES, "0") | {
        "generated_at is missing": events("user_id % 5 = 0"),
        "artifacts is missing": events("event_id % 7 <> 0 AND event_id % 11 = 0"),
        "artifacts item is missing": events("event_id % 7 = 0"),
        "status is unknown": events("event_type = 'click'"),
    }
    values = [f"{name} has a wrong value" for name in _STORED_VALUES[fixed.SUMMARY]]
    rules = ["text is not JSON", "keys differ", "document is missing", *values, *_STORED_ITEMS[fixed.SUMMARY]]
    texts = dict.fromkeys(rules, "0") | {
        "text is not JSON": events("event_type = 'error'"),
        "keys differ": events("event_type = 'view'"),
        "failures_last_24h has a wrong value": events("event_type = 'click'"),
        "top_sites.site has a wrong value": events("event_type = 'signup'"),
    }
    return {
        "contract_event_manifests": _rules(**manifests),
        "contract_event_consistency": _rules(
            **{
                "report_ts differs within a run": differing("user_id % 3 = 0", "event_type"),
                "generated_at differs within a run": differing("user_id % 4 = 0", "event_id"),
            }
        ),
        "contract_event_json": _rules(**texts),
    }


def _manifest_items(report_ts: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {_stamps(report_ts)}, '{run_id_of(report_ts)}' AS run_id,"
        f" '{fixed.STATUS_SUCCESS}' AS status, {i} AS position, '{artifact}' AS artifact"
        for i, artifact in enumerate(fixed.PAYLOAD_ARTIFACTS, 1)
    )


def run_log(report_ts: str) -> str:
    days, sites, types = _trend(report_ts), _top_sites(report_ts, "30d"), _type_items(report_ts)
    counts = {
        "failures_last_24h": _total("n", report_ts, "24h"),
        "failures_last_7d": _total("n", report_ts, "7d"),
        "trend_30d": f"SELECT count(*) FROM ({days})",
        "top_sites": f"SELECT count(*) FROM ({sites})",
        "exceptions": f"SELECT count(*) FROM ({types})",
    }
    return " UNION ALL ".join(
        f"SELECT '{run_id_of(report_ts)}' AS run_id, '{name}' AS metric, ({sql}) AS n"
        for name, sql in counts.items()
    )


def _latest(report_ts: str) -> str:
    return (
        f"SELECT '{run_id_of(report_ts)}' AS run_id, {_stamps(report_ts)},"
        f" '{fixed.STATUS_SUCCESS}' AS status, n24.*, n7.*"
        f" FROM ({_total('failures_last_24h', report_ts, '24h')}) n24,"
        f" ({_total('failures_last_7d', report_ts, '7d')}) n7"
    )


def _ranked_by(scope: str, counts: str) -> str:
    return (
        f"SELECT {scope}, row_number() OVER (PARTITION BY {scope}"
        f" ORDER BY failures DESC, site ASC NULLS LAST) AS position, site, failures"
        f" FROM ({counts}) QUALIFY position <= {fixed.TOP_K}"
    )


def _by_client(ts: str) -> dict[str, str]:
    in_7d, in_30d = between(ts, "7d"), between(ts, "30d")
    top = f"SELECT client, site, count(*) AS failures FROM facts WHERE {in_30d} GROUP BY ALL"
    return {
        "failures_by_client": (
            f"SELECT client, count(*) FILTER (WHERE {in_7d}) AS failures_last_7d"
            " FROM facts GROUP BY client"
        ),
        "top_sites_by_client": _ranked_by("client", top),
        "exceptions_by_client": (
            f'SELECT client, failure_type, count(*) AS "count" FROM facts WHERE {in_7d}'
            " GROUP BY ALL"
        ),
        "trend_by_client": (
            "SELECT c.client, CAST(s.date AS VARCHAR) AS date, coalesce(d.failures, 0) AS failures"
            f" FROM (SELECT DISTINCT client FROM facts) c CROSS JOIN ({spine(ts)}) s"
            ' LEFT JOIN (SELECT client, CAST("timestamp" AS DATE) AS date, count(*) AS failures'
            f" FROM facts WHERE {in_30d} GROUP BY ALL) d"
            " ON d.client IS NOT DISTINCT FROM c.client AND d.date = s.date"
        ),
    }


def _instants(instants: tuple[str, ...]) -> str:
    return "(VALUES {}) r(report_ts, anchor)".format(", ".join(f"('{ts}', {instant_of(ts)})" for ts in instants))


def in_run(window: str) -> str:
    return f'"timestamp" BETWEEN anchor - INTERVAL {_WINDOWS[window]} AND anchor'


def backfill_sql(instants: tuple[str, ...]) -> str:
    return f"""
    SELECT report_ts, site, failure_type, CAST(date AS VARCHAR) AS date,
           GROUPING(site, failure_type, date) AS grain,
           count(*) FILTER (WHERE {in_run("24h")}) AS n_24h,
           count(*) FILTER (WHERE {in_run("7d")}) AS n_7d,
           count(*) AS n_30d
    FROM (SELECT *, CAST("timestamp" AS DATE) AS date FROM facts JOIN {_instants(instants)}
          ON {in_run("30d")})
    GROUP BY GROUPING SETS ((report_ts, site), (report_ts, failure_type, date))"""


_TOP_SITES_BY_RUN = _ranked_by(
    "report_ts",
    "SELECT report_ts, site, count(*) AS failures FROM facts"
    f" JOIN {_instants(BACKFILL)} ON {in_run('7d')} GROUP BY ALL",
)


_SYNTHETIC = f"""
    WITH d AS (
        SELECT event_id AS id, md5('{fixed.SYNTHETIC_SEED}:' || event_id) AS h FROM events
    ),
    draws AS (
        SELECT id,
               CAST('0x' || substr(h, 1, 8) AS BIGINT) AS a,
               CAST('0x' || substr(h, 9, 8) AS BIGINT) AS b,
               CAST('0x' || substr(h, 17, 8) AS BIGINT) AS c,
               CAST('0x' || substr(h, 25, 8) AS BIGINT) AS e
        FROM d
    )
    SELECT list_extract({list(fixed.SYNTHETIC_SITES)}, a % 5 + 1) AS site,
           {instant_of(fixed.SYNTHETIC_ANCHOR)}
               - to_seconds(b % {fixed.SYNTHETIC_DAYS * 86400 + 1}) AS "timestamp",
           list_extract({list(fixed.SYNTHETIC_FAILURE_TYPES)}, c % 5 + 1) AS failure_type,
           format('doc_{{:06d}}_{{}}', id, e % 9000 + 1000) AS document_id
    FROM draws"""


def all_oracles() -> dict[str, str]:
    from checks import run_oracles  # which writes its SQL with the helpers above

    ts = EVENTS.report_ts
    bound = {
        f"{name}{suffix}": sql
        for suffix, binding in (("", EVENTS), ("_orders", ORDERS), ("_lineitem", LINEITEM))
        for name, sql in _on_facts(binding).items()
    }
    on_events = {
        "fact_write_roundtrip": (
            'SELECT *, CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS event_date FROM facts'
        ),
        "metric_foreign_event_date": f"SELECT count(*) AS failures_last_7d FROM facts WHERE {between(ts, '7d')}",
        "run_id": (
            "SELECT document_id, regexp_replace(strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%SZ'),"
            " '[^a-zA-Z0-9]', '', 'g') AS run_id FROM facts"
        ),
        **_payloads(ts),
        "payload_roundtrip": _all_items(ts),
        "payload_exceptions_paged": (
            "SELECT CAST((position - 1) // 100 AS INTEGER) AS page, position, failure_type, \"count\" FROM ("
            'SELECT row_number() OVER (ORDER BY "count" DESC, failure_type) AS position, * FROM ('
            f'SELECT document_id AS failure_type, count(*) AS "count" FROM facts WHERE {between(ts, "7d")}'
            " GROUP BY ALL))"
        ),
        "run_status": (
            f"SELECT '{run_id_of(EARLIER_TS)}' AS run_id, 'SUCCESS' AS status, count(*) AS failures_last_7d"
            f" FROM facts WHERE {between(EARLIER_TS, '7d')} UNION ALL"
            f" SELECT '{run_id_of(ts)}', CASE WHEN count(*) > 0 THEN 'ERROR' ELSE 'SUCCESS' END, NULL"
            f" FROM facts WHERE {between(ts, '30d')}"
        ),
        **_contracts(ts),
        "run_history": f"{_run_items(EARLIER_TS)} UNION ALL {_run_items(ts)}",
        "latest_run": _latest(ts),
        "current_payloads": _run_items(ts),
        "backfill_runs": backfill_sql(BACKFILL),
        "top_sites_by_run": _TOP_SITES_BY_RUN,
        "run_metrics_log": f"{run_log(EARLIER_TS)} UNION ALL {run_log(ts)}",
    }
    by_client = {
        name: f"WITH facts AS ({CLIENT_ORDERS_SQL}) {sql}"
        for name, sql in _by_client(ORDERS.report_ts).items()
    }
    return (
        bound
        | by_client
        | {name: _with_facts(EVENTS, sql) for name, sql in on_events.items()}
        | _event_contracts()
        | {
            "fact_write_client_roundtrip": (
                f"WITH facts AS ({CLIENT_ORDERS_SQL})"
                ' SELECT *, CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS event_date FROM facts'
            ),
            "synthetic_failures": _SYNTHETIC,
            "contract_manifest": _rules(**dict.fromkeys(_MANIFEST_RULES, "0")),
            "contract_run_consistency": _rules(**dict.fromkeys(_CONSISTENCY_RULES, "0")),
            "contract_stored_json": _stored_json(),
            "run_manifest": f"{_manifest_items(EARLIER_TS)} UNION ALL {_manifest_items(ts)}",
        }
        | run_oracles.run_oracles()
    )
