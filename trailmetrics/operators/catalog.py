"""Catalog of the named metrics: one Spark SQL text each, bound to facts and a report instant."""

from __future__ import annotations

from collections.abc import Mapping
from importlib import resources
from importlib.resources.abc import Traversable
from pathlib import Path

from pyspark.sql import DataFrame

from trailmetrics import fixed_values as fixed
from trailmetrics.functions.windows import LAST_7D, LAST_24H, LAST_30D, normalise_report_ts
from trailmetrics.session import session_zone
from trailmetrics.sources.facts import prune_days

# As a resource, so that the texts are found in a zipped package too.
_SQL_FOLDER = resources.files(__package__) / "sql"

# How far back each metric looks: the day partitions it has to open.
_REACH = {
    "failures_last_24h": LAST_24H,
    "failures_last_7d": LAST_7D,
    "top_sites_by_failures": LAST_7D,
    "trend_30d": LAST_30D,
    "top_sites_30d": LAST_30D,
    "exceptions_7d": LAST_7D,
}


class MissingMetric(LookupError):
    """The catalog lacks a metric every run needs."""


def load_catalog(folder: str | Path | Traversable = _SQL_FOLDER) -> dict[str, str]:
    """Texts by metric name; fails before any query when a required one is missing."""
    texts = Path(folder).iterdir() if isinstance(folder, str) else folder.iterdir()
    catalog = {
        text.name.removesuffix(".sql"): text.read_text("utf-8")
        for text in sorted(texts, key=lambda text: text.name)
        if text.name.endswith(".sql")
    }
    missing = sorted(set(fixed.REQUIRED_METRICS) - catalog.keys())
    if missing:
        raise MissingMetric(f"no SQL for {', '.join(missing)} in {folder}")
    return catalog


def metric(
    name: str,
    facts: DataFrame,
    report_ts: str,
    k: int = fixed.TOP_K,
    tz: str = "UTC",
    catalog: Mapping[str, str] | None = None,
) -> DataFrame:
    """One metric as a lazy DataFrame; its bounds fold to constants and reach the scan.

    Metrics beyond the required ones may look back any time, so no day partition is left out
    for them.
    """
    catalog = load_catalog() if catalog is None else catalog
    report_ts = normalise_report_ts(report_ts)
    with session_zone(facts.sparkSession, tz):
        if name in _REACH:
            facts = prune_days(facts, report_ts, _REACH[name])
        return facts.sparkSession.sql(
            catalog[name], args={"report_ts": report_ts, "k": k}, facts=facts
        )


def all_metrics(
    facts: DataFrame, report_ts: str, k: int = fixed.TOP_K, tz: str = "UTC"
) -> dict[str, DataFrame]:
    """The required metrics, one query each; see ``rollup`` for all of them in one job."""
    catalog = load_catalog()
    return {
        name: metric(name, facts, report_ts, k, tz, catalog) for name in fixed.REQUIRED_METRICS
    }
