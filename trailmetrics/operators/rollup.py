"""All metrics of a run in one job over the facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmetrics import fixed_values as fixed
from trailmetrics.functions.windows import (
    LAST_7D,
    LAST_24H,
    LAST_30D,
    day_bucket,
    in_window,
    instant,
    normalise_report_ts,
)
from trailmetrics.operators.windowed import date_spine, top_k, zero_filled
from trailmetrics.session import session_zone
from trailmetrics.sources.facts import facts_in_window

# grouping_id() over (site, failure_type, date): a set bit marks a key that is rolled up.
# Scope columns come first and are never rolled up, so they leave the ids as they are.
BY_SITE = 0b011
BY_TYPE_AND_DATE = 0b100
BY_TYPE = 0b101
BY_DATE = 0b110
TOTAL = 0b111

_COUNTS = ("n_24h", "n_7d", "n_30d")


def rollup(
    facts: DataFrame,
    report_ts: str,
    tz: str = "UTC",
    scope: Sequence[str] = (),
    shared_scan: bool = False,
) -> DataFrame:
    """Counts of the three windows by site, and by failure type and day, within each ``scope``.

    One job. Each task sends one row per site, or per type and day, it saw, so neither hot keys
    nor the number of facts decide the shuffle size. Types, days and totals all follow from the
    second grain, which stays small. ``grain`` tells a rolled-up key from a NULL one.

    By default the grains are two branches of the job that read two columns each: of a stored
    table that costs less than to copy each row for both. ``shared_scan`` makes them grouping
    sets over one scan, for facts that are costly to come by, such as the result of a join.
    """
    report_ts = normalise_report_ts(report_ts)
    with session_zone(facts.sparkSession, tz):
        event_time, anchor = F.col("timestamp"), instant(report_ts)
        rows = facts_in_window(facts, report_ts, LAST_30D).select(
            *scope,
            "site",
            "failure_type",
            day_bucket(event_time).alias("date"),
            in_window(event_time, anchor, LAST_24H).alias("in_24h"),
            in_window(event_time, anchor, LAST_7D).alias("in_7d"),
        )
    counts = [
        F.count_if("in_24h").alias("n_24h"),
        F.count_if("in_7d").alias("n_7d"),
        F.count("*").alias("n_30d"),
    ]
    by_site, by_type_and_date = [*scope, "site"], [*scope, "failure_type", "date"]
    if shared_scan:
        keys = [*scope, "site", "failure_type", "date"]
        sets = rows.groupingSets([by_site, by_type_and_date], *keys)
        return sets.agg(F.grouping_id().alias("grain"), *counts)
    sites = rows.groupBy(*by_site).agg(F.lit(BY_SITE).cast("bigint").alias("grain"), *counts)
    types = rows.groupBy(*by_type_and_date).agg(
        F.lit(BY_TYPE_AND_DATE).cast("bigint").alias("grain"), *counts
    )
    return sites.unionByName(types, allowMissingColumns=True).select(
        *scope, "site", "failure_type", "date", "grain", *_COUNTS
    )


def by_each_key(rolled: DataFrame) -> DataFrame:
    """Counts by site, by failure type, by day and in total, out of a materialised rollup."""
    keys = ("site", "failure_type", "date")
    rest = (
        rolled.where(F.col("grain") == BY_TYPE_AND_DATE)
        .drop("grain")
        .groupingSets([["failure_type"], ["date"], []], *keys)
        .agg(F.grouping_id().alias("grain"), *[F.sum(n).alias(n) for n in _COUNTS])
    )
    return rolled.where(F.col("grain") == BY_SITE).unionByName(rest)


def metrics_of(
    rolled: DataFrame,
    report_ts: str,
    k: int = fixed.TOP_K,
    tz: str = "UTC",
    ordered: bool = True,
) -> dict[str, DataFrame]:
    """The required metrics out of a rollup; equal, row for row, to those of the catalog.

    A key counts for a window only if it has rows there. Each metric reads the rollup again, so
    materialise it first. Documents sort their items themselves and need no ``ordered`` rows.
    """
    report_ts = normalise_report_ts(report_ts)
    by_type_and_date = rolled.where(F.col("grain") == BY_TYPE_AND_DATE)

    def total(column: str, name: str) -> DataFrame:
        return by_type_and_date.agg(F.coalesce(F.sum(column), F.lit(0)).alias(name))

    def sites(column: str) -> DataFrame:
        counts = rolled.where((F.col("grain") == BY_SITE) & (F.col(column) > 0))
        return top_k(counts.select("site", F.col(column).alias("failures")), "site", k=k)

    spark = rolled.sparkSession
    with session_zone(spark, tz):
        spine = date_spine(spark.range(1), instant(report_ts)).select("date")
    trend = zero_filled(
        spine, by_type_and_date.groupBy("date").agg(F.sum("n_30d").alias("failures"))
    )
    types = (
        by_type_and_date.groupBy("failure_type")
        .agg(F.sum("n_7d").alias("count"))
        .where(F.col("count") > 0)
    )
    if ordered:
        trend = trend.orderBy("date")
        types = types.orderBy(F.desc("count"), F.asc_nulls_last("failure_type"))
    return {
        "failures_last_24h": total("n_24h", "failures_last_24h"),
        "failures_last_7d": total("n_7d", "failures_last_7d"),
        "top_sites_by_failures": sites("n_7d"),
        "trend_30d": trend,
        "top_sites_30d": sites("n_30d"),
        "exceptions_7d": types,
    }
