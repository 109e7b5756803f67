"""Building blocks of the metrics for any key, window and number of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmetrics import fixed_values as fixed
from trailmetrics.functions.windows import Trailing, day_bucket, trailing_days
from trailmetrics.sources.facts import facts_in_window


def counts_by(
    facts: DataFrame, key: str, report_ts: str, window: Trailing, count: str = "failures"
) -> DataFrame:
    """Failures per key in the window. NULL keys form a group of their own.

    Partial aggregation leaves one row per key and task to shuffle, so a hot key costs no more
    than a cold one.
    """
    return (
        facts_in_window(facts, report_ts, window)
        .groupBy(key)
        .agg(F.count("*").alias(count))
    )


def daily_counts(facts: DataFrame, report_ts: str, window: Trailing) -> DataFrame:
    """Failures per calendar day of the session zone, days without any left out."""
    return (
        facts_in_window(facts, report_ts, window)
        .groupBy(day_bucket(F.col("timestamp")).alias("date"))
        .agg(F.count("*").alias("failures"))
    )


def top_k(counts: DataFrame, key: str, count: str = "failures", k: int = fixed.TOP_K) -> DataFrame:
    """The ``k`` largest counts, ties by key; each task passes on at most ``k`` rows."""
    return counts.orderBy(F.desc(count), F.asc_nulls_last(key)).limit(k)


def date_spine(anchors: DataFrame, anchor: Column, days: int = fixed.TREND_DAYS) -> DataFrame:
    """``days`` rows per row of ``anchors``, one for each date up to that of ``anchor``."""
    return anchors.withColumn("date", F.explode(trailing_days(anchor, days)))


def zero_filled(spine: DataFrame, per_day: DataFrame) -> DataFrame:
    """The daily series of a report, in no order: each spine date with its count, or zero.

    ``per_day`` covers one window and so has at most one row per day of it: safe to broadcast.
    """
    return spine.join(F.broadcast(per_day), "date", "left").select(
        "date", F.coalesce("failures", F.lit(0)).alias("failures")
    )
