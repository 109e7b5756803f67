"""Stored partial aggregates: counts per hour and key, out of which a rollup takes all whole hours of its windows.

Layout below one path::

    data/version=…/          counts by hour and site, and by hour and failure type
    commits/<version>.json   the hours that version counts, created once it is stored whole
    commits/<version>.all.json   the version of every hour so far, so that few commits are opened

Counts add up, so a window is the sum of its hours. Of an hour counts the newest version that counts it: late rows have their
hours, and no others, counted anew from the facts. Nothing is overwritten under a reader.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmetrics.functions.windows import (
    LAST_7D,
    LAST_24H,
    LAST_30D,
    day_bucket,
    in_window,
    instant,
    normalise_report_ts,
    trailing_days,
)
from trailmetrics.operators.rollup import BY_SITE, BY_TYPE_AND_DATE
from trailmetrics.operators.slots import HOUR_MICROS
from trailmetrics.session import session_zone
from trailmetrics.sources.facts import between_days
from trailmetrics.sources.objects import names_in, put_once, read_text

FOLD_AFTER = 32
_SCHEMA = "hour bigint, grain bigint, site string, failure_type string, n bigint, version string"

Ranges = list[tuple[int, int]]


def hour_of(event_time: Column) -> Column:
    """Hours since 1970 in UTC, whatever the session zone."""
    return F.floor(F.unix_micros(event_time) / HOUR_MICROS)


def _ranges(hours: Iterable[int]) -> Ranges:
    found: list[list[int]] = []
    for hour in sorted(hours):
        if found and found[-1][1] == hour - 1:
            found[-1][1] = hour
        else:
            found.append([hour, hour])
    return [(first, last) for first, last in found]


def _counts(facts: DataFrame) -> DataFrame:
    """Both grains of some facts; each task sends a row per hour and key."""
    rows = facts.where(F.col("timestamp").isNotNull()).select(hour_of(F.col("timestamp")).alias("hour"), "site", "failure_type")
    sites = rows.groupBy("hour", "site").agg(F.count("*").alias("n")).withColumn("grain", F.lit(BY_SITE).cast("bigint"))
    types = rows.groupBy("hour", "failure_type").agg(F.count("*").alias("n")).withColumn("grain", F.lit(BY_TYPE_AND_DATE).cast("bigint"))
    both = sites.unionByName(types, allowMissingColumns=True)
    return both.select("hour", "grain", "site", "failure_type", "n")


def _store(counts: DataFrame, path: str, ranges: Ranges) -> str:
    """Write a version and commit it; versions sort by when they were begun."""
    spark = counts.sparkSession
    while True:
        taken = [name.split(".")[0] for name in names_in(spark, f"{path}/commits")]
        number = int(taken[-1].split("-")[0]) + 1 if taken else 1
        version = f"{number:012d}-{uuid.uuid4().hex}"
        counts.repartitionByRange("hour").sortWithinPartitions("hour").write.parquet(f"{path}/data/version={version}")
        # the number is taken once: of two that began on the same one, the other counts its hours anew on top
        if put_once(spark, f"{path}/commits/{number:012d}.json", json.dumps({"version": version, "hours": ranges})):
            break
    commits, folded = _commits(spark, path)
    if len(commits) >= FOLD_AFTER:
        put_once(spark, f"{path}/commits/{number:012d}.all.json", json.dumps({"versions": folded}))
    return version


def _commits(spark: SparkSession, path: str) -> tuple[list[str], list[tuple[int, int, str]]]:
    """The commits since the last fold, and ``(first, last, version)`` of all hours."""
    names = names_in(spark, f"{path}/commits")
    folds = [name for name in names if name.endswith(".all.json")]
    later = [name for name in names if not name.endswith(".all.json") and (not folds or name[:12] > folds[-1][:12])]
    held: list[tuple[int, int, str]] = []
    if folds:
        held = [tuple(row) for row in json.loads(read_text(spark, f"{path}/commits/{folds[-1]}"))["versions"]]
    for name in later:
        commit = json.loads(read_text(spark, f"{path}/commits/{name}"))
        for first, last in commit["hours"]:
            rest = []
            for a, b, version in held:  # what the new version does not count anew
                rest += [(low, high, version) for low, high in ((a, min(b, first - 1)), (max(a, last + 1), b)) if low <= high]
            held = [*rest, (first, last, commit["version"])]
    return later, sorted(held)


def write_partials(facts: DataFrame, path: str) -> str | None:
    """Count all hours from the first fact to the last; None without facts."""
    hour = hour_of(F.col("timestamp"))
    ends = facts.agg(F.min(hour).alias("first"), F.max(hour).alias("last")).first()
    return None if ends.first is None else _store(_counts(facts), path, [(ends.first, ends.last)])


def refresh_partials(facts: DataFrame, path: str, late: DataFrame) -> Ranges:
    """Count the hours of some late rows anew, from all facts of these hours; the hours. The driver sees one row per hour."""
    hours = late.where(F.col("timestamp").isNotNull()).select(hour_of(F.col("timestamp")).alias("hour")).distinct()
    ranges = _ranges(row.hour for row in hours.collect())
    if ranges:
        _store(_counts(_facts_in(facts, ranges)), path, ranges)
    return ranges


def _moment(hour: int) -> Column:
    return F.timestamp_micros(F.lit(hour * HOUR_MICROS))


def _facts_in(facts: DataFrame, ranges: Ranges) -> DataFrame:
    """The facts of some hours, by bounds on their time that reach the scan; of stored days, those they touch."""
    event_time, held = F.col("timestamp"), F.lit(False)
    for first, last in ranges:
        held = held | ((event_time >= _moment(first)) & (event_time < _moment(last + 1)))
    touched = between_days(facts, _moment(ranges[0][0]), _moment(ranges[-1][1]))
    return touched.where(held)


def _edges(spark: SparkSession, report_ts: str, tz: str) -> tuple[list[int], int, int]:
    """Where, in microseconds, a window or a day of the zone begins, or what follows the report instant; the first and last hour."""
    with session_zone(spark, tz):
        anchor = instant(report_ts)
        days = F.transform(
            F.filter(trailing_days(anchor, LAST_30D.days + 2), lambda d: d.isNotNull()), lambda d: F.unix_micros(d.cast("timestamp"))
        )
        bounds = [F.unix_micros(anchor - window.interval) for window in (LAST_24H, LAST_7D, LAST_30D)]
        row = spark.range(1).select(days.alias("days"), F.array(*bounds).alias("bounds"), F.unix_micros(anchor).alias("anchor")).first()
    low = min(row.bounds)
    edges = [*row.bounds, row.anchor + 1, *(day for day in row.days if low <= day <= row.anchor)]
    return edges, low // HOUR_MICROS, row.anchor // HOUR_MICROS


def rollup_from_partials(facts: DataFrame, path: str, report_ts: str, tz: str = "UTC") -> DataFrame:
    """``rollup``, row for row: whole hours out of the stored counts, and only the rest out of the facts.

    The rest are hours in which a window or a day of the zone begins or ends, four or so, and those that no version counts yet.
    """
    spark, report_ts = facts.sparkSession, normalise_report_ts(report_ts)
    edges, first, last = _edges(spark, report_ts, tz)
    cut = {edge // HOUR_MICROS for edge in edges if edge % HOUR_MICROS}
    _, held = _commits(spark, path)
    stored = {hour: version for a, b, version in held for hour in range(max(a, first), min(b, last) + 1) if hour not in cut}
    rest = _ranges(hour for hour in range(first, last + 1) if hour not in stored)
    listed = spark.createDataFrame(list(stored.items()), "hour bigint, version string")
    whole = spark.createDataFrame([], _SCHEMA)
    if stored:
        counts = spark.read.schema(_SCHEMA).parquet(f"{path}/data").where(F.col("hour").between(first, last))
        whole = counts.where(F.col("version").isin(sorted(set(stored.values())))).join(F.broadcast(listed), ["hour", "version"])  # a row an hour
    with session_zone(spark, tz):
        anchor, moment = instant(report_ts), F.timestamp_micros(F.col("hour") * HOUR_MICROS)
        windows = {"n_24h": LAST_24H, "n_7d": LAST_7D, "n_30d": LAST_30D}

        def dated(rows: DataFrame, event_time: Column, n: Column) -> DataFrame:
            counts = [F.when(in_window(event_time, anchor, window), n).otherwise(0).alias(name) for name, window in windows.items()]
            return rows.where(in_window(event_time, anchor, LAST_30D)).select("grain", "site", "failure_type", day_bucket(event_time).alias("date"), *counts)

        parts = dated(whole, moment, F.col("n"))
        if rest:
            event_time = F.col("timestamp")
            edge = _facts_in(facts, rest).select(
                event_time, "site", "failure_type", F.explode(F.array(F.lit(BY_SITE), F.lit(BY_TYPE_AND_DATE))).alias("grain")
            )
            parts = parts.unionAll(dated(edge, event_time, F.lit(1)))
    by_site = F.col("grain") == BY_SITE
    keyed = parts.select(
        F.when(by_site, F.col("site")).alias("site"),
        F.when(~by_site, F.col("failure_type")).alias("failure_type"),
        F.when(~by_site, F.col("date")).alias("date"),
        F.col("grain").cast("bigint").alias("grain"),
        *windows,
    )
    return keyed.groupBy("site", "failure_type", "date", "grain").agg(*[F.sum(name).cast("bigint").alias(name) for name in windows])
