"""Recompute history: the runs of many report instants from one pass over the facts."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmetrics import fixed_values as fixed
from trailmetrics.functions.windows import (
    LAST_7D,
    LAST_24H,
    LAST_30D,
    day_bucket,
    normalise_report_ts,
    run_id_of,
)
from trailmetrics.operators import documents
from trailmetrics.operators.contracts import ContractViolation
from trailmetrics.operators.slots import slotted
from trailmetrics.plans import history, publish
from trailmetrics.session import materialise, session_zone
from trailmetrics.sources.facts import between_days, check_fact_schema

_WINDOWS = {"n_24h": LAST_24H, "n_7d": LAST_7D, "n_30d": LAST_30D}


def _sorted_stamps(report_instants: Sequence[str]) -> list[str]:
    return sorted({normalise_report_ts(ts) for ts in report_instants})


def instants(spark: SparkSession, report_instants: Sequence[str]) -> DataFrame:
    """``(report_ts)``, one row per distinct instant."""
    stamps = _sorted_stamps(report_instants)
    return spark.createDataFrame([(ts,) for ts in stamps], "report_ts STRING")


@dataclass
class _Class:
    """Runs in order of their instants whose window bounds rise with them."""

    first: int = 0
    stamps: list[str] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    bounds: list[tuple[int, ...]] = field(default_factory=list)


def _classes(runs: DataFrame) -> list[_Class]:
    """All runs, numbered through their classes. There is one, but where a clock change makes a later window open earlier.

    Windows hold both their ends, so each begins at its lower bound and ends a microsecond after its
    report instant. The driver sees four bounds for each instant it was given itself.
    """
    bounds = [F.unix_micros(name).alias(name) for name in _WINDOWS]
    rows = runs.select("report_ts", (F.unix_micros("anchor") + 1).alias("end"), *bounds).collect()
    classes: list[_Class] = []
    for row in sorted(rows, key=lambda row: row.end):
        opened = tuple(row[name] for name in _WINDOWS)
        fits = (c for c in classes if all(a <= b for a, b in zip(c.bounds[-1], opened)))
        own = next(fits, None)
        if own is None:
            own = _Class()
            classes.append(own)
        own.stamps.append(row.report_ts)
        own.ends.append(row.end)
        own.bounds.append(opened)
    for before, own in zip(classes, classes[1:]):
        own.first = before.first + len(before.stamps)
    return classes


def _slots(spark: SparkSession, edges: list[int], classes: list[_Class]) -> DataFrame:
    """``(at, first, n_24h, n_7d, n_30d)``: for the slot from each edge on, and each class, the run from which on it is held, and for each
    window the one from which on it is not any more."""
    rows = []
    for own in classes:
        opened = list(zip(*own.bounds))
        for at in edges:
            first = bisect_right(own.ends, at)
            until = [max(first, bisect_right(bounds, at)) for bounds in opened]
            if max(until) > first:
                rows.append((at, own.first + first, *(own.first + run for run in until)))
    return spark.createDataFrame(rows, "at BIGINT, first INT, " + ", ".join(f"{name} INT" for name in _WINDOWS))


def backfill_rollup(
    facts: DataFrame, report_instants: Sequence[str], tz: str = "UTC"
) -> DataFrame:
    """The rollup of every report instant, as rows of one table with a ``report_ts``.

    The edges of all windows cut time into slots; within one, all facts are in the same windows. Each
    fact finds its slot by its hour, is counted there once, and never shuffled. The runs that hold a slot in a window
    are neighbours, so the slot's count is added to all of them as a rise at the first and a fall after the last:
    sums over these steps, run after run, are the counts of each key. Work grows with slots and runs, not with
    their product, and a key has a row per step, not per fact.
    """
    spark = facts.sparkSession
    with session_zone(spark, tz):
        anchor = F.col("report_ts").cast("timestamp")
        runs = instants(spark, report_instants).select(
            "report_ts",
            anchor.alias("anchor"),
            *[(anchor - window.interval).alias(name) for name, window in _WINDOWS.items()],
        )
        classes = _classes(runs)
        edges = sorted({at for own in classes for at in (*own.ends, *(b for bounds in own.bounds for b in bounds))})
        # the earliest bound need not be that of the earliest instant
        ends = [F.timestamp_micros(F.lit(end)) for end in (edges[0], edges[-1])]
        keys = ["site", "failure_type", "date"]
        day = day_bucket(F.col("timestamp")).alias("date")
        counts = (
            slotted(between_days(facts, *ends), edges, "site", "failure_type", day)
            .groupingSets([["at", "site"], ["at", "failure_type", "date"]], "at", *keys)
            .agg(F.grouping_id().alias("grain"), F.count("*").alias("n"))
        )
    steps = counts.join(F.broadcast(_slots(spark, edges, classes)), "at")  # four rows at most for each instant and class
    zero, n = F.lit(0).cast("bigint"), F.col("n")

    def step(run: str, rises: bool) -> Column:
        changes = [(n if rises else -n if run == name else zero).alias(f"d_{name}") for name in _WINDOWS]
        return F.struct(F.col(run).alias("run"), *changes)

    steps = steps.select(*keys, "grain", F.inline(F.array(step("first", True), *[step(name, False) for name in _WINDOWS])))
    steps = steps.groupBy(*keys, "grain", "run").agg(*[F.sum(f"d_{name}").alias(f"d_{name}") for name in _WINDOWS])
    along = W.partitionBy(*keys, "grain").orderBy("run")
    so_far = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    levels = steps.select(
        *keys, "grain", "run", F.lead("run").over(along).alias("until"), *[F.sum(f"d_{name}").over(so_far).alias(name) for name in _WINDOWS]
    )
    held = levels.where("n_30d > 0").withColumn("run", F.explode(F.sequence(F.col("run"), F.col("until") - 1)))
    numbered = [(own.first + i, ts) for own in classes for i, ts in enumerate(own.stamps)]
    named = spark.createDataFrame(numbered, "run INT, report_ts STRING")
    return held.join(F.broadcast(named), "run").select("report_ts", *keys, "grain", *_WINDOWS)


def backfill_reports(
    spark: SparkSession,
    facts: DataFrame,
    root: str,
    report_instants: Sequence[str],
    generated_at: str | None = None,
    k: int = fixed.TOP_K,
    tz: str = "UTC",
    page_items: int = documents.PAGE_ITEMS,
) -> publish.Batch:
    """Publish the runs of all report instants that are not committed yet, in one pass: the facts are read
    once, and as many jobs run for one report as for all.

    A backfill that stopped is simply started again. Runs that break a contract do not keep the others.
    """
    check_fact_schema(facts)
    stamps = [ts for ts in _sorted_stamps(report_instants) if not history.is_committed(spark, root, run_id_of(ts))]
    if not stamps:
        return publish.Batch()
    rolled = materialise(backfill_rollup(facts, stamps, tz), "backfill")
    base = f"{root}/batches/{run_id_of(stamps[0])}-{uuid.uuid4().hex}"
    reports = instants(spark, stamps)
    return publish.publish_reports(rolled, ["report_ts"], reports, lambda _: root, base, generated_at, k, tz, page_items)


def backfill_runs(
    spark: SparkSession,
    facts: DataFrame,
    root: str,
    report_instants: Sequence[str],
    generated_at: str | None = None,
    k: int = fixed.TOP_K,
    tz: str = "UTC",
    page_items: int = documents.PAGE_ITEMS,
) -> list[publish.PublishedRun]:
    """``backfill_reports``, oldest first; ContractViolation if one of them broke its contract, once the others are committed."""
    batch = backfill_reports(spark, facts, root, report_instants, generated_at, k, tz, page_items)
    if batch.broken:
        raise ContractViolation("; ".join(f"{key}: {said}" for key, said in sorted(batch.broken.items())))
    return batch.published
