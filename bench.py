"""Time the six metrics, one query each, against the fused rollup, a whole publishing run, and 30 runs in one pass.

Prints one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from checks.bindings import EVENTS, LINEITEM
from trailmetrics import fixed_values as fixed
from trailmetrics.operators import catalog, rollup
from trailmetrics.plans import backfill, history, partials, publish
from trailmetrics.session import scratch_path

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROUNDS = 3


def seconds(action: Callable[[], object]) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def all_rows(df: DataFrame) -> list:
    return df.collect()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    report_ts = LINEITEM.report_ts
    root = scratch_path(spark, "bench")

    facts = LINEITEM.facts(spark, SF_DIR)
    actions: dict[str, Callable[[int], object]] = {
        name: lambda _, name=name: all_rows(catalog.metric(name, facts, report_ts))
        for name in fixed.REQUIRED_METRICS
    }
    actions["fused_rollup"] = lambda _: all_rows(rollup.rollup(facts, report_ts))
    actions["publish_run"] = lambda i: publish.publish_run(
        spark, facts, root, f"1998-12-01T00:00:{i:02d}Z"
    )

    events = EVENTS.facts(spark, SF_DIR)
    instants = [f"2024-01-{day:02d}T12:00:00Z" for day in range(1, 31)]
    actions["events_rollup"] = lambda _: all_rows(rollup.rollup(events, EVENTS.report_ts))
    actions["backfill_rollup"] = lambda _: backfill.backfill_rollup(events, instants).count()
    counts = scratch_path(spark, "bench-partials")
    partials.write_partials(facts, counts)
    actions["rollup_from_partials"] = lambda _: all_rows(partials.rollup_from_partials(facts, counts, report_ts))
    actions["backfill_reports"] = lambda i: backfill.backfill_reports(spark, events, scratch_path(spark, f"bench-{i}"), instants)
    actions["open_current"] = lambda _: all_rows(history.open_current(spark, root))

    timings = {
        name: statistics.median(
            [seconds(lambda: action(i)) for i in range(ROUNDS + 1)][1:]  # the first one warms up
        )
        for name, action in actions.items()
    }
    six = sum(timings[name] for name in fixed.REQUIRED_METRICS)
    print(
        json.dumps(
            {
                "metric": "six windowed metrics, one query each",
                "value": round(six, 3),
                "unit": "sec",
                "queries": {name: round(t, 3) for name, t in timings.items()},
                "sf": Path(SF_DIR).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
