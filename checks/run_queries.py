"""Queries on histories of many runs: published in one pass, recovered, compacted, and read with faults in them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.bindings import EVENTS, ORDERS, client_orders
from trailmetrics import fixed_values as fixed
from trailmetrics.functions import windows
from trailmetrics.operators import catalog, documents, rollup, scoped, zoned
from trailmetrics.plans import backfill, history, partials, publish
from trailmetrics.session import materialise, scratch_path, session_zone
from trailmetrics.sources import facts as fact_source
from trailmetrics.sources.objects import put_once

Query = Callable[[SparkSession, str], DataFrame]

GENERATED_AT = "2024-01-30T12:00:05+00:00"
#: A run every seven hours of January, so that no two share all their window edges.
MANY = tuple(f"2024-01-{1 + hour // 24:02d}T{hour % 24:02d}:30:00Z" for hour in range(24, 30 * 24, 7))
#: A run a day.
DAILY = tuple(f"2024-01-{day:02d}T12:00:00Z" for day in range(3, 31))
TYPES_A_PAGE = 2
LARGE_K = 5000

_ITEM_FIELDS = {
    fixed.SUMMARY: ("site", "failures"),
    fixed.TREND_30D: ("date", "failures"),
    fixed.TOP_SITES: ("site", "failures"),
    fixed.EXCEPTIONS: ("failure_type", "count"),
}


def stored_items(stored: DataFrame, *others: str) -> DataFrame:
    """``(*others, artifact, position, item, n)`` of all stored payload documents."""

    def of(artifact: str) -> DataFrame:
        key, count = _ITEM_FIELDS[artifact]
        rows = documents.items(documents.from_json(stored, artifact), artifact)
        return rows.select(
            *others,
            F.lit(artifact).alias("artifact"),
            "position",
            F.col(key).alias("item"),
            F.col(count).alias("n"),
        )

    return reduce(DataFrame.unionAll, map(of, fixed.PAYLOAD_ARTIFACTS))


_roots: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, label: str, make: Callable[[str], object]) -> str:
    """A history that several queries read, made once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _roots:
        root = scratch_path(spark, label)
        make(root)
        _roots[key] = root
    return _roots[key]


def _daily_root(spark: SparkSession, sf_dir: str) -> str:
    facts = EVENTS.facts(spark, sf_dir)
    return _once(
        spark, sf_dir, "daily", lambda root: backfill.backfill_reports(spark, facts, root, DAILY, GENERATED_AT, page_items=TYPES_A_PAGE)
    )


def backfill_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of a hundred report instants by running sums over their windows' edges."""
    rolled = backfill.backfill_rollup(EVENTS.facts(spark, sf_dir), MANY)
    return rolled.withColumn("date", F.col("date").cast("string"))


def backfill_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of the documents of 28 runs that one pass computed, checked, stored and committed."""
    root = _daily_root(spark, sf_dir)
    runs = history.committed_runs(spark, root)
    stored = stored_items(history.documents_of_runs(spark, root, runs), documents.PAGE, "run_id")
    exceptions = F.col("artifact") == fixed.EXCEPTIONS
    return stored.withColumn(
        "position", F.when(exceptions, F.col("page") * TYPES_A_PAGE).otherwise(0) + F.col("position")
    ).drop("page")


def latest_run_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of 28 runs and how many there are, read from a month's snapshot and the objects after it."""
    root = _daily_root(spark, sf_dir)
    late = "20240130T180000Z"
    runs = history.committed_runs(spark, root)
    if not history.is_committed(spark, root, late):
        entry = history.latest_run(runs).first().asDict()
        history.record_failure(spark, root, entry | {"run_id": late, "attempt": "a-late", "status": fixed.STATUS_ERROR, "failed": True})
    runs = history.committed_runs(spark, root)
    return history.latest_run(runs).select(
        "run_id",
        "report_ts",
        "status",
        *[F.col("metrics")[name].alias(name) for name in ("failures_last_24h", "failures_last_7d")],
        F.lit(runs.count()).alias("runs"),
    )


def commit_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose registry objects lost writers had begun: by the number of the day's events an empty one, one that is cut, or none.

    Each is committed once all the same, and of two attempts the first counts.
    """
    root = scratch_path(spark, "torsos")
    facts = EVENTS.facts(spark, sf_dir)
    with session_zone(spark, "UTC"):
        days = {row.day: row["count"] for row in facts.groupBy(F.col("timestamp").cast("date").cast("string").alias("day")).count().collect()}
    for report_ts in DAILY[-7:]:
        run_id, n = windows.run_id_of(report_ts), days.get(report_ts[:10], 0)
        if n % 3:
            torso = "" if n % 3 == 1 else '{"run_id": "' + run_id
            put_once(spark, f"{root}/registry/month={run_id[:6]}/{run_id}.json", torso)
    backfill.backfill_reports(spark, facts, root, DAILY[-7:], GENERATED_AT)
    first = history.committed_runs(spark, root)
    again = first.first().asDict() | {"attempt": "a-second"}
    refused = history.commit_all(spark, root, [again])
    runs = history.committed_runs(spark, root)
    return runs.select(
        "run_id", "status", F.col("metrics")["failures_last_24h"].alias("failures_last_24h"),
        (F.col("attempt") == "a-second").alias("second"), F.lit(len(refused)).alias("refused"),
    )


def _faulty(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Column]:
    """The daily runs, their documents, and each run's failures of 24 hours, by which faults are chosen."""
    root = _daily_root(spark, sf_dir)
    runs = history.committed_runs(spark, root).withColumn("chosen", F.col("metrics")["failures_last_24h"])
    stored = history.documents_of_runs(spark, root, runs)
    return runs, stored.join(runs.select("run_id", "chosen"), "run_id"), F.col("chosen")


def missing_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of which, by their number of failures, a document is not listed, another not stored, and a page lost."""
    runs, stored, n = _faulty(spark, sf_dir)
    names = F.array(*map(F.lit, fixed.PAYLOAD_ARTIFACTS))
    unlisted = F.get(names, (n % 7).cast("int"))
    lost = F.col("artifact").eqNullSafe(F.get(names, (n % 5).cast("int")))
    lost_page = (n % 3 == 0) & (F.col("artifact") == fixed.EXCEPTIONS) & (F.col("page") == 1)
    listed = F.when(unlisted.isNull(), F.col("artifacts")).otherwise(F.array_except("artifacts", F.array(unlisted)))
    return history.missing_artifacts(runs.withColumn("artifacts", listed), stored.where(~lost & ~lost_page))


def stored_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of which, by their number of failures, a text is altered, a page lost, a digest lost, or the whole does not add up."""
    runs, stored, n = _faulty(spark, sf_dir)
    altered = (n % 4 == 0) & (F.col("artifact") == fixed.TREND_30D)
    lost = (n % 5 == 0) & (F.col("artifact") == fixed.EXCEPTIONS) & (F.col("page") == 0)
    digests = F.map_filter("digests", lambda page, _: (n % 3 != 0) | (page != f"{fixed.MANIFEST}#0"))
    digest = F.when(n % 2 == 0, F.lit("other")).otherwise(history.combined_digest(digests))
    texts = stored.withColumn("value", F.when(altered, F.concat("value", F.lit(" "))).otherwise(F.col("value")))
    return history.altered_pages(
        runs.withColumns({"digests": digests, "digest": digest}), texts.where(~lost)
    )


def run_metrics_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run's write itself observed of the documents it stored."""
    root = scratch_path(spark, "observed")
    publish.publish_run(spark, EVENTS.facts(spark, sf_dir), root, EVENTS.report_ts, GENERATED_AT)
    runs = history.committed_runs(spark, root)
    return runs.select("run_id", F.explode("metrics").alias("metric", "n"))


def client_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of the documents of all clients, those without a segment included, from one pass over the orders."""
    root = scratch_path(spark, "client-documents")
    facts = materialise(client_orders(spark, sf_dir), "client-orders")
    batch = publish.publish_clients(spark, facts, root, ORDERS.report_ts, GENERATED_AT)
    assert not batch.broken and not batch.refused
    found = []
    for row in facts.select("client").distinct().collect():
        stored = history.open_current(spark, publish.client_root(root, row.client))
        found.append(stored_items(stored).select(F.lit(row.client).cast("string").alias("client"), "*"))
    return reduce(DataFrame.unionAll, found)


def top_sites_by_client_k5000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More sites of each client than a window would be limited to in a task; ranked by ranges instead."""
    facts = client_orders(spark, sf_dir)
    with session_zone(spark, "UTC"):
        counts = facts.groupBy("client", "site").agg(F.count("*").alias("failures"))
    return scoped.top_by(counts, ["client"], "failures", "site", LARGE_K)


def rollup_from_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup out of stored hourly counts: those of most events, then refreshed for the hours of the late ones."""
    path = scratch_path(spark, "partials")
    facts = EVENTS.facts(spark, sf_dir)
    is_late = F.col("document_id").cast("bigint") % 50 == 7
    partials.write_partials(facts.where(~is_late), path)
    partials.refresh_partials(facts, path, facts.where(is_late))
    rolled = materialise(partials.rollup_from_partials(facts, path, EVENTS.report_ts), "from-partials")
    return rollup.by_each_key(rolled).withColumn("date", F.col("date").cast("string"))


def _indexed(spark: SparkSession, sf_dir: str) -> str:
    def make(path: str) -> None:
        fact_source.write_facts(EVENTS.facts(spark, sf_dir), path)
        fact_source.index_facts(spark, path)

    return _once(spark, sf_dir, "indexed-facts", make)


def fact_scan_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a week, of the files whose times the index does not place outside it."""
    anchor = windows.instant(EVENTS.report_ts)
    with session_zone(spark, "UTC"):
        first = anchor - windows.LAST_7D.interval
        facts = fact_source.read_facts_between(spark, _indexed(spark, sf_dir), first, anchor)
        found = facts.where(windows.in_window(F.col("timestamp"), anchor, windows.LAST_7D))
        return found.select("document_id", "site", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


def metric_moved_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric of stored events of which every third is moved by twenty days after the scan, out of its stored day."""
    with session_zone(spark, "UTC"):
        facts = fact_source.read_facts(spark, _indexed(spark, sf_dir))
        moved = F.when(F.col("document_id").cast("bigint") % 3 == 0, F.col("timestamp") + F.expr("INTERVAL 480 HOURS"))
        facts = facts.withColumn("timestamp", F.coalesce(moved, F.col("timestamp")))
        return catalog.metric("failures_last_7d", facts, EVENTS.report_ts)


#: A report whose window holds the end of summer time in New York.
ZONED_TS = "1998-11-10T12:00:00Z"
ZONES = ("America/New_York", "Asia/Kolkata", "UTC")


def trend_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series of the line items in three zones, each shipped at an hour that its order number tells."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    with session_zone(spark, "UTC"):
        hours = F.make_interval(hours=(F.col("l_orderkey") % 24).cast("int"))
        facts = items.select(
            F.concat(F.lit("site_"), F.col("l_suppkey")).alias("site"),
            (F.col("l_shipdate").cast("timestamp") + hours).alias("timestamp"),
            F.col("l_returnflag").alias("failure_type"),
        )
    found = zoned.trend_by_zone(facts, ZONED_TS, ZONES)
    return found.withColumn("date", F.col("date").cast("string"))


def run_queries() -> dict[str, Query]:
    found = (
        backfill_prefix_sums, backfill_documents, latest_run_compacted, commit_recovery, missing_artifacts, stored_digests,
        run_metrics_observed, client_documents, top_sites_by_client_k5000, rollup_from_partials, fact_scan_indexed,
        metric_moved_timestamp, trend_by_zone,
    )
    return {query.__name__: query for query in found}
