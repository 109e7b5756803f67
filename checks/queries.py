"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.bindings import EVENTS, LINEITEM, ORDERS, Binding, client_orders, clients
from checks.run_queries import run_queries, stored_items
from trailmetrics import fixed_values as fixed
from trailmetrics.functions import windows
from trailmetrics.operators import catalog, contracts, documents, rollup, scoped, windowed
from trailmetrics.plans import backfill, history, publish
from trailmetrics.session import materialise, scratch_path, session_zone
from trailmetrics.sources import facts as fact_source
from trailmetrics.sources.synthetic import synthetic_failures

Query = Callable[[SparkSession, str], DataFrame]

GENERATED_AT = "2024-01-30T12:00:05+00:00"
EARLIER_TS = "2024-01-29T12:00:00Z"
PAGED = 100
WINDOWS = {"24h": windows.LAST_24H, "7d": windows.LAST_7D, "30d": windows.LAST_30D}


def _plain(df: DataFrame) -> DataFrame:
    """Dates as ISO strings and instants without a zone, as reports and the oracle show them."""
    shown = {T.DateType(): "string", T.TimestampType(): "timestamp_ntz"}
    with session_zone(df.sparkSession, "UTC"):
        return df.select(
            *[
                F.col(f.name).cast(shown.get(f.dataType, f.dataType)).alias(f.name)
                for f in df.schema
            ]
        )


# Queries on one binding.


def fact_scan(facts: DataFrame, binding: Binding) -> DataFrame:
    return fact_source.check_fact_schema(facts)


def window_filter(facts: DataFrame, binding: Binding, name: str) -> DataFrame:
    return fact_source.facts_in_window(facts, binding.report_ts, WINDOWS[name])


def day_bucket(facts: DataFrame, binding: Binding) -> DataFrame:
    return facts.select("document_id", windows.day_bucket(F.col("timestamp")).alias("date"))


def named_metric(facts: DataFrame, binding: Binding, name: str) -> DataFrame:
    return catalog.metric(name, facts, binding.report_ts)


def site_counts(facts: DataFrame, binding: Binding, name: str) -> DataFrame:
    return windowed.counts_by(facts, "site", binding.report_ts, WINDOWS[name])


def daily_counts(facts: DataFrame, binding: Binding) -> DataFrame:
    return windowed.daily_counts(facts, binding.report_ts, windows.LAST_30D)


def date_spine(facts: DataFrame, binding: Binding) -> DataFrame:
    """The 30 days up to the last failure of each site."""
    last = facts.groupBy("site").agg(F.max("timestamp").alias("last"))
    return windowed.date_spine(last, F.col("last")).select("site", "date")


def fused_rollup(facts: DataFrame, binding: Binding) -> DataFrame:
    return rollup.by_each_key(materialise(rollup.rollup(facts, binding.report_ts), "rollup"))


ON_A_BINDING: dict[str, Callable[[DataFrame, Binding], DataFrame]] = {
    "fact_scan": fact_scan,
    "day_bucket": day_bucket,
    "daily_counts_30d": daily_counts,
    "date_spine_30d": date_spine,
    "fused_rollup": fused_rollup,
    **{f"window_filter_{name}": partial(window_filter, name=name) for name in WINDOWS},
    **{f"site_counts_{name}": partial(site_counts, name=name) for name in ("7d", "30d")},
    **{name: partial(named_metric, name=name) for name in fixed.REQUIRED_METRICS},
}


def _bound(query: Callable[[DataFrame, Binding], DataFrame], binding: Binding) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with session_zone(spark, "UTC"):
            return _plain(query(binding.facts(spark, sf_dir), binding))

    return run


# Queries on the events.


def fact_write_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "facts")
    fact_source.write_facts(EVENTS.facts(spark, sf_dir), path)
    return _plain(fact_source.read_facts(spark, path))


def fact_write_client_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with a client, some of them unknown, stored by day and read back whole."""
    path = scratch_path(spark, "client-facts")
    fact_source.write_facts(client_orders(spark, sf_dir), path)
    return _plain(fact_source.read_facts(spark, path))


def metric_foreign_event_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric of facts whose ``event_date`` is the day they were loaded, long after they happened."""
    loaded = EVENTS.facts(spark, sf_dir).withColumn(
        fact_source.EVENT_DATE, F.date_add(windows.utc_day(F.col("timestamp")), 400)
    )
    path = scratch_path(spark, "foreign-days")
    fact_source.write_facts(loaded, path, day="stored_day")
    return catalog.metric("failures_last_7d", fact_source.read_facts(spark, path), EVENTS.report_ts)


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic failure for each event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _plain(synthetic_failures(events.select(F.col("event_id").alias("id"))))


def run_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run a report at the second of each event would be."""
    with session_zone(spark, "UTC"):
        second = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return EVENTS.facts(spark, sf_dir).select(
            "document_id", windows.run_id(second).alias("run_id")
        )


def _event_documents(
    spark: SparkSession, sf_dir: str, report_ts: str = EVENTS.report_ts
) -> dict[str, DataFrame]:
    rolled = materialise(rollup.rollup(EVENTS.facts(spark, sf_dir), report_ts), "rollup")
    return documents.payload_documents(
        rollup.metrics_of(rolled, report_ts, ordered=False), report_ts, GENERATED_AT
    )


def payload(spark: SparkSession, sf_dir: str, artifact: str) -> DataFrame:
    document = _event_documents(spark, sf_dir)[artifact]
    return documents.items(document, artifact).drop(documents.PAGE)


def payload_exceptions_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exceptions document of facts with a type of their own each, in pages of 100."""
    facts = EVENTS.facts(spark, sf_dir).withColumn("failure_type", F.col("document_id"))
    types = catalog.metric("exceptions_7d", facts, EVENTS.report_ts)
    meta = documents.stamps(EVENTS.report_ts, GENERATED_AT)
    document = documents.exceptions(types, meta, fixed.EXCEPTIONS_WINDOW_DAYS, page_items=PAGED)
    items = documents.items(document, fixed.EXCEPTIONS)
    return items.select(
        "page", (F.col("page") * PAGED + F.col("position")).alias("position"), "failure_type", "count"
    )


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's status; the later one counts failures without a site, which its contract refuses."""
    root = scratch_path(spark, "statuses")
    facts = EVENTS.facts(spark, sf_dir)
    publish.publish_run(spark, facts, root, EARLIER_TS, GENERATED_AT)
    nameless = facts.withColumn("site", F.lit(None).cast("string"))
    try:
        publish.publish_run(spark, nameless, root, EVENTS.report_ts, GENERATED_AT)
    except contracts.ContractViolation:
        pass
    runs = history.run_status(history.all_attempts(spark, root))
    return runs.select("run_id", "status", F.col("metrics")["failures_last_7d"].alias("failures_last_7d"))


def _stored_items(stored: DataFrame) -> DataFrame:
    """``(run_id, artifact, position, item, n)`` of all stored payload documents."""
    return stored_items(stored, "run_id")


def payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four documents written as JSON, read back and flattened."""
    root = scratch_path(spark, "documents")
    texts = [documents.as_json(d, a) for a, d in _event_documents(spark, sf_dir).items()]
    history.store_documents(reduce(DataFrame.unionAll, texts), root, "r", "a")
    return _stored_items(history.stored_documents(spark, root)).drop("run_id")


def contract(spark: SparkSession, sf_dir: str, artifact: str) -> DataFrame:
    return contracts.document_violations(_event_documents(spark, sf_dir)[artifact], artifact)


_published: dict[tuple[str, str], str] = {}


def _published_root(spark: SparkSession, sf_dir: str) -> str:
    """Two runs over the events, and a document of a third that was never committed."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _published:
        root = scratch_path(spark, "history")
        facts = EVENTS.facts(spark, sf_dir)
        for report_ts in (EARLIER_TS, EVENTS.report_ts):
            publish.publish_run(spark, facts, root, report_ts, GENERATED_AT)
        unfinished = _event_documents(spark, sf_dir, "2024-01-30T18:00:00Z")[fixed.SUMMARY]
        history.store_documents(
            documents.as_json(unfinished, fixed.SUMMARY), root, "20240130T180000Z", "a-unfinished"
        )
        _published[key] = root
    return _published[key]


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Registry and documents; the registry is opened first."""
    root = _published_root(spark, sf_dir)
    runs = history.committed_runs(spark, root)
    return runs, history.committed_documents(runs, history.stored_documents(spark, root))


def contract_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stored = _history(spark, sf_dir)
    manifests = documents.from_json(stored.select("artifact", "value"), fixed.MANIFEST)
    return contracts.document_violations(manifests, fixed.MANIFEST)


def contract_run_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.run_consistency(_history(spark, sf_dir)[1])


def contract_stored_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stored = _history(spark, sf_dir)
    return reduce(
        DataFrame.unionAll,
        [
            contracts.stored_json_violations(stored, artifact).select(
                F.lit(artifact).alias("artifact"), "rule", "violations"
            )
            for artifact in fixed.ALL_ARTIFACTS
        ],
    )


def contract_event_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each event, of which some lack a stamp, a status or an artifact."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    manifests = events.select(
        F.expr("CASE WHEN event_id % 7 = 0 THEN array('a', NULL) WHEN event_id % 11 <> 0 THEN array('a') END").alias("artifacts"),
        F.when(F.col("user_id") % 5 != 0, F.lit(GENERATED_AT)).alias("generated_at"),
        F.lit(EVENTS.report_ts).alias("report_ts"),
        F.concat(F.lit("r"), F.col("event_id")).alias("run_id"),
        F.lit(fixed.SCHEMA_VERSION).alias("schema_version"),
        F.when(F.col("event_type") == "error", fixed.STATUS_ERROR)
        .when(F.col("event_type") == "click", "CLICKED")
        .otherwise(fixed.STATUS_SUCCESS)
        .alias("status"),
    )
    return contracts.document_violations(manifests, fixed.MANIFEST)


def contract_event_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each user with a document for each event, stamped differently by some."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stamped = F.struct(
        F.when(F.col("user_id") % 3 == 0, F.col("event_type")).otherwise("t").alias("report_ts"),
        F.when(F.col("user_id") % 4 == 0, F.col("event_id").cast("string")).otherwise("g").alias("generated_at"),
    )
    documents_ = events.select(F.col("user_id").alias("run_id"), F.to_json(stamped).alias("value"))
    return contracts.run_consistency(documents_)


def contract_event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary for each event as text: some broken, some with a wrong key, number or item."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    number = F.when(F.col("event_type") == "click", F.lit('"5"')).otherwise(F.lit("5"))
    key = F.when(F.col("event_type") == "view", F.lit("extra")).otherwise(F.lit("schema_version"))
    site = F.when(F.col("event_type") == "signup", F.lit("7")).otherwise(F.lit('"s"'))
    whole = F.concat(
        F.lit('{"failures_last_24h":'), number, F.lit(',"failures_last_7d":9,"generated_at":"g","report_ts":"r","'), key,
        F.lit('":"1","top_sites":[{"failures":1,"site":'), site, F.lit("}]}"),
    )
    text = F.when(F.col("event_type") == "error", F.substring(whole, 1, 40)).otherwise(whole)
    stored = events.select(F.lit(fixed.SUMMARY).alias("artifact"), text.alias("value"))
    return contracts.stored_json_violations(stored, fixed.SUMMARY)


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_items(_history(spark, sf_dir)[1])


def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stored = _history(spark, sf_dir)
    manifests = documents.from_json(stored.select("artifact", "value"), fixed.MANIFEST)
    return documents.items(manifests, fixed.MANIFEST)


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, _ = _history(spark, sf_dir)
    return history.latest_run(runs).select(
        "run_id",
        "report_ts",
        "generated_at",
        "schema_version",
        "status",
        *[F.col("metrics")[n].alias(n) for n in ("failures_last_24h", "failures_last_7d")],
    )


def current_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _published_root(spark, sf_dir)
    return _stored_items(history.open_current(spark, root))


def run_metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, _ = _history(spark, sf_dir)
    return runs.select("run_id", F.explode("metrics").alias("metric", "n"))


def by_client(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One metric for every market segment that has orders."""
    facts = client_orders(spark, sf_dir)
    rolled = materialise(
        rollup.rollup(facts, ORDERS.report_ts, scope=["client"], shared_scan=True), "clients"
    )
    metrics = scoped.metrics_by(
        rolled, ["client"], clients(spark, sf_dir).select("client").distinct(), windows.instant(ORDERS.report_ts)
    )
    return _plain(metrics[name])


# Daily reports, one an hour after another, and one that shares no window edge with the rest.
BACKFILL = tuple(f"2024-01-{day}T12:00:00Z" for day in range(20, 31)) + (
    "2024-01-30T13:00:00Z",
    "2024-01-05T07:31:17Z",
)


def _backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backfill.backfill_rollup(EVENTS.facts(spark, sf_dir), BACKFILL)


def backfill_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of every report instant from one pass over the events."""
    return _plain(_backfilled(spark, sf_dir))


def top_sites_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = materialise(_backfilled(spark, sf_dir), "backfill")
    runs = backfill.instants(spark, BACKFILL)
    metrics = scoped.metrics_by(
        rolled, ["report_ts"], runs, F.col("report_ts").cast("timestamp")
    )
    return metrics["top_sites_by_failures"]


def all_queries() -> dict[str, Query]:
    bound = {
        f"{name}{suffix}": _bound(query, binding)
        for suffix, binding in (("", EVENTS), ("_orders", ORDERS), ("_lineitem", LINEITEM))
        for name, query in ON_A_BINDING.items()
    }
    return bound | {
        "fact_write_roundtrip": fact_write_roundtrip,
        "fact_write_client_roundtrip": fact_write_client_roundtrip,
        "metric_foreign_event_date": metric_foreign_event_date,
        "synthetic_failures": synthetic,
        "run_id": run_id,
        "payload_summary": partial(payload, artifact=fixed.SUMMARY),
        "payload_trend_30d": partial(payload, artifact=fixed.TREND_30D),
        "payload_top_sites": partial(payload, artifact=fixed.TOP_SITES),
        "payload_exceptions": partial(payload, artifact=fixed.EXCEPTIONS),
        "payload_exceptions_paged": payload_exceptions_paged,
        "payload_roundtrip": payload_roundtrip,
        "run_status": run_status,
        "contract_event_manifests": contract_event_manifests,
        "contract_event_consistency": contract_event_consistency,
        "contract_event_json": contract_event_json,
        "contract_summary": partial(contract, artifact=fixed.SUMMARY),
        "contract_trend_30d": partial(contract, artifact=fixed.TREND_30D),
        "contract_top_sites": partial(contract, artifact=fixed.TOP_SITES),
        "contract_exceptions": partial(contract, artifact=fixed.EXCEPTIONS),
        "contract_manifest": contract_manifest,
        "contract_run_consistency": contract_run_consistency,
        "contract_stored_json": contract_stored_json,
        "run_history": run_history,
        "run_manifest": run_manifest,
        "latest_run": latest_run,
        "current_payloads": current_payloads,
        "run_metrics_log": run_metrics_log,
        "failures_by_client": partial(by_client, name="failures_last_7d"),
        "top_sites_by_client": partial(by_client, name="top_sites_30d"),
        "exceptions_by_client": partial(by_client, name="exceptions_7d"),
        "trend_by_client": partial(by_client, name="trend_30d"),
        "backfill_runs": backfill_runs,
        "top_sites_by_run": top_sites_by_run,
    } | run_queries()
