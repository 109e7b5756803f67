"""A reporting run: facts to checked, stored and committed documents. Many runs take the same jobs as one."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from typing import Any
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trailmetrics import fixed_values as fixed
from trailmetrics.functions import windows
from trailmetrics.operators import documents as docs
from trailmetrics.operators.assembly import assembled, check_assembled, texts
from trailmetrics.operators.contracts import ContractViolation, document_violations
from trailmetrics.operators.rollup import rollup
from trailmetrics.operators.scoped import documents_by, metrics_by, scope_key
from trailmetrics.plans import history
from trailmetrics.session import materialise
from trailmetrics.sources.facts import check_fact_schema

log = logging.getLogger(__name__)

_TOTALS = ("failures_last_24h", "failures_last_7d")


@dataclass(frozen=True)
class PublishedRun:
    run_id: str
    report_ts: str
    generated_at: str
    attempt: str
    metrics: dict[str, int]


@dataclass
class Batch:
    """What came of many reports: runs committed, contracts broken, and runs that another attempt had committed."""

    published: list[PublishedRun] = field(default_factory=list)
    broken: dict[str, str] = field(default_factory=dict)
    refused: list[str] = field(default_factory=list)


def utc_now() -> str:
    return datetime.now(timezone.utc).replace(microsecond=0).isoformat()


def _texts(documents: dict[str, DataFrame], *others: str) -> DataFrame:
    """All documents as lines of JSON, each page with its number of items and, of the summary, the two totals."""

    def of(artifact: str, document: DataFrame) -> DataFrame:
        totals = [
            (F.col(name) if artifact == fixed.SUMMARY else F.lit(None).cast("bigint")).alias(name) for name in _TOTALS
        ]
        items = F.array_size(docs.ITEMS[artifact]).cast("bigint").alias("items")
        return docs.as_json(document, artifact, *others, items, *totals)

    return reduce(DataFrame.unionAll, [of(artifact, document) for artifact, document in documents.items()])


def _page() -> Column:
    """What is noted of a stored page: its name, artifact, number of items and digest."""
    name = history.page_name(F.col("artifact"), F.col(docs.PAGE))
    return F.struct(name.alias("page"), "artifact", "items", F.sha2("value", 256).alias("digest"))


def _noted() -> list[Column]:
    """Aggregates over the pages of a run: bounded by the number of its pages."""
    return [F.collect_list(_page()).alias("pages"), *[F.max(name).alias(name) for name in _TOTALS]]


def _log(noted: Any) -> dict[str, Any]:
    """The metrics, pages and digests of a registry row."""
    payloads = [page for page in noted["pages"] if page["artifact"] != fixed.MANIFEST]
    metrics = {name: noted[name] for name in _TOTALS}
    pages: dict[str, int] = {}
    for page in payloads:
        artifact = page["artifact"]
        pages[artifact] = pages.get(artifact, 0) + 1
        if artifact != fixed.SUMMARY:
            name = artifact.removesuffix(".json")
            metrics[name] = metrics.get(name, 0) + page["items"]
    digests = {page["page"]: page["digest"] for page in noted["pages"]}
    return {"metrics": metrics, "pages": pages, "digests": digests, "digest": history.combined(digests)}


def publish_run(
    spark: SparkSession,
    facts: DataFrame,
    root: str,
    report_ts: str | datetime | None = None,
    generated_at: str | None = None,
    k: int = fixed.TOP_K,
    tz: str = "UTC",
    page_items: int = docs.PAGE_ITEMS,
    shared_scan: bool = False,
) -> PublishedRun:
    """Compute, check and store one run below ``root``; see ``history`` for the layout.

    One job counts all windows, in two scans of the columns each grain needs, or with ``shared_scan`` in
    one; see ``rollup``. All contracts are checked before the first document is written, and the run becomes
    visible with the very last write; if one is broken, only that is recorded. Publishing a
    committed run again is refused; a run that stopped half-way is simply published anew.
    """
    check_fact_schema(facts)
    report_ts = windows.normalise_report_ts(report_ts)
    run_id = windows.run_id_of(report_ts)
    if history.is_committed(spark, root, run_id):
        raise history.RunAlreadyPublished(f"{run_id} is committed below {root}")
    rolled = materialise(rollup(facts, report_ts, tz, shared_scan=shared_scan), "rollup")
    return publish_rollup(rolled, root, report_ts, generated_at, k, tz, page_items)


def publish_rollup(
    rolled: DataFrame,
    root: str,
    report_ts: str,
    generated_at: str | None = None,
    k: int = fixed.TOP_K,
    tz: str = "UTC",
    page_items: int = docs.PAGE_ITEMS,
) -> PublishedRun:
    """What follows the rollup of a run that is not committed yet: check, store, commit.

    The write itself observes what it stores, so that no further job counts it.
    """
    spark, run_id = rolled.sparkSession, windows.run_id_of(report_ts)
    attempt = f"a-{uuid.uuid4()}"
    generated_at = generated_at or utc_now()
    entry = {
        "run_id": run_id,
        "report_ts": report_ts,
        "generated_at": generated_at,
        "schema_version": fixed.SCHEMA_VERSION,
        "attempt": attempt,
    }
    documents = assembled(rolled, report_ts, generated_at, run_id, k, tz, page_items).persist()
    try:
        try:
            check_assembled(documents)
        except ContractViolation:
            history.record_failure(spark, root, entry | {"status": fixed.STATUS_ERROR, "failed": True})
            raise
        seen = Observation()
        history.store_documents(texts(documents).observe(seen, *_noted()), root, run_id, attempt)
        noted = _log(seen.get)
        history.commit(spark, root, entry | noted | _SUCCEEDED)
    finally:
        documents.unpersist()
    log.info("published %s generated_at=%s %s", run_id, generated_at, noted["metrics"])
    return PublishedRun(run_id, report_ts, generated_at, attempt, noted["metrics"])


_SUCCEEDED = {"status": fixed.STATUS_SUCCESS, "failed": False, "artifacts": list(fixed.PAYLOAD_ARTIFACTS)}


def publish_reports(
    rolled: DataFrame,
    scope: Sequence[str],
    reports: DataFrame,
    root_of: Callable[[Any], str],
    base: str,
    generated_at: str | None = None,
    k: int = fixed.TOP_K,
    tz: str = "UTC",
    page_items: int = docs.PAGE_ITEMS,
) -> Batch:
    """Check, store and commit many reports out of one rollup; the number of jobs does not depend on how many.

    ``reports`` has a row for each: its ``scope`` columns, by which ``rolled`` is grouped too, and ``report_ts``. A report is a run of the
    history below ``root_of(row)``. All documents go in one partitioned write below ``base``, which the registry rows
    name. Reports that break a contract are set aside: nothing of them is stored but a record of the failure, and
    the others commit. Per report the driver sees its registry row, and creates one object for it.
    """
    spark, attempt = rolled.sparkSession, f"a-{uuid.uuid4()}"
    generated_at = generated_at or utc_now()
    wanted = {}
    for row in reports.withColumn("scope", scope_key(scope)).collect():
        run_id, root = windows.run_id_of(row.report_ts), root_of(row)
        entry = {
            "run_id": run_id,
            "report_ts": row.report_ts,
            "generated_at": generated_at,
            "schema_version": fixed.SCHEMA_VERSION,
            "attempt": attempt,
            "base": f"{base}/report={len(wanted)}",
        }
        if not history.is_committed(spark, root, run_id):
            wanted[row.scope] = (root, entry)
    batch = Batch()
    if not wanted:
        return batch
    listed = [(key, entry["report_ts"], entry["run_id"], i) for i, (key, (_, entry)) in enumerate(wanted.items())]
    stamps = spark.createDataFrame(listed, "scope string, report_ts string, run_id string, report int")
    kept = reports.select(*dict.fromkeys([*scope, "report_ts"])).withColumn("key", scope_key(scope))
    kept = kept.join(stamps.select(F.col("scope").alias("key")), "key", "left_semi").drop("key")
    anchor = F.col("report_ts").cast("timestamp")
    metrics = metrics_by(rolled, scope, kept, anchor, k, tz)
    documents = documents_by(metrics, scope, stamps.drop("report"), generated_at, page_items)
    documents = {artifact: document.persist() for artifact, document in documents.items()}
    try:
        checks = [
            document_violations(document, artifact, ["scope"]).withColumn("artifact", F.lit(artifact))
            for artifact, document in documents.items()
        ]
        for row in sorted(reduce(DataFrame.unionAll, checks).where("violations > 0").collect()):
            said = f"{row.artifact}: {row.rule} ({row.violations})"
            batch.broken[row.scope] = "; ".join(filter(None, [batch.broken.get(row.scope), said]))
        stored = _texts(documents, "scope").join(stamps.drop("report_ts"), "scope")
        if batch.broken:
            bad = spark.createDataFrame([(key,) for key in batch.broken], "scope string")
            stored = stored.join(bad, "scope", "left_anti")
        history.store_reports(stored, base, attempt)
        noted = {row.scope: _log(row) for row in stored.groupBy("scope").agg(*_noted()).collect()}
    finally:
        for document in documents.values():
            document.unpersist()
    by_root: dict[str, list[dict[str, Any]]] = {}
    for key, (root, entry) in wanted.items():
        if key in batch.broken:
            history.record_failure(spark, root, entry | {"status": fixed.STATUS_ERROR, "failed": True, "base": None})
        else:
            by_root.setdefault(root, []).append(entry | noted[key] | _SUCCEEDED)
    for root, entries in by_root.items():
        refused = set(history.commit_all(spark, root, entries))
        batch.refused += sorted(refused)
        batch.published += [
            PublishedRun(e["run_id"], e["report_ts"], generated_at, attempt, e["metrics"])
            for e in entries
            if e["run_id"] not in refused
        ]
    batch.published.sort(key=lambda run: run.run_id)
    log.info("published %d reports, %d broken", len(batch.published), len(batch.broken))
    return batch


def client_root(root: str, client: str | None) -> str:
    """The history of one client below ``root``; facts without a client have one of their own."""
    if client is None:
        return f"{root}/no-client"
    return f"{root}/client={quote(client, safe='').replace('.', '%2E')}"


def publish_clients(
    spark: SparkSession,
    facts: DataFrame,
    root: str,
    report_ts: str | datetime | None = None,
    generated_at: str | None = None,
    k: int = fixed.TOP_K,
    tz: str = "UTC",
    page_items: int = docs.PAGE_ITEMS,
) -> Batch:
    """A run for each ``client`` of the facts, those without one included, from one pass over them.

    Each has its own history, at ``client_root``; a client whose documents break a contract does not keep the others.
    """
    check_fact_schema(facts)
    report_ts = windows.normalise_report_ts(report_ts)
    rolled = materialise(rollup(facts, report_ts, tz, scope=["client"], shared_scan=True), "clients")
    clients = materialise(facts.select("client").distinct(), "client-names").withColumn("report_ts", F.lit(report_ts))
    base = f"{root}/batches/{windows.run_id_of(report_ts)}-{uuid.uuid4().hex}"
    return publish_reports(
        rolled, ["client"], clients, lambda row: client_root(root, row.client), base, generated_at, k, tz, page_items
    )
