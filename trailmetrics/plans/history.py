"""Run history: stored documents, the registry that commits them, and gated reading.

Layout below one root::

    documents/run_id=…/attempt=…/artifact=…/page=…/   one line of JSON each
    registry/month=…/<run id>.json                     a committed run, created once and never replaced
    registry/month=…/<run id>.<attempt>.failed.json    an attempt that broke a contract
    registry/month=…/snapshot.<number>.jsonl           all of that month so far, a line for each object

A run exists once its registry object does. That appears whole under the run's name, in one step, on the condition that
there is none yet (see ``sources.objects``), so of attempts that race the first wins whatever their clocks say. An object of that name
that holds no whole row, as a store without such a step may keep of a lost writer, commits nothing and blocks nothing: the
run takes the next of its names, ``<run id>.1.json`` and so on. Documents of an attempt that never got there stay
invisible: nothing is overwritten under a reader and a restart simply tries again. Reading writes nothing.

The registry is a log. To publish a run opens no object but its own. After every ``COMPACT_AFTER`` of them a month's
objects are copied to its next snapshot, and readers open the newest one and the objects it does not name yet.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmetrics import fixed_values as fixed
from trailmetrics.operators.contracts import broken_texts, run_consistency
from trailmetrics.sources.objects import exists, names_in, put_once, read_text

COMPACT_AFTER = 16
PARTITIONS = ("run_id", "attempt", "artifact", "page")

STORED_SCHEMA = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("attempt", T.StringType()),
        T.StructField("artifact", T.StringType()),
        T.StructField("page", T.IntegerType()),
    ]
)
REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("report_ts", T.StringType()),
        T.StructField("generated_at", T.StringType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("artifacts", T.ArrayType(T.StringType())),
        T.StructField("attempt", T.StringType()),
        T.StructField("committed_at", T.TimestampType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.LongType())),
        T.StructField("pages", T.MapType(T.StringType(), T.LongType())),
        T.StructField("digests", T.MapType(T.StringType(), T.StringType())),
        T.StructField("digest", T.StringType()),
        T.StructField("base", T.StringType()),
        T.StructField("failed", T.BooleanType()),
    ]
)


class RunNotReadable(RuntimeError):
    """No committed run, or the newest one is incomplete."""


class RunAlreadyPublished(RuntimeError):
    """Committed runs are immutable."""


def store_documents(documents: DataFrame, root: str, run_id: str, attempt: str) -> None:
    """Write ``(artifact, page, value)`` rows below the run; readers do not see them yet."""
    (
        documents.withColumns({"run_id": F.lit(run_id), "attempt": F.lit(attempt)})
        .select("value", *PARTITIONS)
        .write.mode("append")
        .partitionBy(*PARTITIONS)
        .text(f"{root}/documents")
    )


def store_reports(documents: DataFrame, base: str, attempt: str) -> None:
    """Write ``(report, run_id, artifact, page, value)`` rows of many reports, each below a folder of its own; readers do not see them yet."""
    (
        documents.withColumn("attempt", F.lit(attempt))
        .select("value", "report", *PARTITIONS)
        .write.mode("append")
        .partitionBy("report", *PARTITIONS)
        .text(base)
    )


def page_name(artifact: Column, page: Column) -> Column:
    """The name of a stored page in a run's digests."""
    return F.concat_ws("#", artifact, page.cast("string"))


def combined(digests: Mapping[str, str]) -> str:
    """One digest of the digests of all pages, whatever their order."""
    text = ",".join(f"{page}={digest}" for page, digest in sorted(digests.items()))
    return hashlib.sha256(text.encode()).hexdigest()


def combined_digest(digests: Column) -> Column:
    """``combined`` of a map column."""
    pages = F.transform(F.array_sort(F.map_entries(digests)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.sha2(F.array_join(pages, ","), 256)


def _month(root: str, run_id: str) -> str:
    return f"{root}/registry/month={run_id[:6]}"


def _places(root: str, run_id: str) -> Iterator[str]:
    """The names a run's registry object may have, in the order in which they are taken."""
    yield f"{_month(root, run_id)}/{run_id}.json"
    for further in itertools.count(1):
        yield f"{_month(root, run_id)}/{run_id}.{further}.json"


def _row(text: str) -> dict[str, Any] | None:
    """A whole registry row, or None."""
    try:
        row = json.loads(text)
    except ValueError:
        return None
    return row if isinstance(row, dict) and row.get("run_id") and row.get("attempt") else None


def _text(entry: Mapping[str, Any]) -> str:
    stamped = {"committed_at": datetime.now(timezone.utc)} | dict(entry)
    return json.dumps(stamped, default=datetime.isoformat, ensure_ascii=False)


def is_committed(spark: SparkSession, root: str, run_id: str) -> bool:
    """Whether a run is; opens objects of its own name only."""
    for place in _places(root, run_id):
        if not exists(spark, place):
            return False
        if _row(read_text(spark, place)):
            return True
    raise AssertionError("names never end")


def _commit(spark: SparkSession, root: str, entry: Mapping[str, Any]) -> bool:
    text = _text(entry)
    for place in _places(root, entry["run_id"]):
        if put_once(spark, place, text):
            return True
        if _row(read_text(spark, place)):
            return False
    raise AssertionError("names never end")


def commit(spark: SparkSession, root: str, entry: Mapping[str, Any]) -> None:
    """Create the registry object that makes a run visible; the last write of a run.

    ``entry`` is a registry row. RunAlreadyPublished if another attempt was first.
    """
    if commit_all(spark, root, [entry]):
        raise RunAlreadyPublished(f"{entry['run_id']} is committed below {root}")


def commit_all(spark: SparkSession, root: str, entries: Sequence[Mapping[str, Any]]) -> list[str]:
    """Commit many runs, without a Spark job; the ids of those that another attempt had committed before."""
    refused = [entry["run_id"] for entry in entries if not _commit(spark, root, entry)]
    for month in sorted({_month(root, entry["run_id"]) for entry in entries}):
        compact(spark, month)
    return refused


def record_failure(spark: SparkSession, root: str, entry: Mapping[str, Any]) -> None:
    """Note an attempt that came to nothing, so that readers learn of it; it blocks no later one."""
    put_once(spark, f"{_month(root, entry['run_id'])}/{entry['run_id']}.{entry['attempt']}.failed.json", _text(entry))


def _months(spark: SparkSession, root: str) -> list[str]:
    """Paths of the registry's months, the newest first; the driver lists a folder per month."""
    names = names_in(spark, f"{root}/registry")
    return [f"{root}/registry/{name}" for name in reversed(names) if name.startswith("month=")]


def _lines(spark: SparkSession, snapshot: str) -> dict[str, str]:
    """The lines of a snapshot by the object they stand for."""
    found = read_text(spark, snapshot).splitlines()
    return {json.loads(line)["object"]: line for line in found}


def _objects(spark: SparkSession, month: str) -> tuple[list[str], dict[str, str], list[str]]:
    """The month's snapshots, the lines of the newest, and the names it does not have yet."""
    names = names_in(spark, month)
    snapshots = [name for name in names if name.startswith("snapshot.")]
    lines = _lines(spark, f"{month}/{snapshots[-1]}") if snapshots else {}
    return snapshots, lines, [name for name in names if name not in lines and name not in snapshots]


def compact(spark: SparkSession, month: str, after: int | None = None) -> bool:
    """Copy a month's objects to its next snapshot once ``after`` of them are in none; whether that was done.

    Of two that compact at once, one does. Snapshots of before stay for those who read them.
    """
    snapshots, lines, tail = _objects(spark, month)
    if len(tail) < (COMPACT_AFTER if after is None else after):
        return False
    for name in tail:
        row = _row(read_text(spark, f"{month}/{name}")) or {}
        lines[name] = json.dumps({"object": name} | row, ensure_ascii=False)
    text = "".join(f"{line}\n" for _, line in sorted(lines.items()))
    return put_once(spark, f"{month}/snapshot.{len(snapshots) + 1:08d}.jsonl", text)


def _registry(spark: SparkSession, months: list[str]) -> DataFrame:
    """Rows of some months, out of their newest snapshots and the objects after; an object without a whole row counts as none."""
    paths: list[str] = []
    for month in months:
        snapshots, _, tail = _objects(spark, month)
        paths += [f"{month}/{name}" for name in (*snapshots[-1:], *tail)]
    if not paths:
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    rows = spark.read.schema(REGISTRY_SCHEMA).json(paths)
    return rows.where(F.col("run_id").isNotNull() & F.col("attempt").isNotNull())


def all_attempts(spark: SparkSession, root: str) -> DataFrame:
    """Registry rows of committed runs and of attempts that failed."""
    return _registry(spark, _months(spark, root))


def committed_runs(spark: SparkSession, root: str) -> DataFrame:
    """Registry rows of the committed runs, one each."""
    return all_attempts(spark, root).where(~F.col("failed"))


def run_status(attempts: DataFrame) -> DataFrame:
    """One row per run: its committed row, or the last failed attempt if there is none."""
    last = F.max_by(F.struct("*"), F.struct(~F.col("failed"), "committed_at", "attempt"))
    return attempts.groupBy("run_id").agg(last.alias("run")).select("run.*")


def stored_documents(spark: SparkSession, root: str) -> DataFrame:
    """All stored documents, committed or not; a filter on run_id prunes folders.

    Open the registry first: a run committed by then has all its documents listed here.
    """
    return spark.read.schema(STORED_SCHEMA).text(f"{root}/documents")


def documents_of(spark: SparkSession, root: str, run_id: str, attempt: str, base: str | None = None) -> DataFrame:
    """The documents of one attempt, below ``base`` if the run was stored with others; only its own folder is listed."""
    base = base or f"{root}/documents"
    path = f"{base}/run_id={run_id}/attempt={attempt}"
    if not exists(spark, path):
        return spark.createDataFrame([], STORED_SCHEMA)
    return spark.read.option("basePath", base).schema(STORED_SCHEMA).text(path)


def documents_of_runs(spark: SparkSession, root: str, runs: DataFrame) -> DataFrame:
    """The documents of committed runs, wherever they were stored; the driver sees the folders of those runs, not the others."""
    folders: dict[str, list[str]] = {}
    for row in runs.select("run_id", "attempt", "base").collect():
        base, report = row.base.rsplit("/", 1) if row.base else (f"{root}/documents", None)
        path = "/".join(filter(None, [base, report, f"run_id={row.run_id}", f"attempt={row.attempt}"]))
        if exists(spark, path):
            folders.setdefault(base, []).append(path)
    schema = T.StructType([*STORED_SCHEMA.fields, T.StructField("report", T.IntegerType())])
    found = [
        spark.read.option("basePath", base)
        .schema(STORED_SCHEMA if base == f"{root}/documents" else schema)
        .text(paths)
        .select(*STORED_SCHEMA.names)
        for base, paths in folders.items()
    ]
    return reduce(DataFrame.unionAll, found, spark.createDataFrame([], STORED_SCHEMA))


def committed_documents(runs: DataFrame, documents: DataFrame) -> DataFrame:
    return documents.join(runs.select("run_id", "attempt"), ["run_id", "attempt"], "left_semi")


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest successful run: one row, or none. Run ids sort by time."""
    return (
        runs.where(F.col("status") == fixed.STATUS_SUCCESS)
        .agg(F.max_by(F.struct("*"), "run_id").alias("run"))
        .where(F.col("run").isNotNull())
        .select("run.*")
    )


def current_documents(runs: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of the newest successful run, as a view: nothing is copied.

    The broadcast side is one row; it prunes the scan to that run's folders.
    """
    newest = F.broadcast(latest_run(runs).select("run_id", "attempt"))
    return documents.join(newest, ["run_id", "attempt"], "left_semi")


def missing_artifacts(
    runs: DataFrame, documents: DataFrame, required: Sequence[str] = fixed.PAYLOAD_ARTIFACTS
) -> DataFrame:
    """``(run_id, artifact, reason)`` for required documents a run does not list, lacks, or lacks pages of."""
    keys = ["run_id", "attempt", "artifact"]
    wanted = runs.select(
        "run_id",
        "attempt",
        F.explode(F.array(*map(F.lit, required))).alias("artifact"),
        "artifacts",
        "pages",
    )
    stored = documents.groupBy(*keys).agg(F.count_distinct("page").alias("stored"))
    expected = F.coalesce(F.col("pages")[F.col("artifact")], F.lit(1))
    reason = (
        F.when(~F.coalesce(F.array_contains("artifacts", F.col("artifact")), F.lit(False)), "not listed")
        .when(F.col("stored").isNull(), "not stored")
        .when(F.col("stored") < expected, "stored in part")
    )
    found = wanted.join(stored, keys, "left").withColumn("reason", reason)
    return found.where(F.col("reason").isNotNull()).select("run_id", "artifact", "reason")


def altered_pages(runs: DataFrame, documents: DataFrame) -> DataFrame:
    """``(run_id, page, reason)`` for pages whose text is not what the run's digests say, and runs whose digests do not add up.

    Runs without digests, of before there were any, are not judged.
    """
    kept = runs.where(F.col("digests").isNotNull())
    noted = kept.select("run_id", "attempt", F.explode("digests").alias("page", "noted"))
    stored = documents.select("run_id", "attempt", page_name(F.col("artifact"), F.col("page")).alias("page"), F.sha2("value", 256).alias("found"))
    stored = stored.join(kept.select("run_id", "attempt"), ["run_id", "attempt"], "left_semi")
    reason = (
        F.when(F.col("noted").isNull(), "not noted")
        .when(F.col("found").isNull(), "missing")
        .when(F.col("noted") != F.col("found"), "altered")
    )
    both = noted.unionByName(stored, allowMissingColumns=True).groupBy("run_id", "attempt", "page")
    pages = both.agg(F.max("noted").alias("noted"), F.max("found").alias("found")).withColumn("reason", reason)
    wrong = kept.where(~F.col("digest").eqNullSafe(combined_digest(F.col("digests"))))
    return pages.where(F.col("reason").isNotNull()).select("run_id", "page", "reason").unionAll(
        wrong.select("run_id", F.lit(None).cast("string"), F.lit("digests do not add up"))
    )


def faults(runs: DataFrame, documents: DataFrame) -> DataFrame:
    """``(run_id, fault)``: everything for which the documents of runs must not be shown.

    Documents or pages that are missing or altered, stamps that differ, and texts that break their contract when read strictly.
    """
    missing = missing_artifacts(runs, documents).select("run_id", F.concat_ws(" is ", "artifact", "reason").alias("fault"))
    altered = altered_pages(runs, documents)
    altered = altered.select("run_id", F.concat_ws(" is ", F.col("page"), F.col("reason")).alias("fault"))
    broken = broken_texts(documents).select("run_id", "artifact", F.explode("rules").alias("rule"))
    broken = broken.select("run_id", F.concat_ws(": ", "artifact", "rule").alias("fault"))
    differing = run_consistency(documents, by=["run_id"]).where("violations > 0").select("run_id", F.col("rule").alias("fault"))
    return reduce(DataFrame.unionAll, [missing, altered, broken, differing])  # a fault may come once for each page


def open_current(spark: SparkSession, root: str, last_good: bool = False) -> DataFrame:
    """The current documents, or RunNotReadable when they must not be shown as current.

    The newest run has to have succeeded and be without ``faults``. ``last_good`` asks for the
    newest run that did succeed, whatever came after it.
    """
    row = None
    for month in _months(spark, root):
        runs = run_status(_registry(spark, [month]))
        if last_good:
            runs = runs.where(F.col("status") == fixed.STATUS_SUCCESS)
        row = runs.orderBy(F.desc("run_id")).limit(1).first()
        if row is not None:
            break
    if row is None:
        raise RunNotReadable(f"no run with status {fixed.STATUS_SUCCESS} below {root}")
    if row.status != fixed.STATUS_SUCCESS:
        raise RunNotReadable(f"{row.run_id}, the newest run, has status {row.status}")
    documents = documents_of(spark, root, row.run_id, row.attempt, row.base)
    run = spark.createDataFrame([row], REGISTRY_SCHEMA)
    found = sorted({fault.fault for fault in faults(run, documents).collect()})
    if found:
        raise RunNotReadable(f"{row.run_id}: " + "; ".join(found))
    return documents
