"""The failure fact table: shape, scan, pruning by day or by an index of its files, and partitioned write."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmetrics.functions.windows import Trailing, in_window, instant, utc_day
from trailmetrics.sources.objects import exists

FACT_SCHEMA = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("failure_type", T.StringType()),
        T.StructField("document_id", T.StringType()),
    ]
)
EVENT_DATE = "event_date"
_MARK = "trailmetrics.utc_day"
_INDEX = "_file_times"  # readers of the facts pass over names that begin like this
_INDEX_SCHEMA = "file string, least timestamp, largest timestamp, untimed bigint"


class FactSchemaError(ValueError):
    """The input lacks a fact column or has it with another type."""


def check_fact_schema(facts: DataFrame) -> DataFrame:
    found = {field.name: field.dataType for field in facts.schema}
    wrong = [
        f"{field.name}: expected {field.dataType.simpleString()}, "
        f"found {found[field.name].simpleString() if field.name in found else 'nothing'}"
        for field in FACT_SCHEMA
        if found.get(field.name) != field.dataType
    ]
    if wrong:
        raise FactSchemaError("; ".join(wrong))
    return facts


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Lazy scan of a Parquet fact table; a missing path fails here, before any job.

    The day partitions of a table that ``write_facts`` stored are marked, so that windows prune
    by them. Any other column, whatever its name, is data and never decides what is read.
    """
    facts = check_fact_schema(spark.read.parquet(path))
    day = facts.schema["timestamp"].metadata.get(_MARK)
    kinds = {field.name: field.dataType for field in facts.schema}
    if kinds.get(day) != T.DateType():
        return facts
    return facts.withMetadata(day, {_MARK: day})


def day_column(facts: DataFrame) -> str | None:
    """The column that is known to hold the UTC day of ``timestamp``: marked by ``read_facts``, as is ``timestamp``.

    Both marks go with the columns as they were scanned; a column that is computed anew has none. Rows of several tables in one frame may
    each be marked or not, so there no column is trusted.
    """
    marks = {f.name: f.metadata[_MARK] for f in facts.schema if _MARK in f.metadata}
    day = marks.get("timestamp")
    if day is None or marks.get(day) != day:
        return None
    return None if re.search(r"^[ :+|-]*Union\b", facts._jdf.queryExecution().analyzed().toString(), re.MULTILINE) else day


def write_facts(
    facts: DataFrame, path: str, mode: str = "errorifexists", day: str = EVENT_DATE
) -> None:
    """Store facts, with all their columns, by UTC day.

    REBALANCE lets adaptive execution split a hot day over several tasks and merge quiet
    ones, so files keep an even size; sorting by time keeps row-group bounds tight. The name of
    the day column goes into the metadata of ``timestamp``, by which ``read_facts`` knows it.
    """
    others = [name for name in facts.columns if name != day_column(facts)]
    if day in others:
        raise FactSchemaError(f"{day} is a column of the facts; name another one for the days")
    marked = [
        F.col(name).alias(name, metadata={_MARK: day}) if name == "timestamp" else F.col(name)
        for name in others
    ]
    (
        facts.select(*marked, utc_day(F.col("timestamp")).alias(day))
        .hint("rebalance", day)
        .sortWithinPartitions(day, "timestamp")
        .write.mode(mode)
        .partitionBy(day)
        .parquet(path)
    )


def facts_in_window(facts: DataFrame, report_ts: str, window: Trailing) -> DataFrame:
    """Rows of the trailing window, read from the day partitions it touches.

    A bound on ``timestamp`` alone prunes no partition. The day bounds are one day wider on
    each side, so they hold for every session zone; the exact bound is the one on time.
    """
    return prune_days(facts, report_ts, window).where(
        in_window(F.col("timestamp"), instant(report_ts), window)
    )


def prune_days(facts: DataFrame, report_ts: str, window: Trailing) -> DataFrame:
    """Keep the day partitions a window can touch; facts without them pass unchanged."""
    anchor = instant(report_ts)
    return between_days(facts, anchor - window.interval, anchor)


def between_days(facts: DataFrame, first: Column, last: Column) -> DataFrame:
    """Keep the day partitions from ``first`` to ``last`` and one more on each side."""
    day = day_column(facts)
    if day is None:
        return facts
    return facts.where(
        F.col(day).between(F.date_sub(utc_day(first), 1), F.date_add(utc_day(last), 1))
    )


_SLASHES = r"^([A-Za-z0-9]+):/+"  # one path may be written with one slash after its scheme or with three


def _plain(file: str) -> str:
    return re.sub(_SLASHES, r"\1:/", file)


def _read_files(spark: SparkSession, path: str, files: list[str], schema: T.StructType) -> DataFrame:
    """Some files of a table, as ``inputFiles`` names them, with its partition columns."""
    return spark.read.schema(schema).option("basePath", path).parquet(*[unquote(file) for file in files])


def index_facts(spark: SparkSession, path: str) -> DataFrame:
    """Note the least and largest time of every file of a stored table that is not in its index yet; the index.

    Reads one column of the new files and nothing of the others. The driver compares names only, which Spark lists there anyway.
    """
    facts = spark.read.parquet(path)
    known = {row.file for row in file_index(spark, path).select("file").toLocalIterator()}
    new = sorted(file for file in facts.inputFiles() if _plain(file) not in known)
    if new:
        times = _read_files(spark, path, new, facts.schema)
        file = F.regexp_replace("_metadata.file_path", _SLASHES, "$1:/").alias("file")
        rows = times.groupBy(file).agg(
            F.min("timestamp").alias("least"), F.max("timestamp").alias("largest"), F.count_if(F.col("timestamp").isNull()).alias("untimed")
        )
        rows.write.mode("append").parquet(f"{path}/{_INDEX}")
    return file_index(spark, path)


def file_index(spark: SparkSession, path: str) -> DataFrame:
    """``file, least, largest, untimed`` of the files an index knows; without an index no rows."""
    if not exists(spark, f"{path}/{_INDEX}"):
        return spark.createDataFrame([], _INDEX_SCHEMA)
    return spark.read.schema(_INDEX_SCHEMA).parquet(f"{path}/{_INDEX}")


def read_facts_between(spark: SparkSession, path: str, first: Column, last: Column) -> DataFrame:
    """The stored facts without the files whose times all lie outside ``first`` to ``last``, as the index proves.

    What is left out is decided by the scanned times, here and now; whatever becomes of the columns after it, no row is lost to
    pruning. Files that the index does not know under their path are read. The driver sees the names of the files it is spared.
    """
    facts = check_fact_schema(spark.read.parquet(path))
    apart = (F.col("least") > last) | (F.col("largest") < first) | F.col("least").isNull()
    spared = {row.file for row in file_index(spark, path).where(apart).select("file").toLocalIterator()}
    if not spared:
        return facts
    kept = sorted(file for file in facts.inputFiles() if _plain(file) not in spared)
    return _read_files(spark, path, kept, facts.schema) if kept else facts.limit(0)
