"""Report documents: metric rows gathered into nested, JSON-ready rows, and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmetrics import fixed_values as fixed
from trailmetrics.functions import windows
from trailmetrics.session import materialise


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _COUNT = T.StringType(), T.LongType()

# Keys in alphabetical order: to_json keeps the order of the struct.
DOCUMENT_SCHEMAS = {
    fixed.SUMMARY: _struct(
        failures_last_24h=_COUNT,
        failures_last_7d=_COUNT,
        generated_at=_TEXT,
        report_ts=_TEXT,
        schema_version=_TEXT,
        top_sites=T.ArrayType(_struct(failures=_COUNT, site=_TEXT)),
    ),
    fixed.TREND_30D: _struct(
        days=T.ArrayType(_struct(date=_TEXT, failures=_COUNT)),
        generated_at=_TEXT,
        report_ts=_TEXT,
        schema_version=_TEXT,
    ),
    fixed.TOP_SITES: _struct(
        generated_at=_TEXT,
        report_ts=_TEXT,
        schema_version=_TEXT,
        sites=T.ArrayType(_struct(failures=_COUNT, site=_TEXT)),
        window_days=T.IntegerType(),
    ),
    fixed.EXCEPTIONS: _struct(
        exceptions=T.ArrayType(_struct(count=_COUNT, failure_type=_TEXT)),
        generated_at=_TEXT,
        report_ts=_TEXT,
        schema_version=_TEXT,
        window_days=T.IntegerType(),
    ),
    fixed.MANIFEST: _struct(
        artifacts=T.ArrayType(_TEXT),
        generated_at=_TEXT,
        report_ts=_TEXT,
        run_id=_TEXT,
        schema_version=_TEXT,
        status=_TEXT,
    ),
}

ITEMS = {
    fixed.SUMMARY: "top_sites",
    fixed.TREND_30D: "days",
    fixed.TOP_SITES: "sites",
    fixed.EXCEPTIONS: "exceptions",
    fixed.MANIFEST: "artifacts",
}

PAGE = "page"
# Items of one exceptions document; the list goes on in the next page.
PAGE_ITEMS = 10_000


def stamps(report_ts: str, generated_at: str) -> dict[str, Column]:
    """The metadata columns every document of a run shares."""
    return {
        "schema_version": F.lit(fixed.SCHEMA_VERSION),
        "generated_at": F.lit(generated_at),
        "report_ts": F.lit(report_ts),
    }


def in_order(order: Sequence[Column], item: Column) -> Column:
    """Array of ``item`` sorted by ``order``, as collect_list has no order of its own.

    Rows whose item is NULL give no element.
    """
    keys = [key.alias(f"k{i}") for i, key in enumerate(order)]
    entry = F.when(item.isNotNull(), F.struct(*keys, item.alias("item")))
    return F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["item"])


def largest_first(count: str, key: str) -> list[Column]:
    return [-F.col(count), F.col(key).isNull(), F.col(key)]


def _shaped(document: DataFrame, artifact: str) -> DataFrame:
    schema = DOCUMENT_SCHEMAS[artifact]
    return document.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], PAGE)


def summary(
    last_24h: DataFrame, last_7d: DataFrame, top_sites: DataFrame, meta: Mapping[str, Column]
) -> DataFrame:
    """One document from two one-row totals and at most k sites."""
    parts = last_24h.unionByName(last_7d, allowMissingColumns=True).unionByName(
        top_sites.withColumn("item", F.struct("failures", "site")), allowMissingColumns=True
    )
    document = parts.agg(
        F.max("failures_last_24h").alias("failures_last_24h"),
        F.max("failures_last_7d").alias("failures_last_7d"),
        in_order(largest_first("failures", "site"), F.col("item")).alias("top_sites"),
    )
    return _shaped(document.withColumns({**meta, PAGE: F.lit(0)}), fixed.SUMMARY)


def trend(days: DataFrame, meta: Mapping[str, Column]) -> DataFrame:
    """One document from the daily series, oldest day first."""
    item = F.struct(F.col("date").cast("string").alias("date"), "failures")
    document = days.agg(in_order([F.col("date")], item).alias("days"))
    return _shaped(document.withColumns({**meta, PAGE: F.lit(0)}), fixed.TREND_30D)


def top_sites(sites: DataFrame, meta: Mapping[str, Column], window_days: int) -> DataFrame:
    """One document from at most k sites."""
    document = sites.agg(
        in_order(largest_first("failures", "site"), F.struct("failures", "site")).alias("sites")
    )
    return _shaped(
        document.withColumns({**meta, "window_days": F.lit(window_days), PAGE: F.lit(0)}),
        fixed.TOP_SITES,
    )


def ranked(rows: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """Stored rows with their global ``position`` from 1 in ``order``.

    Sorting is by ranges; a row's position is its place in its range and the rows of the ranges before,
    of which the offsets table has one row each.
    """
    place = F.monotonically_increasing_id()  # range number in the upper bits, place in it in the lower
    numbered = materialise(rows.orderBy(*order).withColumn("place", place), label)
    split = numbered.withColumn("range", F.shiftright("place", 33))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = split.groupBy("range").agg(F.count("*").alias("n"))
    offsets = offsets.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.col("place").bitwiseAND((1 << 33) - 1)
    return split.join(F.broadcast(offsets), "range").select(
        *rows.columns, (F.col("offset") + inside + 1).alias("position")
    )


def exceptions(
    types: DataFrame, meta: Mapping[str, Column], window_days: int, page_items: int = PAGE_ITEMS
) -> DataFrame:
    """The count of every failure type, in pages of ``page_items`` by position.

    Types have no proven bound, so no array holds more than a page; few types make one page, and none an empty one.
    """
    order = largest_first("count", "failure_type")
    paged = ranked(types.select("failure_type", "count"), order, "exceptions")
    paged = paged.withColumn(PAGE, F.floor((F.col("position") - 1) / page_items).cast("int"))
    mark = types.sparkSession.range(1).select(F.lit(0).alias(PAGE))  # so that there is a first page
    item = F.when(F.col("position").isNotNull(), F.struct("count", "failure_type"))
    document = (
        paged.unionByName(mark, allowMissingColumns=True)
        .groupBy(PAGE)
        .agg(in_order([F.col("position")], item).alias("exceptions"))
    )
    return _shaped(
        document.withColumns({**meta, "window_days": F.lit(window_days)}), fixed.EXCEPTIONS
    )


def manifest(
    spark: SparkSession,
    run_id: str,
    meta: Mapping[str, Column],
    artifacts: Sequence[str] = fixed.PAYLOAD_ARTIFACTS,
    status: str = fixed.STATUS_SUCCESS,
) -> DataFrame:
    names = F.array(*map(F.lit, artifacts)) if artifacts else F.array().cast("array<string>")
    document = spark.range(1).withColumns(
        {
            **meta,
            "run_id": F.lit(run_id),
            "status": F.lit(status),
            "artifacts": names,
            PAGE: F.lit(0),
        }
    )
    return _shaped(document, fixed.MANIFEST)


def payload_documents(
    metrics: Mapping[str, DataFrame], report_ts: str, generated_at: str, page_items: int = PAGE_ITEMS
) -> dict[str, DataFrame]:
    """The four payload documents of a run, from the metrics of the catalog or of a rollup."""
    meta = stamps(windows.normalise_report_ts(report_ts), generated_at)
    return {
        fixed.SUMMARY: summary(
            metrics["failures_last_24h"],
            metrics["failures_last_7d"],
            metrics["top_sites_by_failures"],
            meta,
        ),
        fixed.TREND_30D: trend(metrics["trend_30d"], meta),
        fixed.TOP_SITES: top_sites(metrics["top_sites_30d"], meta, fixed.TOP_SITES_WINDOW_DAYS),
        fixed.EXCEPTIONS: exceptions(
            metrics["exceptions_7d"], meta, fixed.EXCEPTIONS_WINDOW_DAYS, page_items
        ),
    }


def as_json(document: DataFrame, artifact: str, *others: Column | str) -> DataFrame:
    """``(*others, artifact, page, value)`` with the document as one line of JSON, keys sorted.

    Nulls are written out, as a contract must be able to see them.
    """
    body = F.struct(*DOCUMENT_SCHEMAS[artifact].names)
    return document.select(
        *others,
        F.lit(artifact).alias("artifact"),
        PAGE,
        F.to_json(body, {"ignoreNullFields": "false"}).alias("value"),
    )


def from_json(payloads: DataFrame, artifact: str) -> DataFrame:
    """Documents of one artifact out of stored JSON, other columns kept."""
    others = [c for c in payloads.columns if c not in ("artifact", "value")]
    parsed = F.from_json("value", DOCUMENT_SCHEMAS[artifact]).alias("document")
    return (
        payloads.where(F.col("artifact") == artifact)
        .select(*others, parsed)
        .select("document.*", *others)
    )


def items(document: DataFrame, artifact: str) -> DataFrame:
    """One row per item: the document's other columns, its position from 1, and its fields."""
    column = ITEMS[artifact]
    others = [c for c in document.columns if c != column]
    rows = document.select(*others, F.posexplode(column).alias("position", "item"))
    fields = F.col("item").alias("artifact") if artifact == fixed.MANIFEST else F.col("item.*")
    return rows.select(*others, (F.col("position") + 1).alias("position"), fields)
