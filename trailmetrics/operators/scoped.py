"""The metrics of many reports at once: one per client, or one per report instant."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmetrics import fixed_values as fixed
from trailmetrics.operators import documents as docs
from trailmetrics.operators.rollup import BY_SITE, BY_TYPE_AND_DATE
from trailmetrics.operators.windowed import date_spine
from trailmetrics.session import session_zone


def join_scopes(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which NULL keys meet NULL keys, as groupings have them."""
    renamed = right.withColumnsRenamed({key: f"__{key}" for key in keys})
    same = [F.col(key).eqNullSafe(F.col(f"__{key}")) for key in keys]
    return left.join(renamed, same, "left").drop(*(f"__{key}" for key in keys))


#: Up to this rank Spark limits each task to the first rows of each group before it ranks them.
GROUP_LIMIT = 1000


def top_by(rows: DataFrame, scope: Sequence[str], count: str, name: str, k: int) -> DataFrame:
    """``(*scope, position, name, count)`` of the ``k`` largest counts of each scope, ties by name.

    A window up to ``GROUP_LIMIT``, of which each task sends at most ``k`` rows a scope. Beyond it a task would get
    all of a scope; there rows are sorted by ranges instead, and a scope may lie in many of them.
    """
    if k <= GROUP_LIMIT:
        rank = W.partitionBy(*scope).orderBy(F.desc(count), F.asc_nulls_last(name))
        ranked = rows.withColumn("position", F.row_number().over(rank))
    else:
        ranked = ranked_by(rows, scope, [F.desc(count), F.asc_nulls_last(name)], "top")
    return ranked.where(F.col("position") <= k).select(*scope, "position", name, count)


def ranked_by(rows: DataFrame, scope: Sequence[str], order: Sequence[Column], label: str) -> DataFrame:
    """Stored rows with their ``position`` from 1 within their scope; no task holds a whole scope.

    The position among all rows, less that of the scope's first: one row a scope and task is shuffled for that.
    """
    ranked = docs.ranked(rows, [*(F.asc_nulls_first(key) for key in scope), *order], label)
    firsts = ranked.groupBy(*scope).agg(F.min("position").alias("first"))
    return join_scopes(ranked, firsts, scope).select(*rows.columns, (F.col("position") - F.col("first") + 1).alias("position"))


def scope_key(scope: Sequence[str]) -> Column:
    """One text that stands for the scope columns, NULL unlike any text."""
    return F.to_json(F.struct(*scope))


def documents_by(
    metrics: Mapping[str, DataFrame],
    scope: Sequence[str],
    stamps: DataFrame,
    generated_at: str,
    page_items: int = docs.PAGE_ITEMS,
) -> dict[str, DataFrame]:
    """The documents of many reports, a row for each document and page: ``scope``, the contract's columns, and the page.

    ``stamps`` has a row per report, ``(scope, report_ts, run_id)``, where ``scope`` is its ``scope_key``. Items are gathered by scope
    and page, so an array holds k sites, 30 days, or a page, whatever the number of reports.
    """
    marks = stamps.select("scope", F.lit(0).alias(docs.PAGE))  # so that a report without items has its first page

    def keyed(name: str) -> DataFrame:
        metric = metrics[name]
        return metric.select(scope_key(scope).alias("scope"), *[c for c in metric.columns if c not in scope])

    def gathered(items: DataFrame, order: Sequence[Column], item: Column, array: str, **more: Column) -> DataFrame:
        marked = items if docs.PAGE in items.columns else items.withColumn(docs.PAGE, F.lit(0))
        both = marked.unionByName(marks, allowMissingColumns=True)
        rows = both.groupBy("scope", docs.PAGE).agg(
            docs.in_order(order, item).alias(array), *[column.alias(name) for name, column in more.items()]
        )
        return rows.join(stamps, "scope")

    def shaped(rows: DataFrame, artifact: str, window_days: int | None = None) -> DataFrame:
        fields = {
            "schema_version": F.lit(fixed.SCHEMA_VERSION),
            "generated_at": F.lit(generated_at),
            "window_days": F.lit(window_days),
            "status": F.lit(fixed.STATUS_SUCCESS),
            "artifacts": F.array(*map(F.lit, fixed.PAYLOAD_ARTIFACTS)),
        }
        schema = docs.DOCUMENT_SCHEMAS[artifact]
        return rows.select(
            "scope", *[fields.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema], docs.PAGE
        )

    def site_item() -> Column:
        return F.when(F.col("position").isNotNull(), F.struct("failures", "site"))

    totals = keyed("failures_last_24h").unionByName(keyed("failures_last_7d"), allowMissingColumns=True)
    summary = gathered(
        totals.unionByName(keyed("top_sites_by_failures"), allowMissingColumns=True),
        [F.col("position")],
        site_item(),
        "top_sites",
        failures_last_24h=F.max("failures_last_24h"),
        failures_last_7d=F.max("failures_last_7d"),
    )
    day = F.when(F.col("date").isNotNull(), F.struct(F.col("date").cast("string").alias("date"), "failures"))
    paged = ranked_by(keyed("exceptions_7d"), ["scope"], docs.largest_first("count", "failure_type"), "exceptions")
    paged = paged.withColumn(docs.PAGE, F.floor((F.col("position") - 1) / page_items).cast("int"))
    kind = F.when(F.col("position").isNotNull(), F.struct("count", "failure_type"))
    return {
        fixed.SUMMARY: shaped(summary, fixed.SUMMARY),
        fixed.TREND_30D: shaped(gathered(keyed("trend_30d"), [F.col("date")], day, "days"), fixed.TREND_30D),
        fixed.TOP_SITES: shaped(
            gathered(keyed("top_sites_30d"), [F.col("position")], site_item(), "sites"), fixed.TOP_SITES, fixed.TOP_SITES_WINDOW_DAYS
        ),
        fixed.EXCEPTIONS: shaped(
            gathered(paged, [F.col("position")], kind, "exceptions"), fixed.EXCEPTIONS, fixed.EXCEPTIONS_WINDOW_DAYS
        ),
        fixed.MANIFEST: shaped(stamps.withColumn(docs.PAGE, F.lit(0)), fixed.MANIFEST),
    }


def metrics_by(
    rolled: DataFrame,
    scope: Sequence[str],
    scopes: DataFrame,
    anchor: Column,
    k: int = fixed.TOP_K,
    tz: str = "UTC",
) -> dict[str, DataFrame]:
    """The required metrics per row of ``scopes``, out of a rollup with that scope.

    ``scopes`` names every report wanted, so one without failures still shows its zeros;
    ``anchor`` is its report instant. Each metric reads the rollup again, so materialise it.
    """
    by_type_and_date = rolled.where(F.col("grain") == BY_TYPE_AND_DATE)

    def total(column: str, name: str) -> DataFrame:
        totals = by_type_and_date.groupBy(*scope).agg(F.sum(column).alias("n"))
        return (
            join_scopes(scopes.select(*scope), totals, scope)
            .select(*scope, F.coalesce("n", F.lit(0)).alias(name))
        )

    def sites(column: str) -> DataFrame:
        counts = rolled.where((F.col("grain") == BY_SITE) & (F.col(column) > 0))
        return top_by(counts.select(*scope, "site", F.col(column).alias("failures")), scope, "failures", "site", k)

    def trend() -> DataFrame:
        with session_zone(rolled.sparkSession, tz):
            spine = date_spine(scopes, anchor).select(*scope, "date")
        per_day = by_type_and_date.groupBy(*scope, "date").agg(F.sum("n_30d").alias("n"))
        return join_scopes(spine, per_day, [*scope, "date"]).select(
            *scope, "date", F.coalesce("n", F.lit(0)).alias("failures")
        )

    return {
        "failures_last_24h": total("n_24h", "failures_last_24h"),
        "failures_last_7d": total("n_7d", "failures_last_7d"),
        "top_sites_by_failures": sites("n_7d"),
        "trend_30d": trend(),
        "top_sites_30d": sites("n_30d"),
        "exceptions_7d": by_type_and_date.groupBy(*scope, "failure_type")
        .agg(F.sum("n_7d").alias("count"))
        .where(F.col("count") > 0),
    }
