"""All documents of one run out of its rollup, assembled together: a row per document and page, in as few jobs as that takes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trailmetrics import fixed_values as fixed
from trailmetrics.functions.windows import instant, normalise_report_ts
from trailmetrics.operators import documents as docs
from trailmetrics.operators.contracts import DOCUMENT_RULES, ContractViolation
from trailmetrics.operators.rollup import BY_SITE, BY_TYPE_AND_DATE
from trailmetrics.operators.windowed import date_spine, top_k
from trailmetrics.session import materialise, session_zone

# grouping_id() over (failure_type, date).
_TYPE, _DATE, _TOTAL = 0b01, 0b10, 0b11
_TOTALS = {"failures_last_24h": "n_24h", "failures_last_7d": "n_7d"}


def _types_and_days(rolled: DataFrame, report_ts: str, tz: str) -> tuple[DataFrame, int]:
    """Counts by failure type, by day and in total, stored, and how many types the exceptions list.

    The days of the series are counted along, each with nothing, so that none is missing.
    """
    with session_zone(rolled.sparkSession, tz):
        spine = date_spine(rolled.sparkSession.range(1), instant(report_ts)).select("date")
    rows = rolled.where(F.col("grain") == BY_TYPE_AND_DATE).withColumn("listed", F.lit(False))
    days = spine.select("date", F.lit(True).alias("listed"), *[F.lit(0).cast("bigint").alias(n) for n in ("n_24h", "n_7d", "n_30d")])
    columns = ["failure_type", "date", "listed", "n_24h", "n_7d", "n_30d"]
    both = rows.select(*columns).unionByName(days, allowMissingColumns=True)
    counts = both.groupingSets([["failure_type"], ["date"], []], "failure_type", "date").agg(
        F.grouping_id().alias("grain"), F.max("listed").alias("listed"), *[F.sum(n).alias(n) for n in ("n_24h", "n_7d", "n_30d")]
    )
    seen = Observation()
    listed = F.count_if((F.col("grain") == _TYPE) & (F.col("n_7d") > 0)).alias("types")
    return materialise(counts.observe(seen, listed), "types-days"), seen.get["types"]


def _items(rows: DataFrame, artifact: str, label: str, n: str, page: Column | None = None, by_label: bool = False) -> DataFrame:
    """Items of one document, in the order of their count or of their label."""
    name = F.col(label).cast("string")
    rank = F.struct((F.lit(0) if by_label else -F.col(n)).cast("bigint").alias("k0"), name.isNull().alias("k1"), name.alias("k2"))
    item = F.struct(rank.alias("rank"), name.alias("label"), F.col(n).cast("bigint").alias("n"))
    return rows.select(F.lit(artifact).alias("artifact"), (F.lit(0) if page is None else page).alias(docs.PAGE), item.alias("item"))


def assembled(
    rolled: DataFrame,
    report_ts: str,
    generated_at: str,
    run_id: str,
    k: int = fixed.TOP_K,
    tz: str = "UTC",
    page_items: int = docs.PAGE_ITEMS,
) -> DataFrame:
    """``artifact``, the page, and the columns of all contracts, of which a document has its own.

    Equal to the documents of ``payload_documents`` and the manifest. Types that fill more than a page are
    ranked by ranges; those that fit into one are sorted there.
    """
    report_ts = normalise_report_ts(report_ts)
    spark = rolled.sparkSession
    counts, n_types = _types_and_days(rolled, report_ts, tz)
    sites = rolled.where(F.col("grain") == BY_SITE)
    types = counts.where((F.col("grain") == _TYPE) & (F.col("n_7d") > 0)).select("failure_type", F.col("n_7d").alias("count"))
    page = None
    if n_types > page_items:
        types = docs.ranked(types, docs.largest_first("count", "failure_type"), "exceptions")
        page = F.floor((F.col("position") - 1) / page_items).cast("int")

    def top(n: str) -> DataFrame:
        found = sites.where(F.col(n) > 0).select("site", F.col(n).alias("failures"))
        return top_k(found, "site", k=k)

    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, fixed.ALL_ARTIFACTS))).alias("artifact"), F.lit(0).alias(docs.PAGE))
    totals = counts.where(F.col("grain") == _TOTAL).select(
        F.lit(fixed.SUMMARY).alias("artifact"), F.lit(0).alias(docs.PAGE), *[F.col(n).alias(name) for name, n in _TOTALS.items()]
    )
    series = counts.where((F.col("grain") == _DATE) & F.col("listed"))
    parts = [
        _items(top("n_7d"), fixed.SUMMARY, "site", "failures"),
        _items(series, fixed.TREND_30D, "date", "n_30d", by_label=True),
        _items(top("n_30d"), fixed.TOP_SITES, "site", "failures"),
        _items(types, fixed.EXCEPTIONS, "failure_type", "count", page),
        listed,
        totals,
    ]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    gathered = both.groupBy("artifact", docs.PAGE).agg(
        F.array_sort(F.collect_list("item")).alias("items"), *[F.max(name).alias(name) for name in _TOTALS]
    )
    return gathered.select("artifact", docs.PAGE, *_columns(report_ts, generated_at, run_id))


def _named_items(names: Sequence[str]) -> Column:
    """The items, with the label and the count named as a contract has them."""
    return F.transform(
        "items",
        lambda item: F.struct(*[(item["n"] if name in ("failures", "count") else item["label"]).alias(name) for name in names]),
    )


def _columns(report_ts: str, generated_at: str, run_id: str) -> list[Column]:
    """The columns of all contracts; NULL in documents that do not have them."""
    values = {
        **docs.stamps(report_ts, generated_at),
        "run_id": F.lit(run_id),
        "status": F.lit(fixed.STATUS_SUCCESS),
        "artifacts": F.array(*map(F.lit, fixed.PAYLOAD_ARTIFACTS)),
        **{name: F.col(name) for name in _TOTALS},
    }
    window_days = {fixed.TOP_SITES: fixed.TOP_SITES_WINDOW_DAYS, fixed.EXCEPTIONS: fixed.EXCEPTIONS_WINDOW_DAYS}
    found: dict[str, Column] = {}
    for artifact, schema in docs.DOCUMENT_SCHEMAS.items():
        for field in schema:
            value = F.lit(window_days.get(artifact)) if field.name == "window_days" else values.get(field.name)
            if value is None:
                value = _named_items(field.dataType.elementType.names)
            value = value.cast(field.dataType)
            held = F.when(F.col("artifact") == artifact, value)
            found[field.name] = F.coalesce(found[field.name], held) if field.name in found else held
    return [column.alias(name) for name, column in found.items()]


def texts(documents: DataFrame, *others: str) -> DataFrame:
    """``(*others, artifact, page, value, items)`` and the two totals, each document with its own keys in order."""
    value = items = F.lit(None)
    for artifact, schema in docs.DOCUMENT_SCHEMAS.items():
        own = F.col("artifact") == artifact
        value = F.when(own, F.to_json(F.struct(*schema.names), {"ignoreNullFields": "false"})).otherwise(value)
        items = F.when(own, F.array_size(docs.ITEMS[artifact]).cast("bigint")).otherwise(items)
    return documents.select(*others, "artifact", docs.PAGE, value.alias("value"), items.alias("items"), *_TOTALS)


def check_assembled(documents: DataFrame) -> None:
    """Raise, naming documents and rules, unless every contract holds. A row per page comes back, with the rules it breaks."""
    rules = F.expr("CAST(NULL AS ARRAY<STRUCT<rule: STRING, violations: BIGINT>>)")
    for artifact, own in DOCUMENT_RULES.items():
        pairs = ", ".join(f"named_struct('rule', '{name}', 'violations', CAST(({rule}) AS BIGINT))" for name, rule in own.items())
        rules = F.when(F.col("artifact") == artifact, F.expr(f"filter(array({pairs}), r -> r.violations > 0)")).otherwise(rules)
    broken: dict[tuple[str, str], int] = {}
    seen = set()
    for row in documents.select("artifact", rules.alias("rules")).collect():
        seen.add(row.artifact)
        for rule, n in row.rules:
            broken[row.artifact, rule] = broken.get((row.artifact, rule), 0) + n
    broken |= {(artifact, "document is missing"): 1 for artifact in fixed.ALL_ARTIFACTS if artifact not in seen}
    if broken:
        raise ContractViolation("; ".join(f"{artifact}: {rule} ({n})" for (artifact, rule), n in sorted(broken.items())))
