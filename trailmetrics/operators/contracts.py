"""Contracts: rules as SQL conditions, all rules of a dataset counted in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmetrics import fixed_values as fixed
from trailmetrics.operators.documents import DOCUMENT_SCHEMAS, ITEMS, PAGE

Rules = Mapping[str, str]


class ContractViolation(ValueError):
    """A document breaks its contract; nothing was written."""


def violations(rows: DataFrame, rules: Rules, empty: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, rule, violations)``, one row per rule, within each group of rows alike in ``by``.

    A rule is a condition that is true for a row that breaks it (NULL does not), or the number
    of breaches in the row; ``empty`` names a rule that only a dataset without rows breaks.
    Works on datasets of any size: one scan, one partial row per task and group.
    """
    counts = {
        name: f"coalesce(sum(CAST(({rule}) AS BIGINT)), 0L)" for name, rule in rules.items()
    }
    if empty:
        counts[empty] = "CAST(count(*) = 0 AS BIGINT)"
    pairs = (
        f"named_struct('rule', '{name}', 'violations', {count})" for name, count in counts.items()
    )
    found = rows.groupBy(*by).agg(F.expr(f"array({', '.join(pairs)})").alias("rules"))
    return found.select(*by, F.inline("rules"))


def _not_count(value: str) -> str:
    return f"{value} IS NULL OR {value} < 0"


def _how_many(array: str, bad: str) -> str:
    """Number of items ``x`` of an array for which ``bad`` holds; none if the array is NULL."""
    return f"coalesce(array_size(filter({array}, x -> {bad})), 0)"


def _missing(*names: str) -> Rules:
    return {f"{name} is missing": f"{name} IS NULL" for name in names}


_STAMP_RULES = _missing("schema_version", "generated_at", "report_ts")
_WINDOW_DAYS_RULES = {"window_days is below 1": "window_days IS NULL OR window_days < 1"}


def _ranked_rules(array: str, key: str, count: str) -> Rules:
    return {
        **_missing(array),
        f"{array} item is missing": _how_many(array, "x IS NULL"),
        f"{array}.{key} is missing": _how_many(array, f"x IS NOT NULL AND x.{key} IS NULL"),
        f"{array}.{count} is not a count": _how_many(
            array, f"x IS NOT NULL AND ({_not_count(f'x.{count}')})"
        ),
    }


def _trend_rules(days: int = fixed.TREND_DAYS) -> Rules:
    """Beside the shape: exactly ``days`` days, each the day after the one before it."""
    in_step = "try_to_date(x.date) <=> date_add(try_to_date(get(days, 0).date), i)"
    return {
        **_STAMP_RULES,
        **_missing("days"),
        "days.date is missing": _how_many("days", "x.date IS NULL"),
        "days.failures is not a count": _how_many("days", _not_count("x.failures")),
        f"days are not {days}": f"NOT array_size(days) <=> {days}",
        "days are not consecutive": f"array_size(filter(days, (x, i) -> NOT {in_step})) > 0",
    }


DOCUMENT_RULES: dict[str, Rules] = {
    fixed.SUMMARY: {
        **_STAMP_RULES,
        "failures_last_24h is not a count": _not_count("failures_last_24h"),
        "failures_last_7d is not a count": _not_count("failures_last_7d"),
        "failures_last_7d is below failures_last_24h": "failures_last_7d < failures_last_24h",
        **_ranked_rules("top_sites", "site", "failures"),
    },
    fixed.TREND_30D: _trend_rules(),
    fixed.TOP_SITES: {
        **_STAMP_RULES,
        **_WINDOW_DAYS_RULES,
        **_ranked_rules("sites", "site", "failures"),
    },
    fixed.EXCEPTIONS: {
        **_STAMP_RULES,
        **_WINDOW_DAYS_RULES,
        **_ranked_rules("exceptions", "failure_type", "count"),
    },
    fixed.MANIFEST: {
        **_STAMP_RULES,
        **_missing("run_id", "artifacts"),
        "status is unknown": (
            f"NOT coalesce(status IN ('{fixed.STATUS_SUCCESS}', '{fixed.STATUS_ERROR}'), false)"
        ),
        "artifacts item is missing": _how_many("artifacts", "x IS NULL"),
    },
}


def document_violations(document: DataFrame, artifact: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, rule, violations)`` of the document rows of one artifact.

    Its columns must be those of the contract and ``by``, and no others; that is decided by the schema alone.
    """
    expected = {f.name: f.dataType.simpleString() for f in DOCUMENT_SCHEMAS[artifact]}
    found = {f.name: f.dataType.simpleString() for f in document.schema if f.name not in (PAGE, *by)}
    if found != expected:
        wrong = {n for n in expected.keys() | found.keys() if expected.get(n) != found.get(n)}
        rows = document.select(*by).distinct() if by else document.sparkSession.range(1)
        return rows.select(
            *by,
            F.lit(f"columns differ: {', '.join(sorted(wrong))}").alias("rule"),
            F.lit(len(wrong)).cast("bigint").alias("violations"),
        )
    return violations(document, DOCUMENT_RULES[artifact], "document is missing", by)


def check_documents(documents: Mapping[str, DataFrame]) -> None:
    """Raise, naming documents and rules, unless every contract holds."""
    found = reduce(
        DataFrame.unionAll,
        [
            document_violations(document, artifact).select(
                F.lit(artifact).alias("artifact"), "rule", "violations"
            )
            for artifact, document in documents.items()
        ],
    )
    broken = sorted(tuple(row) for row in found.where("violations > 0").collect())
    if broken:
        raise ContractViolation(
            "; ".join(f"{artifact}: {rule} ({n})" for artifact, rule, n in broken)
        )


def run_consistency(payloads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(rule, violations)``: runs whose stored documents disagree on a stamp; for each run if ``by`` is its id."""
    stamps = ("report_ts", "generated_at")
    document = F.try_parse_json("value")
    stamped = payloads.select(
        "run_id",
        *[
            F.coalesce(F.try_variant_get(document, f"$.{stamp}", "string"), F.lit("")).alias(stamp)
            for stamp in stamps
        ],
    )
    differing = stamped.groupBy("run_id").agg(
        *[(F.min(stamp) != F.max(stamp)).alias(stamp) for stamp in stamps]
    )
    return violations(differing, {f"{stamp} differs within a run": stamp for stamp in stamps}, by=by)


# SQL conditions on variants: ``value`` is the text of an expression.


def _child(value: str, name: str) -> str:
    return f"try_variant_get({value}, '$.{name}', 'variant')"


def _keys(value: str) -> str:
    """Keys of a JSON object; NULL for anything else."""
    return f"json_object_keys(to_json({value}))"


def _wrong_keys(value: str, names: Sequence[str]) -> str:
    expected = ", ".join(f"'{name}'" for name in sorted(names))
    return f"NOT coalesce(array_sort({_keys(value)}) = array({expected}), false)"


def _is_string(value: str) -> str:
    return f"coalesce(schema_of_variant({value}) = 'STRING', false)"


def _is_array(value: str) -> str:
    return f"coalesce(startswith(schema_of_variant({value}), 'ARRAY<'), false)"


def _is_whole_number(value: str, minimum: int) -> str:
    """A JSON number without a fraction, at least ``minimum``; 5.0 is one, "5" and 5.5 are not."""
    number = f"try_variant_get({value}, '$', 'double')"
    return (
        f"coalesce(schema_of_variant({value}) RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL[(].*[)])$'"
        f" AND {number} = floor({number}) AND {number} >= {minimum}, false)"
    )


def _wrong_value(parent: str, field: T.StructField) -> str:
    """The key is there, even with a JSON null, and wrong; an absent key breaks the key rule."""
    value = _child(parent, field.name)
    if isinstance(field.dataType, T.StringType):
        right = _is_string(value)
    elif isinstance(field.dataType, T.ArrayType):
        right = _is_array(value)
    else:
        right = _is_whole_number(value, 1 if field.name == "window_days" else 0)
    return f"coalesce(array_contains({_keys(parent)}, '{field.name}'), false) AND NOT {right}"


def _stored_rules(artifact: str) -> Rules:
    schema = DOCUMENT_SCHEMAS[artifact]
    rules = {
        "text is not JSON": "document IS NULL",
        "keys differ": f"document IS NOT NULL AND {_wrong_keys('document', schema.names)}",
    }
    for field in schema:
        rules[f"{field.name} has a wrong value"] = _wrong_value("document", field)
    array = schema[ITEMS[artifact]]
    item = array.dataType.elementType
    elements = f"try_variant_get(document, '$.{array.name}', 'array<variant>')"
    if isinstance(item, T.StructType):
        rules[f"{array.name} item keys differ"] = _how_many(elements, _wrong_keys("x", item.names))
        for field in item:
            rules[f"{array.name}.{field.name} has a wrong value"] = _how_many(
                elements, _wrong_value("x", field)
            )
    else:
        rules[f"{array.name} item has a wrong value"] = _how_many(
            elements, f"NOT {_is_string('x')}"
        )
    if artifact == fixed.MANIFEST:
        rules["status is unknown"] = (
            f"{_is_string(_child('document', 'status'))} AND"
            " try_variant_get(document, '$.status', 'string')"
            f" NOT IN ('{fixed.STATUS_SUCCESS}', '{fixed.STATUS_ERROR}')"
        )
    return rules


def broken_texts(payloads: DataFrame) -> DataFrame:
    """``payloads`` with ``rules``, the strict rules that each stored text breaks, whatever document it is; no shuffle."""
    rules = F.expr("CAST(NULL AS ARRAY<STRING>)")
    for artifact in DOCUMENT_SCHEMAS:
        own = ", ".join(f"CASE WHEN CAST(({rule}) AS BIGINT) > 0 THEN '{name}' END" for name, rule in _stored_rules(artifact).items())
        rules = F.when(F.col("artifact") == artifact, F.expr(f"array_compact(array({own}))")).otherwise(rules)
    parsed = payloads.withColumn("document", F.try_parse_json("value"))
    return parsed.withColumn("rules", rules).drop("document")


def stored_json_violations(payloads: DataFrame, artifact: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, rule, violations)`` of stored JSON text, read strictly.

    ``from_json`` would drop unknown keys, turn numbers into strings and map wrong values to
    NULL, so the text is checked as a variant, whose values keep the type they were written with.
    """
    texts = payloads.where(F.col("artifact") == artifact)
    return violations(
        texts.select(*by, F.try_parse_json("value").alias("document")),
        _stored_rules(artifact),
        "document is missing",
        by,
    )
