from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import R, at
from trailmetrics import fixed_values as fixed
from trailmetrics.operators import catalog, contracts, documents

GENERATED_AT = "2026-03-07T12:00:05+00:00"


@pytest.fixture(scope="module")
def good(spark, make_facts):
    facts = make_facts([("site_a", at(R), "TIMEOUT"), ("site_b", at(R), "AUTH_ERROR")])
    found = documents.payload_documents(catalog.all_metrics(facts, R), R, GENERATED_AT)
    found[fixed.MANIFEST] = documents.manifest(spark, "20260307T120000Z", documents.stamps(R, GENERATED_AT))
    return {artifact: document.persist() for artifact, document in found.items()}


def broken(violations):
    return {r.rule: r.violations for r in violations.collect() if r.violations}


def test_good_documents_pass(good):
    contracts.check_documents(good)
    for artifact, document in good.items():
        assert broken(contracts.document_violations(document, artifact)) == {}
        assert broken(contracts.stored_json_violations(documents.as_json(document, artifact), artifact)) == {}


def null(name):
    return {name: F.lit(None).cast("string")}


def with_item(array, field, value):
    return {array: F.transform(array, lambda x: F.when(x["failures" if array != "exceptions" else "count"] >= 0,
                                                       x.withField(field, value)))}


MUTATIONS = [
    (fixed.SUMMARY, "schema_version is missing", lambda: null("schema_version"), 1),
    (fixed.SUMMARY, "generated_at is missing", lambda: null("generated_at"), 1),
    (fixed.SUMMARY, "report_ts is missing", lambda: null("report_ts"), 1),
    (fixed.SUMMARY, "failures_last_24h is not a count", lambda: {"failures_last_24h": F.lit(-1).cast("bigint")}, 1),
    (fixed.SUMMARY, "failures_last_7d is not a count", lambda: {"failures_last_7d": F.lit(None).cast("bigint")}, 1),
    (fixed.SUMMARY, "failures_last_7d is below failures_last_24h", lambda: {"failures_last_7d": F.lit(1).cast("bigint")}, 1),
    (fixed.SUMMARY, "top_sites is missing", lambda: {"top_sites": F.nullif("top_sites", "top_sites")}, 1),
    (fixed.SUMMARY, "top_sites.site is missing", lambda: with_item("top_sites", "site", F.lit(None).cast("string")), 2),
    (fixed.SUMMARY, "top_sites.failures is not a count", lambda: with_item("top_sites", "failures", F.lit(-1).cast("bigint")), 2),
    (fixed.TREND_30D, "days is missing", lambda: {"days": F.nullif("days", "days")}, 1),
    (fixed.TREND_30D, "days are not 30", lambda: {"days": F.slice("days", 1, 29)}, 1),
    (fixed.TREND_30D, "days are not consecutive", lambda: {"days": F.reverse("days")}, 1),
    (fixed.TREND_30D, "days.date is missing", lambda: with_item("days", "date", F.lit(None).cast("string")), 30),
    (fixed.TREND_30D, "days.failures is not a count", lambda: with_item("days", "failures", F.lit(-1).cast("bigint")), 30),
    (fixed.TOP_SITES, "window_days is below 1", lambda: {"window_days": F.lit(0)}, 1),
    (fixed.TOP_SITES, "sites.site is missing", lambda: with_item("sites", "site", F.lit(None).cast("string")), 2),
    (fixed.EXCEPTIONS, "window_days is below 1", lambda: {"window_days": F.lit(None).cast("int")}, 1),
    (fixed.EXCEPTIONS, "exceptions.failure_type is missing", lambda: with_item("exceptions", "failure_type", F.lit(None).cast("string")), 2),
    (fixed.EXCEPTIONS, "exceptions.count is not a count", lambda: with_item("exceptions", "count", F.lit(-1).cast("bigint")), 2),
    (fixed.MANIFEST, "run_id is missing", lambda: null("run_id"), 1),
    (fixed.MANIFEST, "status is unknown", lambda: {"status": F.lit("ok")}, 1),
    (fixed.MANIFEST, "artifacts item is missing", lambda: {"artifacts": F.array(F.lit(None).cast("string"))}, 1),
]
ALSO = {
    # A broken date or an absent list breaks the rules on the series as well.
    "days is missing": {"days are not 30"},
    "days.date is missing": {"days are not consecutive"},
}


@pytest.mark.parametrize("artifact, rule, change, count", MUTATIONS)
def test_each_mutation_breaks_its_rule(good, artifact, rule, change, count):
    found = broken(contracts.document_violations(good[artifact].withColumns(change()), artifact))
    assert found.pop(rule) == count
    assert set(found) <= ALSO.get(rule, set())


def test_error_is_a_known_status(good):
    document = good[fixed.MANIFEST].withColumn("status", F.lit("ERROR"))
    assert broken(contracts.document_violations(document, fixed.MANIFEST)) == {}


def test_columns_are_closed(good):
    summary = good[fixed.SUMMARY]
    for document, name in (
        (summary.drop("report_ts"), "report_ts"),
        (summary.withColumn("extra", F.lit(1)), "extra"),
        (summary.withColumn("failures_last_7d", F.lit("7")), "failures_last_7d"),
    ):
        assert broken(contracts.document_violations(document, fixed.SUMMARY)) == {f"columns differ: {name}": 1}


def test_a_missing_document_is_a_violation(good):
    none = good[fixed.SUMMARY].where("false")
    assert broken(contracts.document_violations(none, fixed.SUMMARY)) == {"document is missing": 1}


def test_check_names_documents_and_rules(good):
    documents_ = {**good, fixed.SUMMARY: good[fixed.SUMMARY].withColumn("failures_last_24h", F.lit(-5).cast("bigint"))}
    with pytest.raises(contracts.ContractViolation, match=r"summary\.json: failures_last_24h is not a count \(1\)"):
        contracts.check_documents(documents_)


def test_rules_work_on_rows_of_any_number(spark):
    df = spark.range(10_000).select((F.col("id") - 3).alias("n"))
    found = contracts.violations(df, {"negative": "n < 0", "size": "abs(n) % 3"}, empty="none")
    assert {r.rule: r.violations for r in found.collect()} == {
        "negative": 3, "size": sum(abs(n) % 3 for n in range(-3, 9_997)), "none": 0
    }


def text(change):
    base = {"failures_last_24h": 1, "failures_last_7d": 2, "generated_at": GENERATED_AT, "report_ts": R,
            "schema_version": "1.1.0", "top_sites": [{"failures": 1, "site": "a"}, {"failures": 1, "site": "b"}]}
    change(base)
    return json.dumps(base)


def change_item(**fields):
    return lambda d: d["top_sites"][0].update(fields)


BAD_JSON = [
    (lambda d: d.update(failures_last_7d="2"), "failures_last_7d has a wrong value"),
    (lambda d: d.update(failures_last_7d=5.0), None),
    (lambda d: d.update(failures_last_7d=5.5), "failures_last_7d has a wrong value"),
    (lambda d: d.update(failures_last_7d=True), "failures_last_7d has a wrong value"),
    (lambda d: d.update(failures_last_7d=None), "failures_last_7d has a wrong value"),
    (lambda d: d.update(failures_last_24h=-1), "failures_last_24h has a wrong value"),
    (lambda d: d.update(top_sites={}), "top_sites has a wrong value"),
    (lambda d: d.update(top_sites=[]), None),
    (change_item(site=None), "top_sites.site has a wrong value"),
    (change_item(site=7), "top_sites.site has a wrong value"),
    (change_item(failures=-1), "top_sites.failures has a wrong value"),
    (change_item(failures="1"), "top_sites.failures has a wrong value"),
    (change_item(extra=1), "top_sites item keys differ"),
    (lambda d: d["top_sites"][0].pop("site"), "top_sites item keys differ"),
    (lambda d: d["top_sites"].append(3), "top_sites item keys differ"),
    (lambda d: d.pop("report_ts"), "keys differ"),
    (lambda d: d.update(extra=1), "keys differ"),
    (lambda d: d.update(report_ts=5), "report_ts has a wrong value"),
]


def stored(spark, *texts, artifact=fixed.SUMMARY):
    return spark.createDataFrame([(artifact, t) for t in texts], "artifact string, value string")


@pytest.mark.parametrize("change, rule", BAD_JSON)
def test_stored_json_is_checked_strictly(spark, change, rule):
    found = broken(contracts.stored_json_violations(stored(spark, text(change)), fixed.SUMMARY))
    assert found == ({rule: 1} if rule else {})


def test_stored_json_that_is_no_json(spark):
    for bad in ("{", "", "[1]"):
        found = broken(contracts.stored_json_violations(stored(spark, bad), fixed.SUMMARY))
        assert found == {"keys differ" if bad == "[1]" else "text is not JSON": 1}


def test_stored_manifest_status_and_window_days(spark):
    manifest = {"artifacts": ["summary.json", 5], "generated_at": "g", "report_ts": R, "run_id": "r",
                "schema_version": "1.1.0", "status": "ok"}
    rows = stored(spark, json.dumps(manifest), artifact=fixed.MANIFEST)
    assert broken(contracts.stored_json_violations(rows, fixed.MANIFEST)) == {
        "status is unknown": 1, "artifacts item has a wrong value": 1
    }
    top = {"generated_at": "g", "report_ts": R, "schema_version": "1.1.0", "sites": [], "window_days": 0}
    rows = stored(spark, json.dumps(top), artifact=fixed.TOP_SITES)
    assert broken(contracts.stored_json_violations(rows, fixed.TOP_SITES)) == {"window_days has a wrong value": 1}


def test_stamps_agree_within_a_run(spark):
    def doc(run, **changes):
        return (run, json.dumps({"report_ts": R, "generated_at": GENERATED_AT} | changes))

    df = spark.createDataFrame(
        [doc("r1"), doc("r1"), doc("r2"), doc("r2", generated_at="later"), doc("r3", report_ts=None), doc("r3")],
        "run_id string, value string",
    )
    assert broken(contracts.run_consistency(df)) == {
        "report_ts differs within a run": 1, "generated_at differs within a run": 1
    }
