from __future__ import annotations

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import R, at, rows
from trailmetrics import fixed_values as fixed
from trailmetrics.operators import catalog, documents

GENERATED_AT = "2026-03-07T12:00:05+00:00"


def as_python(document, artifact):
    return [json.loads(r.value) for r in documents.as_json(document, artifact).orderBy("page").collect()]


@pytest.fixture(scope="module")
def found(make_facts):
    anchor = at(R)
    facts = make_facts([
        ("site_b", anchor, "TIMEOUT"), ("site_a", anchor, "TIMEOUT"),
        ("site_c", anchor - timedelta(2), "AUTH_ERROR"), ("site_c", anchor - timedelta(10), "OLD"),
    ])
    return documents.payload_documents(catalog.all_metrics(facts, R), R, GENERATED_AT)


def test_documents_have_the_shape_of_the_contract(found):
    meta = {"schema_version": "1.1.0", "generated_at": GENERATED_AT, "report_ts": R}
    assert as_python(found[fixed.SUMMARY], fixed.SUMMARY) == [{
        **meta, "failures_last_24h": 2, "failures_last_7d": 3,
        "top_sites": [{"site": f"site_{c}", "failures": 1} for c in "abc"],
    }]
    assert as_python(found[fixed.TOP_SITES], fixed.TOP_SITES) == [{
        **meta, "window_days": 30,
        "sites": [{"site": "site_c", "failures": 2}, {"site": "site_a", "failures": 1}, {"site": "site_b", "failures": 1}],
    }]
    assert as_python(found[fixed.EXCEPTIONS], fixed.EXCEPTIONS) == [{
        **meta, "window_days": 7,
        "exceptions": [{"failure_type": "TIMEOUT", "count": 2}, {"failure_type": "AUTH_ERROR", "count": 1}],
    }]
    (trend,) = as_python(found[fixed.TREND_30D], fixed.TREND_30D)
    assert {k: v for k, v in trend.items() if k != "days"} == meta
    assert trend["days"][0] == {"date": "2026-02-06", "failures": 0}
    assert trend["days"][-1] == {"date": "2026-03-07", "failures": 2}
    assert [d["date"] for d in trend["days"]] == sorted(d["date"] for d in trend["days"])


def test_json_keys_are_sorted_at_every_level(found):
    for artifact, document in found.items():
        text = documents.as_json(document, artifact).first().value
        assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))


def test_empty_facts_give_empty_lists_and_30_zero_days(make_facts):
    empty = documents.payload_documents(catalog.all_metrics(make_facts([]), R), R, GENERATED_AT)
    (summary,) = as_python(empty[fixed.SUMMARY], fixed.SUMMARY)
    assert (summary["failures_last_24h"], summary["failures_last_7d"], summary["top_sites"]) == (0, 0, [])
    assert as_python(empty[fixed.EXCEPTIONS], fixed.EXCEPTIONS)[0]["exceptions"] == []
    (trend,) = as_python(empty[fixed.TREND_30D], fixed.TREND_30D)
    assert [d["failures"] for d in trend["days"]] == [0] * 30


def test_null_keys_stay_visible_in_json(make_facts):
    facts = make_facts([(None, at(R), "T")])
    document = documents.payload_documents(catalog.all_metrics(facts, R), R, GENERATED_AT)[fixed.SUMMARY]
    assert as_python(document, fixed.SUMMARY)[0]["top_sites"] == [{"site": None, "failures": 1}]


def test_manifest(spark):
    document = documents.manifest(spark, "20260307T120000Z", documents.stamps(R, GENERATED_AT))
    assert as_python(document, fixed.MANIFEST) == [{
        "schema_version": "1.1.0", "generated_at": GENERATED_AT, "report_ts": R,
        "run_id": "20260307T120000Z", "status": "SUCCESS",
        "artifacts": ["summary.json", "trend_30d.json", "top_sites.json", "exceptions.json"],
    }]


def test_many_failure_types_fill_pages_in_order_and_lose_none(spark):
    types = spark.range(5_000).select(
        F.format_string("TYPE_%05d", "id").alias("failure_type"), (F.col("id") % 7).alias("count")
    )
    meta = documents.stamps(R, GENERATED_AT)
    document = documents.exceptions(types, meta, 7, page_items=900).orderBy("page")
    pages = as_python(document, fixed.EXCEPTIONS)
    assert [len(p["exceptions"]) for p in pages] == [900] * 5 + [500]
    (whole,) = as_python(documents.exceptions(types, meta, 7), fixed.EXCEPTIONS)
    assert [item for page in pages for item in page["exceptions"]] == whole["exceptions"]
    assert len(whole["exceptions"]) == 5_000


def test_items_and_json_round_trip(found):
    for artifact, document in found.items():
        back = documents.from_json(documents.as_json(document, artifact), artifact)
        assert sorted(rows(documents.items(back, artifact).drop("page"))) == sorted(
            rows(documents.items(document, artifact).drop("page"))
        )
