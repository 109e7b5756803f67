from __future__ import annotations

import hashlib
import json
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import R, at, rows
from trailmetrics import fixed_values as fixed
from trailmetrics.operators import contracts, documents
from trailmetrics.plans import history, publish
from trailmetrics.sources.facts import FactSchemaError

R2 = "2026-03-08T12:00:00Z"
GENERATED_AT = "2026-03-08T12:00:05+00:00"
RUN, RUN2 = "20260307T120000Z", "20260308T120000Z"


@pytest.fixture(scope="module")
def facts(make_facts):
    anchor = at(R)
    return make_facts([
        (f"site_{i % 12}", anchor - timedelta(hours=7 * i), f"TYPE_{i % 3}") for i in range(60)
    ]).persist()


def digest(root: str, run_id: str) -> dict[str, str]:
    folder = Path(root) / "documents" / f"run_id={run_id}"
    return {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in folder.rglob("*") if p.is_file()}


def current(spark, root):
    return {r.artifact: (r.run_id, json.loads(r.value)) for r in history.open_current(spark, root).collect()}


def test_a_second_run_becomes_current_and_leaves_the_first_alone(spark, facts, root):
    first = publish.publish_run(spark, facts, root, R)
    before = digest(root, RUN)
    assert first.run_id == RUN and {a for a, _ in current(spark, root).items()} == set(fixed.ALL_ARTIFACTS)
    second = publish.publish_run(spark, facts, root, R2, GENERATED_AT)
    assert digest(root, RUN) == before
    found = current(spark, root)
    assert {run for run, _ in found.values()} == {RUN2}
    assert found[fixed.SUMMARY][1]["failures_last_24h"] == second.metrics["failures_last_24h"]
    assert found[fixed.MANIFEST][1]["generated_at"] == GENERATED_AT
    assert {r.run_id for r in history.committed_runs(spark, root).collect()} == {RUN, RUN2}

    with pytest.raises(history.RunAlreadyPublished):
        publish.publish_run(spark, facts, root, R)
    with pytest.raises(history.RunAlreadyPublished):
        publish.publish_run(spark, facts, root, "2026-03-07T07:00:00-05:00")
    assert digest(root, RUN) == before


def test_an_older_run_published_late_does_not_become_current(spark, facts, root):
    publish.publish_run(spark, facts, root, R2)
    publish.publish_run(spark, facts, root, R)
    assert {run for run, _ in current(spark, root).values()} == {RUN2}


def test_run_metrics(spark, facts, root):
    run = publish.publish_run(spark, facts, root, R)
    assert run.metrics == {
        "failures_last_24h": 4, "failures_last_7d": 25, "trend_30d": 30, "top_sites": 10, "exceptions": 3
    }
    assert history.committed_runs(spark, root).first().metrics == run.metrics


def test_a_run_that_stopped_half_way_is_invisible_and_can_be_repeated(spark, facts, root, monkeypatch):
    publish.publish_run(spark, facts, root, R)
    with monkeypatch.context() as patch:
        def fail(*_):
            raise OSError("lost")
        patch.setattr(history, "commit", fail)
        with pytest.raises(OSError):
            publish.publish_run(spark, facts, root, R2)
    assert digest(root, RUN2)
    assert {run for run, _ in current(spark, root).values()} == {RUN}
    publish.publish_run(spark, facts, root, R2)
    found = history.open_current(spark, root)
    assert found.count() == 5 and {r.run_id for r in found.collect()} == {RUN2}


@pytest.mark.parametrize("seconds", [1, -1])
def test_of_two_racing_commits_the_first_counts_whatever_its_stamp(spark, facts, root, seconds):
    publish.publish_run(spark, facts, root, R)
    entry = history.committed_runs(spark, root).first().asDict()
    later = entry["committed_at"] + timedelta(seconds=seconds)
    with pytest.raises(history.RunAlreadyPublished):
        history.commit(spark, root, entry | {"attempt": "a-0", "committed_at": later})
    assert [r.attempt for r in history.committed_runs(spark, root).collect()] == [entry["attempt"]]


def test_reading_creates_nothing_and_needs_no_right_to_write(spark, facts, root):
    with pytest.raises(history.RunNotReadable):
        history.open_current(spark, f"{root}/nothing")
    assert rows(history.committed_runs(spark, f"{root}/nothing")) == []
    assert not Path(f"{root}/nothing").exists()
    publish.publish_run(spark, facts, root, R)
    before = sorted(str(p) for p in Path(root).rglob("*"))
    assert len(current(spark, root)) == 5
    assert sorted(str(p) for p in Path(root).rglob("*")) == before


@pytest.mark.parametrize("row, rule", [
    ((None, 0, "T"), "top_sites.site is missing"),
    (("s", 0, None), "exceptions.failure_type is missing"),
])
def test_a_broken_contract_leaves_nothing(spark, make_facts, root, row, rule):
    facts = make_facts([(row[0], at(R), row[2])])
    with pytest.raises(contracts.ContractViolation, match=rule):
        publish.publish_run(spark, facts, root, R)
    assert not (Path(root) / "documents").exists()
    assert rows(history.committed_runs(spark, root)) == []
    assert [r.status for r in history.run_status(history.all_attempts(spark, root)).collect()] == [fixed.STATUS_ERROR]
    with pytest.raises(history.RunNotReadable, match="has status ERROR"):
        history.open_current(spark, root)


def test_empty_facts_are_published(spark, make_facts, root):
    run = publish.publish_run(spark, make_facts([]), root, R)
    assert run.metrics == {"failures_last_24h": 0, "failures_last_7d": 0, "trend_30d": 30, "top_sites": 0, "exceptions": 0}


def test_nothing_to_read(spark, root):
    with pytest.raises(history.RunNotReadable, match="no run"):
        history.open_current(spark, root)


def commit_copy(spark, root, run_id, **changes):
    entry = history.committed_runs(spark, root).where(F.col("run_id") == RUN).first().asDict()
    history.commit(spark, root, entry | {"run_id": run_id, "attempt": "a-copy"} | changes)


def test_a_newest_run_in_error_is_told_and_passed_over_only_on_request(spark, facts, make_facts, root):
    publish.publish_run(spark, facts, root, R)
    with pytest.raises(contracts.ContractViolation):
        publish.publish_run(spark, make_facts([(None, at(R2), "T")]), root, R2)
    with pytest.raises(history.RunNotReadable, match=f"{RUN2}, the newest run, has status ERROR"):
        history.open_current(spark, root)
    assert {r.run_id for r in history.open_current(spark, root, last_good=True).collect()} == {RUN}
    publish.publish_run(spark, facts, root, R2)
    assert {run for run, _ in current(spark, root).values()} == {RUN2}


def test_a_lost_page_is_reported(spark, make_facts, root):
    facts = make_facts([("s", at(R), f"TYPE_{i:04d}") for i in range(60)])
    publish.publish_run(spark, facts, root, R, page_items=20)
    runs, stored = history.committed_runs(spark, root), history.stored_documents(spark, root)
    assert rows(history.missing_artifacts(runs, stored)) == []
    left = stored.where("NOT (artifact = 'exceptions.json' AND page = 1)")
    assert rows(history.missing_artifacts(runs, left)) == [(RUN, fixed.EXCEPTIONS, "stored in part")]


def test_an_incomplete_run_is_not_read(spark, facts, root):
    publish.publish_run(spark, facts, root, R)
    texts = history.stored_documents(spark, root).where(F.col("artifact") != fixed.EXCEPTIONS)
    history.store_documents(texts.select("artifact", "page", "value"), root, RUN2, "a-copy")
    commit_copy(spark, root, RUN2, artifacts=[fixed.SUMMARY, fixed.TREND_30D, fixed.EXCEPTIONS])
    missing = history.missing_artifacts(history.committed_runs(spark, root), history.stored_documents(spark, root))
    assert sorted(rows(missing)) == [
        (RUN2, fixed.EXCEPTIONS, "not stored"), (RUN2, fixed.TOP_SITES, "not listed")
    ]
    with pytest.raises(history.RunNotReadable, match="exceptions.json is not stored; .*top_sites.json is not listed"):
        history.open_current(spark, root)


def test_pages_of_exceptions_are_stored_and_read_whole(spark, make_facts, root):
    facts = make_facts([("s", at(R), f"TYPE_{i:04d}") for i in range(400)])
    run = publish.publish_run(spark, facts, root, R, page_items=50)
    assert run.metrics["exceptions"] == 400
    stored = history.open_current(spark, root)
    assert stored.where(F.col("artifact") == fixed.EXCEPTIONS).count() > 1
    items = documents.items(documents.from_json(stored, fixed.EXCEPTIONS), fixed.EXCEPTIONS)
    found = [r.failure_type for r in items.orderBy("page", "position").collect()]
    assert found == [f"TYPE_{i:04d}" for i in range(400)]
    assert [r for r in contracts.stored_json_violations(stored, fixed.EXCEPTIONS).collect() if r.violations] == []


def test_stored_documents_pass_every_check(spark, facts, root):
    publish.publish_run(spark, facts, root, R)
    stored = history.open_current(spark, root)
    for artifact in fixed.ALL_ARTIFACTS:
        assert not [r for r in contracts.stored_json_violations(stored, artifact).collect() if r.violations]
    assert not [r for r in contracts.run_consistency(stored).collect() if r.violations]


def test_input_without_the_fact_columns_is_refused(spark, facts, root):
    with pytest.raises(FactSchemaError, match="failure_type: expected string, found nothing"):
        publish.publish_run(spark, facts.drop("failure_type"), root, R)
