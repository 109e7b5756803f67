"""Commits that survive lost writers, the compacted registry, and many runs in one pass."""

from __future__ import annotations

import json
import threading
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import R, at, rows
from tests.test_plans import plan
from trailmetrics import fixed_values as fixed
from trailmetrics.operators import documents, rollup, scoped
from trailmetrics.plans import backfill, history, publish
from trailmetrics.sources import objects

RUN = "20260307T120000Z"


def jobs(spark) -> int:
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def entry(run_id: str = RUN, attempt: str = "a-1", **more) -> dict:
    return {"run_id": run_id, "attempt": attempt, "status": fixed.STATUS_SUCCESS, "failed": False} | more


@pytest.fixture(scope="module")
def facts(make_facts):
    anchor = at(R)
    return make_facts([
        (f"site_{i % 12}", anchor - timedelta(hours=7 * i), f"TYPE_{i % 5}") for i in range(120)
    ]).persist()


def test_an_object_is_put_once_and_whole(spark, root):
    path = f"{root}/a/b.json"
    assert objects.put_once(spark, path, "Grüße") and not objects.put_once(spark, path, "other")
    assert objects.read_text(spark, path) == "Grüße" and objects.names_in(spark, f"{root}/a") == ["b.json"]
    assert [p.name for p in Path(f"{root}/a").iterdir()] == ["b.json"]  # nothing is left of either writer
    assert objects.names_in(spark, f"{root}/nothing") == []


def test_of_many_writers_at_once_one_puts(spark, root):
    won = []
    def write(i):
        if objects.put_once(spark, f"{root}/x/one", f"{i}" * 1000):
            won.append(i)
    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    (winner,) = won
    assert Path(f"{root}/x/one").read_text() == f"{winner}" * 1000


def test_a_writer_lost_before_the_last_step_leaves_no_object(spark, root, monkeypatch):
    def lost(stream, text):
        stream.write(bytearray(text.encode()[:5]))
        raise OSError("lost")
    with monkeypatch.context() as patch:
        patch.setattr(objects, "_write", lost)
        with pytest.raises(OSError):
            history.commit(spark, root, entry())
    assert rows(history.committed_runs(spark, root)) == []
    history.commit(spark, root, entry())
    assert [r.attempt for r in history.committed_runs(spark, root).collect()] == ["a-1"]


@pytest.mark.parametrize("torso", ["", "{", '{"run_id": "20260307T120000Z"', '{"run_id": "20260307T120000Z"}', "[]", "\x00\x00"])
def test_a_torso_blocks_neither_its_run_nor_readers(spark, facts, root, torso):
    folder = Path(root) / "registry" / "month=202603"
    folder.mkdir(parents=True)
    (folder / f"{RUN}.json").write_text(torso)
    (folder / f"{RUN}.1.json").write_text("")
    assert not history.is_committed(spark, root, RUN)
    history.commit(spark, root, entry(attempt="a-1"))
    assert history.is_committed(spark, root, RUN)
    with pytest.raises(history.RunAlreadyPublished):
        history.commit(spark, root, entry(attempt="a-2"))
    assert [r.attempt for r in history.committed_runs(spark, root).collect()] == ["a-1"]
    assert history.compact(spark, str(folder), after=1)
    assert [r.attempt for r in history.committed_runs(spark, root).collect()] == ["a-1"]


def test_a_run_is_published_over_a_torso(spark, facts, root):
    folder = Path(root) / "registry" / "month=202603"
    folder.mkdir(parents=True)
    (folder / f"{RUN}.json").write_text("")
    run = publish.publish_run(spark, facts, root, R)
    assert {r.run_id for r in history.open_current(spark, root).collect()} == {run.run_id}
    with pytest.raises(history.RunAlreadyPublished):
        publish.publish_run(spark, facts, root, R)


def test_publishing_opens_few_objects_however_many_runs_there_are(spark, root, monkeypatch):
    opened = []
    read = objects.read_text
    monkeypatch.setattr(history, "read_text", lambda s, path: opened.append(path) or read(s, path))
    first = at("2026-03-01T00:00:00Z")
    ids = [(first + timedelta(minutes=i)).strftime("%Y%m%dT%H%M%SZ") for i in range(400)]
    before = jobs(spark)
    for run_id in ids:
        history.commit(spark, root, entry(run_id))
        assert not history.is_committed(spark, root, "20260401T000000Z")
    assert jobs(spark) == before  # no Spark job for a commit
    assert len(opened) < 2 * 2 * len(ids)
    opened.clear()
    runs = history.committed_runs(spark, root)
    assert len(runs.inputFiles()) <= history.COMPACT_AFTER and len(opened) == 1
    assert sorted(r.run_id for r in runs.collect()) == ids
    assert history.latest_run(runs).first().run_id == ids[-1]


def test_two_that_compact_at_once_make_one_snapshot(spark, root):
    month = f"{root}/registry/month=202603"
    for i in range(5):
        history.commit(spark, root, entry(f"20260307T12000{i}Z"))
    stale = history._objects(spark, month)
    assert history.compact(spark, month, after=1)
    lines = "".join(Path(f"{month}/snapshot.00000001.jsonl").read_text())
    assert not objects.put_once(spark, f"{month}/snapshot.{len(stale[0]) + 1:08d}.jsonl", "")
    assert len(lines.splitlines()) == 5 and json.loads(lines.splitlines()[0])["object"] == "20260307T120000Z.json"
    assert not history.compact(spark, month, after=1)
    history.commit(spark, root, entry("20260307T130000Z"))
    assert history.committed_runs(spark, root).count() == 6


def test_publishing_takes_at_most_ten_jobs(spark, facts, root):
    publish.publish_run(spark, facts, f"{root}/warm", R)
    before = jobs(spark)
    publish.publish_run(spark, facts, f"{root}/one", R)
    assert jobs(spark) - before <= 10


def test_thirty_runs_take_as_many_jobs_as_three(spark, facts, root):
    def taken(n):
        stamps = [(at(R) - timedelta(hours=5 * i)).strftime("%Y-%m-%dT%H:%M:%SZ") for i in range(n)]
        before = jobs(spark)
        batch = backfill.backfill_reports(spark, facts, f"{root}/{n}", stamps, "g")
        assert len(batch.published) == n and not batch.broken and not batch.refused
        return jobs(spark) - before
    assert taken(30) <= taken(3) + 1  # adaptive execution may merge a stage into another


def test_a_batch_equals_single_runs_also_in_pages(spark, facts, root):
    stamps = [R, "2026-03-06T03:00:00Z", "2026-01-01T00:00:00Z"]  # the last one has no failures
    batch = backfill.backfill_reports(spark, facts, f"{root}/many", stamps, "g", page_items=2)
    singles = [publish.publish_run(spark, facts, f"{root}/one", ts, "g", page_items=2) for ts in sorted(stamps)]
    assert [run.metrics for run in batch.published] == [run.metrics for run in singles]
    stored = [
        history.documents_of_runs(spark, r, history.committed_runs(spark, r)).select("run_id", "artifact", "page", "value")
        for r in (f"{root}/many", f"{root}/one")
    ]
    assert sorted(rows(stored[0])) == sorted(rows(stored[1]))
    logs = [
        {r.run_id: (r.metrics, r.pages, r.digests, r.digest) for r in history.committed_runs(spark, r).collect()}
        for r in (f"{root}/many", f"{root}/one")
    ]
    assert logs[0] == logs[1]
    assert {r.run_id for r in history.open_current(spark, f"{root}/many").collect()} == {RUN}


def test_a_broken_report_does_not_keep_the_others(spark, make_facts, root):
    facts = make_facts([("s", at(R), "T"), ("s", at("2026-02-01T12:00:00Z"), None)])
    batch = backfill.backfill_reports(spark, facts, root, [R, "2026-02-01T13:00:00Z"], "g")
    assert [run.run_id for run in batch.published] == [RUN]
    assert list(batch.broken.values()) == ["exceptions.json: exceptions.failure_type is missing (1)"]
    status = {r.run_id: r.status for r in history.run_status(history.all_attempts(spark, root)).collect()}
    assert status == {RUN: fixed.STATUS_SUCCESS, "20260201T130000Z": fixed.STATUS_ERROR}
    stored = [p.name for p in Path(root).glob("batches/*/report=*/*")]
    assert stored == [f"run_id={RUN}"]


def test_clients_are_published_in_one_pass_each_with_a_history_of_its_own(spark, make_facts, root):
    anchor = at(R)
    names = ["north", "a/b.c", None, "", "quiet"]
    made = make_facts([(f"s{i % 3}", anchor - timedelta(hours=i), "T" if i else None) for i in range(60)])
    facts = made.withColumn("client", F.expr("element_at(array('north', 'a/b.c', NULL, '', 'bad'), CAST(substr(document_id, 5, 6) AS INT) % 4 + 1)"))
    facts = facts.where("failure_type IS NOT NULL").unionByName(
        make_facts([("s", anchor, None)]).withColumn("client", F.lit("bad"))
    ).unionByName(make_facts([("s", anchor - timedelta(90), "T")]).withColumn("client", F.lit("quiet"))).persist()
    batch = publish.publish_clients(spark, facts, root, R, "g")
    assert list(batch.broken) == ['{"client":"bad"}'] and len(batch.published) == 5
    for name in names:
        own = facts.where(F.col("client").eqNullSafe(F.lit(name)))
        alone = publish.publish_run(spark, own, f"{root}/alone/{names.index(name)}", R, "g")
        same = history.open_current(spark, publish.client_root(root, name))
        want = history.open_current(spark, f"{root}/alone/{names.index(name)}")
        assert sorted(rows(same.select("artifact", "value"))) == sorted(rows(want.select("artifact", "value"))), name
        assert alone.metrics == history.committed_runs(spark, publish.client_root(root, name)).first().metrics
    with pytest.raises(history.RunNotReadable, match="has status ERROR"):
        history.open_current(spark, publish.client_root(root, "bad"))
    again = publish.publish_clients(spark, facts.where("client <> 'bad'"), root, R, "g")
    assert not again.published and not again.broken
    facts.unpersist()


@pytest.mark.parametrize("change, fault", [
    (lambda v: v.replace('"failures_last_24h":', '"failures_last_24h":1'), "summary.json#0 is altered"),
    (lambda v: v[:-5], "summary.json: text is not JSON"),
    (lambda v: v.replace('"schema_version":"', '"schema_version":1,"x":"'), "summary.json: keys differ"),
])
def test_an_altered_document_is_not_shown(spark, facts, root, change, fault):
    publish.publish_run(spark, facts, root, R)
    (stored,) = Path(root).glob("documents/**/artifact=summary.json/page=0/*.txt")
    stored.write_text(change(stored.read_text().strip()) + "\n")
    for crc in stored.parent.glob(".*.crc"):
        crc.write_bytes(b"")  # a store without checksums of its own
        crc.unlink()
    with pytest.raises(history.RunNotReadable, match=fault):
        history.open_current(spark, root)


def test_ten_thousand_instants_are_counted_in_one_pass(spark, make_facts):
    first = at("2026-01-01T00:00:00Z")
    stamps = [(first + timedelta(minutes=7 * i)).strftime("%Y-%m-%dT%H:%M:%SZ") for i in range(10_000)]
    facts = make_facts([(f"s{i % 2}", first + timedelta(minutes=37 * i), "T") for i in range(1200)])
    found = backfill.backfill_rollup(facts, stamps)
    text = plan(found)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    found = found.where(F.col("grain") == rollup.BY_SITE).persist()
    assert found.select("report_ts").distinct().count() == 10_000
    for ts in (stamps[0], stamps[137], stamps[4321], stamps[-1]):
        want = rollup.rollup(facts, ts).where(F.col("grain") == rollup.BY_SITE)
        assert sorted(rows(found.where(F.col("report_ts") == ts).select(*want.columns))) == sorted(rows(want)), ts
    found.unpersist()


def test_runs_around_a_gap_in_the_clock_fall_into_classes(spark, make_facts):
    """30 days after the hour that New York skips: a run at 02:30 has its window open later than one at 03:10."""
    stamps = ["2026-04-07T06:30:00Z", "2026-04-07T07:10:00Z", "2026-04-07T07:40:00Z"]
    micros = timedelta(minutes=5)
    facts = make_facts([(f"s{i % 2}", at("2026-03-08T05:00:00Z") + i * micros, "T") for i in range(60)])
    found = backfill.backfill_rollup(facts, stamps, "America/New_York")
    for ts in stamps:
        want = rollup.rollup(facts, ts, "America/New_York")
        mine = found.where(F.col("report_ts") == ts).select(*want.columns)
        assert sorted(rows(mine), key=repr) == sorted(rows(want), key=repr), ts


def test_large_k_ranks_no_scope_in_one_task(spark, make_facts):
    counts = spark.range(9000).selectExpr("IF(id % 3 = 0, NULL, id % 3) AS client", "concat('s', id) AS site", "id % 50 AS failures")
    want = scoped.top_by(counts, ["client"], "failures", "site", 900)
    large = scoped.top_by(counts, ["client"], "failures", "site", 2000)
    assert "Window" in plan(want)
    assert sorted(rows(large.where("position <= 900")), key=repr) == sorted(rows(want), key=repr)
    assert large.count() == 6000 and "partitionBy" not in plan(large).lower().replace("_", "")
    per_scope = {r.client: (r.n, r.last) for r in large.groupBy("client").agg(F.count("*").alias("n"), F.max("position").alias("last")).collect()}
    assert per_scope == {None: (2000, 2000), 1: (2000, 2000), 2: (2000, 2000)}


def test_documents_by_holds_a_page_at_most(spark, make_facts):
    facts = make_facts([("s", at(R), f"T{i:03d}") for i in range(25)]).withColumn("client", F.lit(None).cast("string"))
    rolled = rollup.rollup(facts, R, scope=["client"]).persist()
    scopes = spark.range(1).select(F.lit(None).cast("string").alias("client"))
    metrics = scoped.metrics_by(rolled, ["client"], scopes, F.lit(R).cast("timestamp"))
    stamps = scopes.select(scoped.scope_key(["client"]).alias("scope"), F.lit(R).alias("report_ts"), F.lit(RUN).alias("run_id"))
    made = scoped.documents_by(metrics, ["client"], stamps, "g", page_items=10)
    sizes = sorted((r.page, len(r.exceptions)) for r in made[fixed.EXCEPTIONS].collect())
    assert sizes == [(0, 10), (1, 10), (2, 5)]
    assert {a: set(made[a].columns) - {"scope", documents.PAGE} for a in made} == {
        a: set(documents.DOCUMENT_SCHEMAS[a].names) for a in fixed.ALL_ARTIFACTS
    }
    rolled.unpersist()
