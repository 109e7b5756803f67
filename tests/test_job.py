from __future__ import annotations

import json
from datetime import timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import publish_job
from tests.conftest import R, at
from trailmetrics import fixed_values as fixed
from trailmetrics.plans import history


@pytest.fixture()
def table(spark, make_facts, root):
    facts = make_facts([(f"s{i}", at(R) - timedelta(hours=i), "T") for i in range(48)])
    path = f"{root}/facts"
    facts.withColumn("client", F.when(F.col("site") < "s3", "acme").otherwise("zen")).write.parquet(path)
    return path


def summary(spark, root):
    stored = history.open_current(spark, root).where(F.col("artifact") == fixed.SUMMARY)
    return json.loads(stored.first().value)


def test_job_publishes_a_run(spark, table, root):
    run = publish_job.main(["--facts", table, "--root", root, "--report-ts", R])
    assert run.run_id == "20260307T120000Z"
    assert summary(spark, root)["failures_last_24h"] == 25


def test_job_scopes_a_run_to_a_client(spark, table, root):
    publish_job.main(["--facts", table, "--root", root, "--report-ts", R, "--client", "acme"])
    found = summary(spark, f"{root}/client=acme")
    assert {s["site"] for s in found["top_sites"]} <= {f"s{i}" for i in (0, 1, 2, *range(10, 30))}
    assert found["failures_last_24h"] == 18


def test_job_publishes_all_clients_in_one_pass(spark, table, root):
    batch = publish_job.main(["--facts", table, "--root", root, "--report-ts", R, "--all-clients"])
    assert len(batch.published) == 2
    publish_job.main(["--facts", table, "--root", f"{root}/alone", "--report-ts", R, "--client", "acme"])
    found, alone = (summary(spark, f"{folder}/client=acme") for folder in (root, f"{root}/alone"))
    assert found["top_sites"] == alone["top_sites"] and found["failures_last_24h"] == 18


def test_job_stops_without_facts(root):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        publish_job.main(["--facts", f"{root}/none", "--root", root])
