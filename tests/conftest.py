from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

import pytest
from pyspark.sql import DataFrame, SparkSession

from trailmetrics.sources.facts import FACT_SCHEMA

SMALL = "/root/testdata/sf0.001"
R = "2026-03-07T12:00:00Z"


def at(iso: str) -> datetime:
    return datetime.fromisoformat(iso).astimezone(timezone.utc)


@pytest.fixture(scope="session")
def spark() -> Iterable[SparkSession]:
    session = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '8')}]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_facts(spark: SparkSession) -> Callable[[Iterable[tuple]], DataFrame]:
    """Facts from ``(site, timestamp, failure_type)`` tuples."""

    def make(rows: Iterable[tuple]) -> DataFrame:
        numbered = [(*row, f"doc_{i:06d}_1000") for i, row in enumerate(rows)]
        return spark.createDataFrame(numbered, FACT_SCHEMA)

    return make


@pytest.fixture()
def root() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def rows(df: DataFrame) -> list[tuple]:
    return [tuple(row) for row in df.collect()]
