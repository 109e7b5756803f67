"""Session helpers: time zone, shared scratch folder, and materialised intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_ZONE = "spark.sql.session.timeZone"
_CHECKPOINT_DIR = "spark.checkpoint.dir"


@contextmanager
def session_zone(spark: SparkSession, tz: str = "UTC") -> Iterator[None]:
    """Build DataFrames under one session time zone.

    Spark fixes the zone of date casts and day arithmetic when a plan is analysed, so the
    frames built inside the block keep ``tz`` when they run later, outside it.
    """
    before = spark.conf.get(_ZONE)
    spark.conf.set(_ZONE, tz)
    try:
        yield
    finally:
        spark.conf.set(_ZONE, before)


@lru_cache(maxsize=None)
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="trailmetrics-")


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``."""
    folder = spark.conf.get(_CHECKPOINT_DIR, None)
    if folder:
        return folder
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        return _local_folder(spark.sparkContext.applicationId)
    raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder shared by the cluster")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/trailmetrics/{application}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    Cuts lineage, so later jobs neither rescan the facts nor lose work with an executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
