"""A corpus pipeline: stages over documents, each written and read again.

Each stage takes the session, the documents its predecessor kept and the folder of the other tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmetrics.llm.common import table
from trailmetrics.llm.decontaminate import clean_documents
from trailmetrics.llm.packing import pack_documents
from trailmetrics.llm.pii import redact_documents
from trailmetrics.llm.quality import good_documents
from trailmetrics.llm.simhash import one_of_each
from trailmetrics.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return good_documents(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Marks stand in for personal data; ``n_chars`` follows the new text."""
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in its training sequence."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packing),
]

#: SQL cannot express the classifier, the fingerprints or the packing; tests/llm hold the stages to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
