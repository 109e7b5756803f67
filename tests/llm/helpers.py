"""Small tables with the awkward cases, and plain versions of the operators."""

from __future__ import annotations

import random
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = str.maketrans(UPPER, LOWER)
#: Names that operators use inside, as columns that every table also has.
CLASHING = ("key_a", "key_b", "fp", "block", "score", "spans", "kept", "words", "first", "gone", "query", "shard", "start", "rows")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{name} string" for name in CLASHING)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def documents(spark: SparkSession, rows: Iterable[tuple[int | None, str | None]], sources: int = 3) -> DataFrame:
    full = [
        (doc_id, text, "en", None if i == 1 else f"src{i % sources}", len(text or ""), *["clash"] * len(CLASHING))
        for i, (doc_id, text) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def awkward() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, ties, repeated rows, a null id, one long text, copies, near-copies."""
    base, long = prose(1, 120), prose(2, 6_000)
    near = base.split()
    near[60] = "zebra"
    return [
        (5, None), (6, ""), (7, " \t\n "), (8, "one two"), (9, base), (3, base), (3, base), (None, prose(3, 80)),
        (None, base), (11, long), (12, " ".join(near)), (13, prose(4, 60) + " " + base), (14, "Grüße 😀 " + prose(5, 70)),
        (15, "the " * 90), (16, "aa" * 150), (17, prose(6, 30)),
    ]


def folder(spark: SparkSession, **tables: DataFrame) -> str:
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return path


def rows(df: DataFrame) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)
