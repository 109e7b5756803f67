"""Helpers of the operators: reading tables, text as words, groups of a sorted partition."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and cuts at spaces, tabs, line feeds, vertical tabs, form feeds and returns."""
    return text.translate(_LOWER_BYTES).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_names(taken: Collection[str], *wishes: str) -> list[str]:
    """The wished names, with underscores before them where a column has that name already, in any case."""
    lowered, free = {name.lower() for name in taken}, []
    for name in wishes:
        while name.lower() in lowered:
            name = f"_{name}"
        lowered.add(name.lower())
        free.append(name)
    return free


def digest_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(array: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8, null as empty."""
    return array.cast(pa.large_binary()).fill_null(b"").to_pylist()


def row_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that a batch of long texts stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_key(text: Column) -> list[Column]:
    """Two columns that stand for a whole text: 96 bits of two unrelated hashes."""
    return [F.xxhash64(text).alias("key_a"), F.crc32(text.cast("binary")).alias("key_b")]


def join_counted(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int = 500_000) -> DataFrame:
    """Joins ``right``, a stored table of narrow rows, as a broadcast if it has been counted to hold at most
    ``rows`` of them; else Spark shuffles both sides."""
    return left.join(F.broadcast(right) if right.count() <= rows else right, on, how)
