"""Sharding over fixed virtual slots.

Every record hashes into one of a few thousand slots for good. What moves between shards is a slot,
never a single record: a small versioned table maps slots to shards, and rebalancing appends a new
version of it that differs in as few slots as the bytes per slot demand.

Defined results: a null text has no bytes; a null id is hashed as such, together with the text, so
neither null ids nor a repeated id pile up in one slot; rows that are equal in id and text get
different places in an arbitrary order; an empty table gives an empty result and an even map.
Only ``id_col`` and ``text_col`` are looked at, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmetrics.llm.common import free_names
from trailmetrics.session import materialise, scratch_path

SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int"


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot, in one version."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]


def first_map(n_shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 1: slots dealt out in turn, without a look at the data."""
    return SlotMap(1, n_shards, tuple(slot % n_shards for slot in range(slots)))


def rebalance(current: SlotMap, slot_bytes: list[int], n_shards: int | None = None) -> SlotMap:
    """The next version: slots move from the fullest to the emptiest shard while that evens them out.

    Each step moves the slot that comes closest to half the difference, so few slots move and the
    two shards get closer. A shard full with one heavy slot is left to the next fullest; it ends when no slot of
    any shard weighs less than its difference to the emptiest.
    """
    n = n_shards or current.n_shards
    if n < current.n_shards:
        raise ValueError("shards are only added; empty one by mapping its slots elsewhere first")
    shard_of = list(current.shard_of)
    loads = [0] * n
    members: list[set[int]] = [set() for _ in range(n)]
    for slot, shard in enumerate(shard_of):
        loads[shard] += slot_bytes[slot]
        if slot_bytes[slot]:
            members[shard].add(slot)
    while True:
        spare = loads.index(min(loads))
        for full in sorted(range(n), key=lambda shard: (-loads[shard], shard)):
            gap = loads[full] - loads[spare]
            fitting = [slot for slot in members[full] if slot_bytes[slot] < gap]
            if fitting:
                break
        else:
            return SlotMap(current.version + 1, n, tuple(shard_of))
        slot = min(fitting, key=lambda s: (abs(2 * slot_bytes[s] - gap), s))
        members[full].remove(slot)
        members[spare].add(slot)
        loads[full] -= slot_bytes[slot]
        loads[spare] += slot_bytes[slot]
        shard_of[slot] = spare


def store_map(spark: SparkSession, path: str, slot_map: SlotMap) -> None:
    """Appends a version to the map table; earlier versions stay readable."""
    rows = [(slot_map.version, slot, shard) for slot, shard in enumerate(slot_map.shard_of)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the newest unless one is named: a row per slot."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    wanted = stored.agg(F.max("version")).first()[0] if version is None else version
    return stored.where(F.col("version") == wanted)


def slotted(docs: DataFrame, id_col: str, text_col: str, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` of every row."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(id_col, text), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_totals(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; the driver gets one row per slot at most."""
    sizes, counts = [0] * slots, [0] * slots
    totals = rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*"))
    for slot, size, count in totals.collect():
        sizes[slot], counts[slot] = size, count
    return sizes, counts


def place(rows: DataFrame, slot_map: DataFrame, counts: list[int]) -> DataFrame:
    """Adds each row's shard and its place in it, ``slot``, gapless from 0.

    Places are ranked inside a virtual slot and moved up by the rows of the shard's earlier slots, so
    no task ranks a whole shard. Broadcast is one row per slot.
    """
    spark = rows.sparkSession
    counted = spark.createDataFrame(list(enumerate(counts)), "virtual_slot int, n long")
    earlier = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    mapped = slot_map.join(counted, "virtual_slot").withColumn(
        "first_place", F.coalesce(F.sum("n").over(earlier), F.lit(0))
    )
    inside = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32")
    return (
        rows.withColumn("inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(mapped.drop("n")), "virtual_slot")
        .withColumn("slot", (F.col("first_place") + F.col("inside")).cast("long"))
        .drop("inside", "first_place")
    )


def shard_documents(
    docs: DataFrame,
    n_shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    slots: int = SLOTS,
    map_path: str | None = None,
) -> DataFrame:
    """Shards of near equal bytes: ``doc_id, size, text_crc32, virtual_slot, version, shard, slot``.

    The map lies at ``map_path``; on the first call it is begun there, on each call edited for the
    bytes found.
    """
    spark = docs.sparkSession
    rows = materialise(slotted(docs, id_col, text_col, slots), "slotted")
    sizes, counts = slot_totals(rows, slots)
    if map_path is None:
        map_path = scratch_path(spark, "slot-map")
        current = first_map(n_shards, slots)
        store_map(spark, map_path, current)
    else:
        stored = load_map(spark, map_path).orderBy("virtual_slot").collect()  # one row per slot
        shard_of = tuple(row.shard for row in stored)
        current = SlotMap(stored[0].version, max(max(shard_of) + 1, 1), shard_of)
    store_map(spark, map_path, rebalance(current, sizes, n_shards))
    return place(rows, load_map(spark, map_path), counts)


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, id_col: str, text_col: str) -> None:
    """Writes all columns of ``docs`` into a folder per shard, by the stored map."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slot = F.pmod(F.xxhash64(id_col, text), F.lit(slot_map.count())).cast("int")
    own, shard = free_names(docs.columns, "__slot", "__shard")
    shards = slot_map.select(F.col("virtual_slot").alias(own), F.col("shard").alias(shard))  # a row per slot
    placed = docs.withColumn(own, slot).join(F.broadcast(shards), own).drop(own)
    placed.repartition(shard, F.rand(7)).write.partitionBy(shard).parquet(path)


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version",
    )
