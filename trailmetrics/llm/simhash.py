"""SimHash near-duplicates: fingerprints partitioned and searched by vantage-point trees.

Equal fingerprints are one class, so copies cost nothing beyond their fingerprint. The 64 bits are cut into
``SEGMENTS`` runs; of two fingerprints that differ in at most ``RADIUS`` bits, some run differs in at most
``RADIUS // SEGMENTS``. For each run a vantage-point tree partitions all classes: every level measures the Hamming
distance of the run to a vantage point and splits at the middle distance. A class lives in one shard, and
also visits the shards behind every boundary, from either side, that lies within reach of it, by the triangle
inequality; so each of a linked pair visits the home shard of the other, whatever the number of levels. Inside a shard a further vantage-point tree prunes by
the same bounds, and pairs that are left are compared in all 64 bits. A shard reports the spanning stars of its
links, never all pairs of a group; connected components follow from these stars.

The depth of the tree follows the number of classes. A shard that holds more than ``CELL_HOMES`` homes nevertheless
is split by homes, each part with all visitors.

Defined results: null, empty and wordless texts have fingerprint zero, which links like any other; rows without
an id get a component id if a row with an id is in reach, else null; repeated rows get a row each; an
empty table gives an empty result. Only the named columns are looked at, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmetrics.llm.common import free_names, join_counted, row_slices, table, text_bytes, text_key, words_of
from trailmetrics.llm.components import connected_components, local_labels
from trailmetrics.session import materialise

SHINGLE = 4
SEED = 42
RADIUS = 4
SEGMENTS = 3
SHARD_HOMES = 2_048
CELL_HOMES = 4_096
LEAF = 384
_CHUNK = 1 << 15
_ALL = (1 << 64) - 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The bits set in over half the hashes of the text's shingles."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [end - 1 for end in accumulate(len(word) + 1 for word in words)]
    starts = [0, *(end + 1 for end in ends[:-1])]
    ends = ends[min(shingle, len(words)) - 1 :]
    counts, n, digest = np.zeros(64, dtype=np.int64), len(ends), xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        pieces = zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])
        hashes = np.array([digest(joined[start:end], SEED) for start, end in pieces], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key_a, key_b, fp`` of every row; the keys stand for the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), *text_key(text), text.alias("text"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 256):
            prints = np.array([fingerprint(text) for text in text_bytes(batch.column(3))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(prints.view(np.int64))], ["doc_id", "key_a", "key_b", "fp"]
            )

    kinds = rows.drop("text").schema.simpleString().removeprefix("struct<").removesuffix(">")
    return rows.mapInArrow(add, f"{kinds}, fp long")


def _segment_masks(segments: int = SEGMENTS) -> list[int]:
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    return [((1 << (high - low)) - 1) << low for low, high in zip(cuts, cuts[1:])]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _vantage(segment: int, level: int) -> int:
    return xxhash.xxh64_intdigest(b"vantage point %d %d" % (segment, level), SEED)


def _sides(distance: Column, middle: int, reach: int, bit: int) -> Callable[[Column], Column]:
    """Of a path so far, the paths that one more level sends a class to: its home side, and the other if it is in reach."""
    inside, outside = distance <= middle + reach, distance > middle - reach

    def longer(path: Column) -> Column:
        both = F.when(inside & outside, F.array(path, path + bit))
        return both.when(inside, F.array(path)).otherwise(F.array(path + bit))

    return longer


def shards(classes: DataFrame, levels: int, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """``segment, path, fp, home``: each class in its home shard and in those it visits."""
    by_segment = []
    for segment, mask in enumerate(_segment_masks(segments)):
        reach, middle = radius // segments, (mask.bit_count() - 1) // 2
        paths, home = F.array(F.lit(0)), F.lit(0)
        for level in range(levels):
            bit = 1 << level
            apart = F.col("fp").bitwiseXOR(F.lit(_signed(_vantage(segment, level)))).bitwiseAND(F.lit(_signed(mask)))
            distance = F.bit_count(apart)
            home = home + F.when(distance > middle, bit).otherwise(0)

            paths = F.flatten(F.transform(paths, _sides(distance, middle, reach, bit)))
        visits = classes.select("fp", home.alias("home_path"), F.explode(paths).alias("path"))
        by_segment.append(
            visits.select(F.lit(segment).alias("segment"), "path", "fp", (F.col("path") == F.col("home_path")).alias("home"))
        )
    out = by_segment[0]
    for more in by_segment[1:]:
        out = out.unionAll(more)
    return out


def tree_links(fp: np.ndarray, homes: np.ndarray, mask: int, radius: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the positions in ``fp``: a home and any member within ``radius`` bits are connected.

    ``mask`` selects the run of bits that has to agree within ``reach``.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    metrics = ((np.uint64(mask), reach), (np.uint64(_ALL), radius))

    def compare(own: np.ndarray, other: np.ndarray) -> None:
        for at in range(0, len(own), LEAF):
            rows = own[at : at + LEAF]
            for low in range(0, len(other), 8 * LEAF):
                columns = other[low : low + 8 * LEAF]
                i, j = np.nonzero(np.bitwise_count(fp[rows][:, None] ^ fp[columns][None, :]) <= radius)
                a, b = rows[i], columns[j]
                apart = a != b
                if apart.any():
                    nodes, ends = np.unique(np.concatenate([a[apart], b[apart]]), return_inverse=True)
                    label = local_labels(len(nodes), *np.split(ends, 2))
                    star = np.flatnonzero(label != np.arange(len(nodes)))
                    found.append((nodes[star], nodes[label[star]]))

    stack = [(homes, np.arange(len(fp)))]
    while stack:
        own, other = stack.pop()
        if len(own) <= 32 or len(other) <= LEAF:
            compare(own, other)
            continue
        for bits, near in metrics:
            point = fp[own[len(own) // 2]]
            to_own = np.bitwise_count((fp[own] ^ point) & bits).astype(int)
            to_other = np.bitwise_count((fp[other] ^ point) & bits).astype(int)
            middle = int(np.median(to_own))
            middle -= middle == to_own.max()
            parts = [
                (own[to_own <= middle], other[to_other <= middle + near]),
                (own[to_own > middle], other[to_other > middle - near]),
            ]
            work = sum(len(a) * len(b) for a, b in parts)
            if work <= 0.8 * len(own) * len(other):
                stack += [part for part in parts if len(part[0])]
                break
        else:
            compare(own, other)
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def class_links(classes: DataFrame, n_classes: int, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """``a, b``: spanning links between fingerprints of at most ``radius`` different bits."""
    levels = max(0, (max(1, n_classes) // SHARD_HOMES).bit_length())
    rows = materialise(shards(classes, levels, radius, segments), "shards")
    full = rows.groupBy("segment", "path").agg(F.count_if("home").alias("homes")).where(F.col("homes") > 0)
    full = full.withColumn("cells", F.ceil(F.col("homes") / CELL_HOMES).cast("int"))  # one row per shard: 3 * 2**levels
    masks, reach = _segment_masks(segments), radius // segments
    own = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    every = F.sequence(F.lit(0), F.col("cells") - 1)
    cells = join_counted(rows, materialise(full, "full-shards"), ["segment", "path"], "inner")
    cells = cells.withColumn("own", own).withColumn("cell", F.explode(every))
    cells = cells.withColumn("home", F.col("home") & (F.col("own") == F.col("cell")))

    def links(cell: pa.Table) -> pa.Table:
        fp = cell["fp"].to_numpy().view(np.uint64)
        homes = np.flatnonzero(cell["home"].to_numpy(zero_copy_only=False))
        a, b = tree_links(fp, homes, masks[cell["segment"][0].as_py()], radius, reach)
        label = local_labels(len(fp), a, b)
        star = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"a": fp[star].view(np.int64), "b": fp[label[star]].view(np.int64)})

    grouped = cells.select("segment", "path", "cell", "fp", "home").groupBy("segment", "path", "cell")
    return grouped.applyInArrow(links, "a long, b long")


def grouped_by_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored ``doc_id, key_a, key_b, fp`` of every row, and ``fp, first`` of every fingerprint.

    ``first`` is the least row of the component: rows with an id before others, then by id and text key.
    """
    rows = materialise(with_fingerprints(docs, id_col, text_col), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key_a", "key_b")
    classes = materialise(rows.groupBy("fp").agg(F.min(order).alias("first")), "classes")
    labels = materialise(connected_components(class_links(classes.select("fp"), classes.count())), "labels")
    linked = join_counted(classes, labels.withColumnRenamed("node", "fp"), ["fp"], "inner")
    linked = materialise(linked.groupBy("label").agg(F.min("first").alias("of_all")), "components")
    members = join_counted(labels.withColumnRenamed("node", "fp"), linked, ["label"], "inner").drop("label")
    firsts = join_counted(classes, materialise(members, "members"), ["fp"], "left")
    return rows, materialise(firsts.select("fp", F.coalesce("of_all", "first").alias("first")), "firsts")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, with all columns, of which one of each group of near-duplicates is left, the first.

    Rows that share id and text are one document.
    """
    rows, firsts = grouped_by_fingerprint(docs)
    names = free_names([*docs.columns, *rows.columns], "nameless", "some_id", "key_a", "key_b")
    stay = firsts.select("first.*").distinct().toDF(*names)
    stay = stay.withColumn(names[1], F.coalesce(F.col(names[1]).cast("string"), F.lit("")))
    stay = materialise(stay, "stay")
    nameless, some_id = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))

    def kept(df: DataFrame, key_a: Column, key_b: Column) -> DataFrame:
        named = df.withColumns(dict(zip(names, (nameless, some_id, key_a, key_b))))
        return join_counted(named, stay, names, "left_semi")

    out = kept(docs, *text_key(F.coalesce(F.col("text"), F.lit(""))))
    if kept(rows, F.col("key_a"), F.col("key_b")).count() > stay.count():  # only if rows are repeated
        out = out.dropDuplicates(names)
    return out.select(*docs.columns)


def op4_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, firsts = grouped_by_fingerprint(table(spark, sf_dir, "documents"))
    return join_counted(rows, firsts, ["fp"], "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
    )
