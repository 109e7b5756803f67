"""Ranked lexical search, reversed: the items stay, the documents pass by.

The items' terms make an inverted index, term to items. It is broadcast; each document's term counts stream through it and
add to the scores of the items that hold its terms; every task keeps a bounded heap per item, and the heaps are merged.

The driver takes the items in order of their id and cuts them into blocks of about ``BLOCK_BYTES`` of text, so an index never
holds more than that and one item, and the driver no more than one block; each block of items meets all documents. For
a block, documents are read and cut into terms once: this stores what a document has of the block's terms, in packed rows of
``ROW_DOCUMENTS`` documents, with the number of all its terms. From these Spark adds up how many documents and terms there are and
how many documents hold each term. Weights follow from that, and the packed rows are scored ``SLICE`` documents at a time, so that
a task holds at most ``SLICE`` scores per item beside its heaps.

Sums are of 64-bit integers. In a heap, equal scores prefer the smaller id, and a document without an id comes after all
others. Heaps hold ``k`` entries, so a task returns at most ``k`` rows per item, however many documents score.

Defined results: a null or empty text, or one without terms, is not a document for the statistics and ranks nowhere; neither does
one whose score is 0. An item without terms has no rows. Rows that share an id, of items or documents, are items or
documents each. Without items or without documents the result is empty. Texts are taken whole, of any length: a document is its
counts, in memory one at a time. Only the named columns are looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmetrics.llm.common import row_slices, table, text_bytes
from trailmetrics.llm.packed import pack, unpack
from trailmetrics.session import materialise

K = 20
BLOCK_BYTES = 16 << 20
ROW_DOCUMENTS = 4096
ROW_COUNTS = 1 << 20
SLICE = 64
#: Fixed values of the scores.
SCALE, TERM_SCALE, SATURATION, LENGTH_PERCENT, WEIGHT_SCALE = 1_000_000_000, 1000, 12, 25, 1000
NO_ID = np.iinfo(np.int64).max

#: Fixed value: letters and digits of ASCII and all bytes of other characters are parts of terms.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and characters outside ASCII, with A-Z in lower case."""
    return text.translate(_TERM_BYTES).split()


@dataclass
class Index:
    """For each term of some items, the items that have it and how often, term by term."""

    numbers: dict[bytes, int]
    starts: np.ndarray
    items: np.ndarray
    repeats: np.ndarray
    n_items: int

    @classmethod
    def of(cls, texts: list[bytes]) -> Index:
        holders: dict[bytes, list[tuple[int, int]]] = {}
        for item, text in enumerate(texts):
            for term, n in Counter(terms_of(text)).items():
                holders.setdefault(term, []).append((item, n))
        starts = np.cumsum([0, *map(len, holders.values())])
        pairs = np.array([pair for found in holders.values() for pair in found], dtype=np.int64).reshape(-1, 2)
        return cls({term: i for i, term in enumerate(holders)}, starts, pairs[:, 0], pairs[:, 1], len(texts))


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, Index]]:
    """The ids and the index of one block of items after another."""
    ids, texts, size = [], [], 0
    ordered = items.select(F.col(item_col).alias("id"), F.col(text_col).alias("text")).orderBy("id", "text")
    for row in ordered.toLocalIterator():
        ids.append(row.id)
        texts.append((row.text or "").encode())
        size += len(texts[-1])
        if size >= block_bytes:
            yield ids, Index.of(texts)
            ids, texts, size = [], [], 0
    if ids:
        yield ids, Index.of(texts)


_COUNTED = "ids array<bigint>, lengths binary, sizes binary, terms binary, counts binary, held binary, with_terms bigint, n_terms bigint"


def _counted(docs: DataFrame, numbers, id_col: str, text_col: str) -> DataFrame:
    """Packed rows: per document its id, number of terms, and the block's terms in it with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        names = [field.split(" ")[0] for field in _COUNTED.split(", ")]
        schema = pa.schema(list(zip(names, [pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), pa.int64()])))
        ids: list = []
        lengths: list[int] = []
        sizes: list[int] = []
        terms: list[int] = []
        counts: list[int] = []

        def row() -> pa.RecordBatch:
            found = np.array(terms, dtype=np.uint32)
            held, held_by = np.unique(found, return_counts=True)
            values = [
                ids, pack(np.array(lengths, dtype=np.int64)), pack(np.array(sizes, dtype=np.uint32)), pack(found),
                pack(np.array(counts, dtype=np.uint32)), np.stack([held, held_by]).astype(np.int64).tobytes(), len(ids), sum(lengths),
            ]
            return pa.RecordBatch.from_arrays([pa.array([x], field.type) for x, field in zip(values, schema)], schema=schema)

        for batch in row_slices(batches, 64):
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                words = terms_of(text)
                if not words:
                    continue
                own = Counter(number for word in words if (number := known.get(word)) is not None)
                ids.append(doc_id)
                lengths.append(len(words))
                sizes.append(len(own))
                terms.extend(own.keys())
                counts.extend(own.values())
                if len(ids) >= ROW_DOCUMENTS or len(terms) >= ROW_COUNTS:
                    yield row()
                    ids, lengths, sizes, terms, counts = [], [], [], [], []
        if ids:
            yield row()

    return docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(count, _COUNTED)


def _document_counts(counted: DataFrame, n_numbers: int) -> np.ndarray:
    """How many documents hold each term of the block, added up by Spark; a row per term comes back."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros(n_numbers, dtype=np.int64)
            for packed in batch.column(0).to_pylist():
                terms, n = np.frombuffer(packed, dtype=np.int64).reshape(2, -1)
                sums[terms] += n
            found = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], ["term", "n"])

    sums = np.zeros(n_numbers, dtype=np.int64)
    for row in counted.select("held").mapInArrow(held, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        sums[row.term] = row.n
    return sums


def weights(n_docs: int, held_by: np.ndarray) -> np.ndarray:
    return np.array([math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held_by], dtype=np.int64)


class Heaps:
    """For each item its ``k`` best documents, the worst one on top."""

    def __init__(self, n_items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n_items)]
        self.least = np.zeros(n_items, dtype=np.int64)  # a score must be above this, or equal with an id below the next
        self.worst = np.full(n_items, -NO_ID, dtype=np.int64)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of some documents, a row each, for all items."""
        better = (scores > self.least) | ((scores == self.least) & (ids[:, None] < self.worst))
        for doc, item in zip(*np.nonzero(better)):
            heap, entry = self.heaps[item], (int(scores[doc, item]), -int(ids[doc]))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[item], self.worst[item] = heap[0][0], -heap[0][1]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for item, heap in enumerate(self.heaps):
            for score, negative_id in heap:
                yield item, -negative_id, score


def _sums(cells: np.ndarray, values: np.ndarray, n_cells: int) -> np.ndarray:
    """Integer sums per cell: in two halves, as numpy adds up doubles, which are exact below 2^53."""
    low = np.bincount(cells, weights=(values & 0xFFFFFFFF).astype(float), minlength=n_cells)
    high = np.bincount(cells, weights=(values >> 32).astype(float), minlength=n_cells)
    return low.astype(np.int64) + (high.astype(np.int64) << 32)


def _scores(index: Index, weight: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of some documents, a row each, for all items: each count goes to the items that hold its term."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    gain = weight[terms] * ((SCALE * tf) // (TERM_SCALE * tf + SATURATION * m[doc]))
    holders = index.starts[terms + 1] - index.starts[terms]
    ends = np.cumsum(holders)
    place = np.repeat(index.starts[terms] - (ends - holders), holders) + np.arange(ends[-1] if len(ends) else 0)
    cells = np.repeat(doc * index.n_items, holders) + index.items[place]
    sums = _sums(cells, np.repeat(gain, holders) * index.repeats[place], len(sizes) * index.n_items)
    return sums.reshape(len(sizes), index.n_items)


def _heaps(counted: DataFrame, index, weight, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Each task's best documents of each item: ``item, doc_id, score``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weigh = index.value, weight.value
        heaps = Heaps(own.n_items, k)
        for batch in row_slices(batches, 1):
            ids = np.array([NO_ID if x is None else x for x in batch.column(0)[0].as_py()], dtype=np.int64)
            lengths = unpack(batch.column(1)[0].as_py(), np.int64)
            sizes, terms, counts = (unpack(batch.column(i)[0].as_py(), np.uint32).astype(np.int64) for i in (2, 3, 4))
            # in Python's integers, as 25 * n * N can pass 64 bits
            m = np.array([100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * n_docs) // n_terms for n in lengths.tolist()], dtype=np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for low in range(0, len(ids), SLICE):
                high = min(low + SLICE, len(ids))
                part = slice(starts[low], starts[high])
                heaps.offer(ids[low:high], _scores(own, weigh, sizes[low:high], terms[part], counts[part], m[low:high]))
        found = list(heaps.rows())
        columns = [pa.array([row[i] for row in found], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    packed = counted.select("ids", "lengths", "sizes", "terms", "counts")
    return packed.mapInArrow(score, "item bigint, doc_id bigint, score bigint")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``k`` best documents."""
    spark = docs.sparkSession
    kind = items.select(item_col).schema[0].dataType
    schema = f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint"
    ranking = None
    for ids, index in item_blocks(items, item_col, item_text_col, block_bytes):
        numbers = spark.sparkContext.broadcast(index.numbers)
        counted = materialise(_counted(docs, numbers, id_col, text_col), "term-counts")
        total = counted.agg(F.sum("with_terms").alias("docs"), F.sum("n_terms").alias("terms")).first()
        if total.docs is None:
            continue
        weight = spark.sparkContext.broadcast(weights(total.docs, _document_counts(counted, len(index.numbers))))
        shared = spark.sparkContext.broadcast(index)
        best = _heaps(counted, shared, weight, total.docs, total.terms, k)
        order = W.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = spark.createDataFrame(list(enumerate(ids)), f"item bigint, item_id {kind.simpleString()}")
        merged = best.join(F.broadcast(named), "item").select(
            "item_id", "rank", F.nullif("doc_id", F.lit(int(NO_ID))).alias("doc_id"), "score"
        )
        merged = materialise(merged, "ranking")  # at most k rows an item; frees the block's index
        for held in (numbers, weight, shared):
            held.unpersist()
        ranking = merged if ranking is None else ranking.unionAll(merged)
    return spark.createDataFrame([], schema) if ranking is None else ranking


def op13_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = """
WITH terms AS (
    SELECT row_id, doc_id, unnest(terms) AS term
    FROM (
        SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[0-9a-z\\x{80}-\\x{10FFFF}]+'
        ) AS terms
        FROM documents
    )
), item_terms AS (
    SELECT item_row, item_id, term, count(*) AS repeats
    FROM (
        SELECT row_number() OVER () AS item_row, item_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[0-9a-z\\x{80}-\\x{10FFFF}]+'
        )) AS term
        FROM benchmark
    )
    GROUP BY ALL
), lengths AS (
    SELECT row_id, any_value(doc_id) AS doc_id, count(*) AS n FROM terms GROUP BY row_id
), corpus AS (
    SELECT count(*) AS n_docs, sum(n)::HUGEINT AS n_terms FROM lengths
), measured AS (
    SELECT row_id, doc_id, 75 + (25 * n::HUGEINT * n_docs) // n_terms AS m FROM lengths, corpus
), counts AS (
    SELECT row_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL
), weighed AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM counts, corpus GROUP BY term, n_docs
), scored AS (
    SELECT item_row, item_id, row_id, doc_id,
        sum(repeats * w * ((1000000000 * tf)::HUGEINT // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM item_terms JOIN counts USING (term) JOIN weighed USING (term) JOIN measured USING (row_id)
    GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 20
"""
