"""Best-fit packing of documents into sequences of fixed capacity, under conflicts.

No sequence holds two pieces of one source or of one cluster of duplicates: of near copies by their fingerprints in ``op1_best_fit``, of equal
texts where none are given, as in the pipeline, in which one of each group of near copies is left. Open bins are kept in order of the
space they have left, and carry a bitmap of their sources and clusters. A piece goes to the tightest bin that
fits and has none of its bits: a search tree over the space left holds in each node the bits that all bins below
share, so the successor search passes over subtrees in which every bin conflicts, and goes on
until it finds the tightest compatible bin; ties go to the oldest. Pieces come in falling size.

Rows are dealt by a hash of their own, not by source or cluster, into groups of about ``SHARD_ROWS``, each packed in
one task; a source or cluster with a third of all rows is a third of each group. Groups share no bins, which costs a few
part-filled bins for each group.

A document has a token per word and one for its end. One that exceeds the capacity is cut into full pieces and a rest;
nothing is dropped. As each piece of a hot source needs a bin of its own, that source's pieces are the least
possible number of bins.

Defined results: null and empty texts have one token; a null source or cluster conflicts with nothing; repeated rows are packed
each (and conflict, having the same text); ties are ordered by id, then text; an empty table gives an empty
result. Only the named columns are looked at.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmetrics.llm.common import ascii_lower, join_counted, table, text_key
from trailmetrics.llm.simhash import grouped_by_fingerprint
from trailmetrics.session import materialise

CAPACITY = 2_048
SHARD_ROWS = 4_096
_SPACE = r"[\x09-\x0D\x20]+"


class OpenBins:
    """Bins by the space they have left, each with the bitmap of what it holds."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.shared = [-1] * (2 * self.size)  # bits that all bins below have; all of them where there is none
        self.at: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]

    def _update(self, space: int) -> None:
        bits = -1
        for bitmap in self.at[space]:
            bits &= bitmap
        node = space + self.size
        while self.shared[node] != bits:
            self.shared[node] = bits
            node >>= 1
            if not node:
                break
            bits = self.shared[2 * node] & self.shared[2 * node + 1]

    def add(self, space: int, bitmap: int, number: int) -> None:
        heappush(self.at[space].setdefault(bitmap, []), number)
        self._update(space)

    def take(self, need: int, bits: int) -> tuple[int, int, int] | None:
        """Removes the tightest bin with at least ``need`` space and none of ``bits``: space, bitmap, number."""
        bits |= 1  # no bin has bit 0, but the mark of an empty subtree has
        stack = [(1, 0, self.size)]
        while stack:
            node, low, width = stack.pop()
            if low + width <= need or self.shared[node] & bits:
                continue
            if width > 1:
                half = width // 2
                stack += [(2 * node + 1, low + half, half), (2 * node, low, half)]
                continue
            fitting = [(numbers[0], bitmap) for bitmap, numbers in self.at[low].items() if not bitmap & bits]
            if fitting:
                number, bitmap = min(fitting)
                numbers = self.at[low][bitmap]
                heappop(numbers)
                if not numbers:
                    del self.at[low][bitmap]
                self._update(low)
                return low, bitmap, number
        return None


def pack(sizes: list[int], bits: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, in the order given; ``bits`` from bit 1 on."""
    bins, offsets, open_bins, n = [], [], OpenBins(capacity), 0
    for size, own in zip(sizes, bits):
        found = open_bins.take(size, own)
        if found is None:
            found, n = (capacity, 0, n), n + 1
        space, bitmap, number = found
        bins.append(number)
        offsets.append(capacity - space)
        if space > size:
            open_bins.add(space - size, bitmap | own, number)
    return bins, offsets


def _bits(*columns: pa.ChunkedArray) -> list[int]:
    """A bit for each value that a column holds twice or more; a value met once conflicts with nothing."""
    out, next_bit = [0] * len(columns[0]), 1
    for column in columns:
        values = column.combine_chunks().dictionary_encode()
        codes = values.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        counts = np.bincount(codes[codes >= 0], minlength=len(values.dictionary))
        bit_of = {}
        for code in np.flatnonzero(counts > 1):
            bit_of[code], next_bit = 1 << next_bit, next_bit + 1
        out = [bits | bit_of.get(code, 0) for bits, code in zip(out, codes)]
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key_a, key_b, cluster`` of every text: near-duplicates by their fingerprints share a cluster."""
    rows, firsts = grouped_by_fingerprint(docs, id_col, text_col)
    own = join_counted(rows.select("key_a", "key_b", "fp").distinct(), firsts, ["fp"], "inner")
    first = F.col("first")
    return materialise(
        own.select("key_a", "key_b", F.xxhash64(first["doc_id"], first["key_a"], first["key_b"]).alias("cluster")), "clusters"
    )


def pieces(docs: DataFrame, id_col: str, text_col: str, source_col: str, clusters: DataFrame | None, capacity: int) -> DataFrame:
    """``doc_id, piece, tokens, source, cluster`` of every piece of at most ``capacity`` tokens."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(ascii_lower(text) if clusters is None else text, _SPACE), "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("words"), *text_key(text))
    same_text = F.xxhash64(F.array_join("words", " "))
    rows = rows.select("doc_id", "source", *([same_text.alias("cluster")] if clusters is None else ["key_a", "key_b"]), (F.size("words") + 1).alias("total"))
    if clusters is not None:
        rows = join_counted(rows, clusters, ["key_a", "key_b"], "left").drop("key_a", "key_b")
    last = F.floor((F.col("total") - 1) / capacity).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    tokens = F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("int")
    return rows.select("doc_id", "piece", tokens.alias("tokens"), "source", "cluster")


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", clusters: DataFrame | None = None, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``doc_id, piece, tokens, shard, bin, bin_offset``: where each piece of each document lies.

    ``clusters`` names the cluster of each text, as ``near_copies`` does; without it, equal texts are a cluster.
    """
    rows = materialise(pieces(docs, id_col, text_col, source_col, clusters, capacity), "pieces")
    n_shards = max(1, -(-rows.count() // shard_rows))
    own = F.xxhash64("doc_id", "piece", "cluster", F.monotonically_increasing_id())
    dealt = rows.withColumn("shard", F.pmod(own, F.lit(n_shards)).cast("int"))

    def fill(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending")])
        bins, offsets = pack(shard["tokens"].to_pylist(), _bits(shard["source"], shard["cluster"]), capacity)
        kept = shard.select(["doc_id", "piece", "tokens", "shard"])
        return kept.append_column("bin", pa.array(bins, pa.int32())).append_column("bin_offset", pa.array(offsets, pa.int32()))

    kind = docs.schema[id_col].dataType.simpleString()
    return dealt.groupBy("shard").applyInArrow(fill, f"doc_id {kind}, piece int, tokens int, shard int, bin int, bin_offset int")


def op1_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, clusters=near_copies(docs))
