"""Exact substring dedup: suffix arrays by two-stage sorting over the places that can repeat.

A byte goes if a string of ``SPAN`` bytes that covers it also starts earlier: in a document of smaller id, or earlier in
its own. Only the first of equal texts is searched; later ones repeat it wholly.

Every string of ``SPAN`` bytes owns an anchor, the place within it whose ``GRAM`` bytes hash lowest; equal strings
have equal anchors at the same place. Neighbouring strings that own the same anchor form a unit, and the bytes they
cover its context, some 140 on average. Blocks of texts report for each anchor the hashes of its contexts, as sorted
compressed runs by range of anchors, and learn for each unit which of three things holds: an equal context comes earlier,
so all of it repeats; the anchor has no other context, so nothing does; or contexts differ, so parts may.

Contexts of the third kind are gathered by anchor. A suffix array over them is built in two stages: only suffixes smaller
than their successors are sorted directly, all others follow from a scan through the buckets of first bytes. Neighbours in
it that share ``SPAN`` bytes are equal strings, of which the earliest stays. An anchor with more than ``HOT_CONTEXTS``
different contexts is not gathered: its strings are grouped one by one by 128 bits of hashes, which Spark combines before it shuffles.

Matches are exact but for collisions of hashes (64 bits for whole contexts of one anchor, 128 for strings).

Defined results: a null text is empty; ids are whole numbers, a null one comes after all others; of rows that share an id but not the
text the order is arbitrary, but fixed; rows that share both are one document and get the same result each; texts under ``SPAN`` bytes
lose nothing; an empty table gives an empty result. Only the named columns are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmetrics.llm.common import join_counted, row_slices, table, text_bytes, text_key
from trailmetrics.llm.packed import pack, unpack
from trailmetrics.session import materialise

SPAN = 100
GRAM = 20
HOT_CONTEXTS = 2_048
BLOCK_BYTES = 4 << 20
STRETCH = 1 << 20
SHARD_BYTES = 1 << 18
LEAST_RANGES = 32
#: No byte of UTF-8.
SEPARATOR = 0xFF
LAST = (1 << 63) - 1
KEY = ["key_a", "key_b"]
NOTHING, REPEATED, MIXED, HOT = range(4)


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that starts a byte later; the last is not."""
    rise = np.sign(np.diff(text.astype(np.int16)))
    place = np.where(rise != 0, np.arange(len(rise)), len(rise))
    next_change = np.minimum.accumulate(place[::-1])[::-1]
    return np.append(np.append(rise, -1)[next_change] > 0, False)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes, ordered by at least their first ``depth`` bytes, by two-stage sorting."""
    n = len(text)
    if not n:
        return np.empty(0, dtype=np.int64)
    direct = smaller_than_next(text)
    padded = np.concatenate([text, np.zeros(depth, dtype=np.uint8)])  # the end is smaller than any byte
    places = np.flatnonzero(direct)
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[places]
    ordered = places[np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")]

    counts = np.bincount(text, minlength=256)
    ends = np.cumsum(counts)
    array = np.full(n, -1, dtype=np.int64)
    own = np.bincount(text[ordered], minlength=256)  # within a bucket, these come after all others
    array[np.arange(len(ordered)) + np.repeat(ends - own - np.cumsum(own) + own, own)] = ordered
    result, heads = array.tolist(), (ends - counts).tolist()
    first, induced = text.tolist(), (~direct).tolist()
    result[heads[first[-1]]] = n - 1
    heads[first[-1]] += 1
    for i in range(n):
        j = result[i] - 1
        if j >= 0 and induced[j]:
            symbol = first[j]
            result[heads[symbol]] = j
            heads[symbol] += 1
    return np.array(result)


def common_prefixes(text: np.ndarray, array: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix of the array shares with the one before it, counted up to ``depth``."""
    padded = np.concatenate([text, np.full(depth, SEPARATOR, dtype=np.uint8)])
    shared = np.zeros(len(array), dtype=np.int64)
    at = np.arange(1, len(array))
    for step in range(depth):
        at = at[padded[array[at] + step] == padded[array[at - 1] + step]]
        shared[at] += 1
    return shared


def repeated_starts(contexts: list[bytes], docs: np.ndarray, starts: np.ndarray, span: int) -> list[np.ndarray]:
    """For each context, the places in it where a string of ``span`` bytes starts that also starts earlier."""
    sizes = np.array([len(context) for context in contexts])
    text = np.frombuffer(bytes([SEPARATOR]).join(contexts), dtype=np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    array = suffix_array(text, span)
    group = np.cumsum(common_prefixes(text, array, span) < span)
    unit = np.searchsorted(begins, array, side="right") - 1
    inside = array - begins[unit]
    whole = np.flatnonzero(inside + span <= sizes[unit])
    group, unit, inside = group[whole], unit[whole], inside[whole]
    order = np.lexsort((starts[unit] + inside, docs[unit], group))
    later = order[1:][group[order[1:]] == group[order[:-1]]]
    out: list[np.ndarray] = [np.empty(0, dtype=np.int64) for _ in contexts]
    by_unit = later[np.lexsort((inside[later], unit[later]))]
    for rows in np.split(by_unit, np.flatnonzero(np.diff(unit[by_unit])) + 1):
        if len(rows):
            out[unit[rows[0]]] = inside[rows]
    return out


def _words(data: np.ndarray, at: int, n: int) -> np.ndarray:
    """The eight bytes from ``at + i`` on as a number, for i below ``n``."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)[at : at + n].copy().view(np.uint64).ravel()


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Least hashes, which are all small, spread evenly over 64 bits again; no two become one."""
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return hashes ^ (hashes >> np.uint64(29))


def anchors(data: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last start of each unit of a text; a unit ends where a stretch does."""
    found: list[tuple] = []
    for low in range(0, len(data) - span + 1, STRETCH):
        n = min(STRETCH, len(data) - span + 1 - low)
        grams = n + span - gram
        a, b, c = (_words(data, low + shift, grams) for shift in (0, 8, gram - 8))
        a *= np.uint64(0x9E3779B97F4A7C15)
        a ^= a >> np.uint64(31)
        a += b
        a *= np.uint64(0xD6E8FEB86659FD93)
        a ^= a >> np.uint64(32)
        a += c
        a *= np.uint64(0xA0761D6478BD642F)
        a ^= a >> np.uint64(29)
        low_bits = np.uint64((1 << 22) - 1)
        least, reach, window = (a & ~low_bits) | np.arange(grams, dtype=np.uint64), 1, span - gram + 1
        while reach < window:
            step = min(reach, window - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        place = (least & low_bits).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        found.append((remixed(a[place[first]]), first + low, np.append(first[1:], n) - 1 + low))
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    return tuple(np.concatenate(parts) for parts in zip(*found))


class Units:
    """The units of a block's texts; ``entry`` numbers the distinct pairs of anchor and context."""

    def __init__(self, row: dict, span: int, gram: int) -> None:
        raw = zstandard.ZstdDecompressor().decompress(row["texts"]) if row["texts"] else b""
        self.orders = np.frombuffer(row["orders"], dtype=np.int64)
        self.keys = np.frombuffer(row["keys"], dtype=np.int64).reshape(-1, 2)
        ends = np.cumsum(np.frombuffer(row["sizes"], dtype=np.int64))
        self.texts = [raw[end - size : end] for end, size in zip(ends, np.frombuffer(row["sizes"], dtype=np.int64))]
        parts = [anchors(np.frombuffer(text, dtype=np.uint8), span, gram) for text in self.texts]
        self.doc = np.repeat(np.arange(len(parts)), [len(part[0]) for part in parts])
        self.anchor, self.first, self.last = (np.concatenate(columns) for columns in zip(*parts))
        digest, texts = xxhash.xxh64_intdigest, self.texts
        places = zip(self.doc.tolist(), self.first.tolist(), (self.last + span).tolist())
        self.context = np.fromiter((digest(texts[d][a:b]) for d, a, b in places), dtype=np.uint64, count=len(self.doc))
        order = np.lexsort((self.first, self.orders[self.doc], self.context, self.anchor))
        anchor, context = self.anchor[order], self.context[order]
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])) if len(order) else np.empty(0, bool)
        self.entries = order[new]
        self.leads = np.zeros(len(order), dtype=bool)
        self.leads[self.entries] = True

    def cuts(self, bits: int) -> np.ndarray:
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        return np.append(np.searchsorted(self.anchor[self.entries], edges), len(self.entries))


def blocks_of(texts: DataFrame, block_bytes: int) -> DataFrame:
    """``block, orders, keys, sizes, texts`` from ``doc_order, key_a, key_b, text``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def block() -> pa.RecordBatch:
            squeezed = zstandard.ZstdCompressor(level=3).compress(b"".join(row[3] for row in rows))
            columns = [
                np.array([row[0] for row in rows], dtype=np.int64).tobytes(),
                np.array([row[1:3] for row in rows], dtype=np.int64).tobytes(),
                np.array([len(row[3]) for row in rows], dtype=np.int64).tobytes(), squeezed,
            ]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["orders", "keys", "sizes", "texts"])

        size = 0
        for batch in row_slices(batches, 64):
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), text_bytes(batch.column(3))):
                rows.append(row)
                size += len(row[3])
                if size >= block_bytes:
                    yield block()
                    rows, size = [], 0
        if rows:
            yield block()

    cut_up = texts.mapInArrow(cut, "orders binary, keys binary, sizes binary, texts binary")
    return materialise(cut_up.withColumn("block", F.monotonically_increasing_id()), "text-blocks")


def first_rows(rows: DataFrame, order: str) -> DataFrame:
    """``key_a, key_b``, the least ``order`` of each text, and the ``times`` that rows share both."""
    each = rows.groupBy(*KEY, order).agg(F.count("*").alias("times"))
    return each.groupBy(*KEY).agg(F.min(F.struct(order, "times")).alias("first")).select(*KEY, "first.*")


def once(texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """``texts`` without repeated rows; they are only shuffled if there are any."""
    return texts.dropDuplicates(["doc_order", *KEY]) if firsts.where("times > 1").limit(1).count() else texts


def _verdicts(reports: pa.Table, hot: int) -> pa.Table:
    """Of each entry of one range of anchors, whether its context repeats, is alone, or meets others."""
    columns = [
        np.concatenate([unpack(x.as_py(), kind, step) for x in reports[name]])
        for name, kind, step in (("anchors", np.uint64, True), ("contexts", np.uint64, False), ("docs", np.int64, False))
    ]
    sizes = [row.as_py() for row in reports["n"]]
    anchor, context, doc = columns
    order = np.lexsort((np.repeat(reports["block"].to_numpy(), sizes), doc, context, anchor))
    anchor, context = anchor[order], context[order]
    new_anchor = np.append(True, anchor[1:] != anchor[:-1])
    new = new_anchor | np.append(True, context[1:] != context[:-1])
    group = np.cumsum(new_anchor) - 1
    kinds = np.bincount(group, weights=new)[group]
    verdict = np.select([~new, kinds == 1, kinds <= hot], [REPEATED, NOTHING, MIXED], HOT).astype(np.uint8)
    back = np.empty_like(verdict)
    back[order] = verdict
    packed = [pack(part) for part in np.split(back, np.cumsum(sizes)[:-1])]
    return pa.table({"block": reports["block"], "part": reports["part"], "verdicts": pa.array(packed, pa.binary())})


_UNIT = "key_a long, key_b long, doc_order long, start long, end long, anchor long, hot boolean, context binary"


def units(texts: DataFrame, span: int, gram: int, block_bytes: int, hot: int) -> DataFrame:
    """A stored table: the repeated stretches of texts (no context), and the units whose anchor has other contexts."""
    blocks = blocks_of(texts, block_bytes)
    bits = max(LEAST_RANGES, blocks.count() // 16).bit_length()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 1):
            row = batch.to_pylist()[0]
            found = Units(row, span, gram)
            cuts, out = found.cuts(bits), []
            for part, (low, high) in enumerate(zip(cuts, cuts[1:])):
                own = found.entries[low:high]
                if len(own):
                    docs = found.orders[found.doc[own]]
                    out.append({"part": part, "block": row["block"], "n": len(own), "anchors": pack(found.anchor[own], True), "contexts": pack(found.context[own]), "docs": pack(docs)})
            yield pa.RecordBatch.from_pylist(out, schema=reported)

    reported = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("anchors", pa.binary()), ("contexts", pa.binary()), ("docs", pa.binary())])
    reports = blocks.mapInArrow(report, "part int, block long, n int, anchors binary, contexts binary, docs binary")
    verdicts = reports.groupBy("part").applyInArrow(lambda t: _verdicts(t, hot), "block long, part int, verdicts binary")

    def resolve(block: pa.Table, told: pa.Table) -> pa.Table:
        found = Units(block.to_pylist()[0], span, gram)
        parts = sorted(zip(told["part"].to_pylist(), told["verdicts"].to_pylist()))
        verdict = np.full(len(found.doc), REPEATED, dtype=np.uint8)
        if parts:
            verdict[found.entries] = np.concatenate([unpack(packed, np.uint8) for _, packed in parts])
        gone = np.flatnonzero(verdict == REPEATED)
        joined = np.append(True, (np.diff(found.doc[gone]) != 0) | (found.first[gone][1:] > found.last[gone][:-1] + span))[: len(gone)]
        heads = np.flatnonzero(joined)
        tails = np.append(heads[1:], len(gone)) - 1 if len(heads) else heads
        mixed = np.flatnonzero(verdict >= MIXED)
        doc = np.concatenate([found.doc[gone[heads]], found.doc[mixed]])
        first = np.concatenate([found.first[gone[heads]], found.first[mixed]])
        end = np.concatenate([found.last[gone[tails]], found.last[mixed]]) + span
        contexts = [None] * len(heads) + [found.texts[d][a:b] for d, a, b in zip(found.doc[mixed].tolist(), found.first[mixed].tolist(), (found.last[mixed] + span).tolist())]
        anchor = np.concatenate([np.zeros(len(heads), np.int64), found.anchor[mixed].view(np.int64)])
        is_hot = np.concatenate([np.zeros(len(heads), bool), verdict[mixed] == HOT])
        return pa.table({
            "key_a": found.keys[doc, 0], "key_b": found.keys[doc, 1], "doc_order": found.orders[doc], "start": first, "end": end,
            "anchor": anchor, "hot": is_hot, "context": pa.array(contexts, pa.binary()),
        })

    together = blocks.groupBy("block").cogroup(materialise(verdicts, "verdicts").groupBy("block"))
    return materialise(together.applyInArrow(resolve, _UNIT), "units")


def _runs(starts: np.ndarray, span: int) -> Iterator[tuple[int, int]]:
    """Stretches that the strings at ascending ``starts`` cover."""
    for part in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
        if len(part):
            yield int(part[0]), int(part[-1]) + span


def repeated_stretches(found: DataFrame, span: int) -> DataFrame:
    """``key_a, key_b, start, end`` of all that repeats, by the suffix arrays of mixed units and the strings of hot ones."""
    stretch = [*KEY, "start", "end"]
    mixed = found.where("context IS NOT NULL AND NOT hot")
    size = mixed.agg(F.coalesce(F.sum(F.length("context")), F.lit(0))).first()[0]
    shards = max(128, -(-size // SHARD_BYTES))

    def search(shard: pa.Table) -> pa.Table:
        starts = shard["start"].to_numpy()
        gone = repeated_starts(shard["context"].to_pylist(), shard["doc_order"].to_numpy(), starts, span)
        rows = [(i, start + a, start + b) for i, (start, inside) in enumerate(zip(starts.tolist(), gone)) for a, b in _runs(inside, span)]
        unit, first, end = (np.array(column, dtype=np.int64) for column in (zip(*rows) if rows else ([], [], [])))
        return pa.table({"key_a": shard["key_a"].to_numpy()[unit], "key_b": shard["key_b"].to_numpy()[unit], "start": first, "end": end})

    dealt = mixed.withColumn("shard", F.pmod("anchor", F.lit(shards))).select("shard", *KEY, "doc_order", "start", "context")
    by_array = dealt.groupBy("shard").applyInArrow(search, "key_a long, key_b long, start long, end long")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 256):
            key_a, key_b, order, starts, contexts = (batch.column(i).to_pylist() for i in range(5))
            rows = [
                (a, b, o, s + i, *(int.from_bytes(xxhash.xxh64_digest(c[i : i + span], seed), "big", signed=True) for seed in (1, 2)))
                for a, b, o, s, c in zip(key_a, key_b, order, starts, contexts) for i in range(len(c) - span + 1)
            ]
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [*KEY, "doc_order", "start", "hash_a", "hash_b"])

    hot = found.where("context IS NOT NULL AND hot").select(*KEY, "doc_order", "start", "context")
    out = found.where("context IS NULL").select(*stretch).unionAll(by_array)
    if not hot.limit(1).count():
        return out
    each = hot.mapInArrow(strings, "key_a long, key_b long, doc_order long, start long, hash_a long, hash_b long")
    each = materialise(each, "strings")
    order = F.struct("doc_order", "start", *KEY)
    firsts = each.groupBy("hash_a", "hash_b").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    both = join_counted(each, materialise(firsts, "first-strings"), ["hash_a", "hash_b"], "inner")
    return out.unionAll(both.where(order != F.col("first")).select(*KEY, "start", (F.col("start") + span).alias("end")))


def remove_repeats(
    docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES, hot: int = HOT_CONTEXTS,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` with the bytes that stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    rows = docs.select(F.col(id_col).alias("doc_id"), order.alias("doc_order"), *text_key(text), text.alias("text"))
    firsts = materialise(first_rows(rows, "doc_order"), "firsts")
    long = rows.where(F.octet_length("text") >= span).select("doc_order", *KEY, "text")
    searched = join_counted(long, firsts, [*KEY, "doc_order"], "left_semi").select("doc_order", *KEY, "text")
    searched = once(searched, firsts)
    stretches = materialise(repeated_stretches(units(searched, span, gram, block_bytes, hot), span), "stretches")

    along = W.partitionBy(*KEY).orderBy("start", "end")
    reached = F.max("end").over(along.rowsBetween(W.unboundedPreceding, -1))
    merged = stretches.withColumn("new", (reached.isNull() | (F.col("start") > reached)).cast("int"))
    merged = merged.withColumn("island", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    merged = merged.groupBy(*KEY, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    gone = merged.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone"))
    known = join_counted(rows, firsts.select(*KEY, F.col("doc_order").alias("first")), KEY, "inner")
    known = join_counted(known, materialise(gone, "gone"), KEY, "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 128):
            out: list[tuple] = []
            for whole, later, spans in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                cuts = [(s["start"], s["end"]) for s in spans or ()]
                if later:
                    cuts = [(0, len(whole))] if len(whole) >= span else []
                ends = [0, *(end for _, end in cuts)]
                kept = b"".join(whole[a:b] for a, b in zip(ends, [*(start for start, _ in cuts), len(whole)]))
                out.append((len(whole), len(whole) - len(kept), len(cuts), kept))
            n_bytes, n_removed, n_spans, kept = zip(*out)
            columns = [pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    ready = known.select("doc_id", "text", (F.col("doc_order") > F.col("first")).alias("later"), "gone")
    return ready.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
