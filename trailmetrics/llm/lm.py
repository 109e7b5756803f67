"""Language-model scores from a weighted backoff automaton of word bigrams.

States are the words seen in training and a root; the end of a text is a word like any other, and its state is
also where a text starts. A state has an arc for each word seen after it and a failure arc to the root, which
has an arc for every word. With c counts, T(h) = c(h)^beta the expected number of kinds of words after h, and
base(w) the add-``ALPHA`` unigram probability, arcs weigh

    seen pair     (c(h, w) + T(h) * base(w)) / (c(h) + T(h))
    failure arc   T(h) / (c(h) + T(h)), then base(w) from the root

which sums to one over all words and one unknown word for each h (Witten and Bell's smoothing, with kinds by Heaps'
law). beta is the one value with which the T(h) add up to the number of different pairs in training.

Work is cut into blocks of about ``BLOCK_TOKENS`` tokens, stored once as word numbers. A block sends the distinct words
and pairs it holds, with its own training counts, as sorted, compressed runs of 64-bit hashes to the
part of the key range they belong to. There counts are added up over all blocks and sent back for the keys that
the block asked for. With these the block has every state and arc its texts can reach, and walks each text once from left to
right. No table of counts is broadcast or collected; the driver sees sums. What is gathered is one
run per block and range of keys, so a word that fills a third of all texts is one key per block.

Counts are exact but for collisions of 64-bit hashes.

Defined results: a null text is an empty one, whose only token is the end; a null id counts as an empty text when
the training fold is chosen; repeated rows count and are scored each; without training rows each probability is
that of the one unknown word, 1. Only the named columns are looked at, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmetrics.llm.common import digest_bucket, row_slices, table, text_bytes, words_of
from trailmetrics.llm.packed import pack as _pack
from trailmetrics.llm.packed import unpack as _unpack
from trailmetrics.session import materialise

ALPHA = 0.1
FOLDS = 10
BLOCK_TOKENS = 1 << 20
LEAST_RANGES = 32
BETAS = np.linspace(0.0, 1.0, 65)
WORD, PAIR = 0, 1


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def blocks_of(docs: DataFrame, id_col: str, text_col: str, held_out: Column, tokens: int) -> DataFrame:
    """``block, doc_ids, held, lengths, words, numbers``: texts as numbers of the block's own words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, parts, lengths, ids, held = _Numbers({b"\n": 0}), [], [], [], []

        def block() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), dtype=np.uint64, count=len(numbers))
            found = np.concatenate(parts)
            columns = [
                pa.array([ids], pa.list_(pa_type)), pa.array([held], pa.list_(pa.bool_())),
                pa.array([np.array(lengths, dtype=np.uint32).tobytes()], pa.binary()),
                pa.array([hashes.tobytes()], pa.binary()), pa.array([_pack(found, False)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_ids", "held", "lengths", "words", "numbers"])

        size = 0
        for batch in row_slices(batches, 64):
            pa_type = batch.schema.field(0).type
            for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                words = words_of(text)
                words.append(b"\n")
                parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.uint32, count=len(words)))
                lengths.append(len(words))
                ids.append(doc_id)
                held.append(out)
                size += len(words)
                if size >= tokens:
                    yield block()
                    numbers, parts, lengths, ids, held, size = _Numbers({b"\n": 0}), [], [], [], [], 0
        if parts:
            yield block()

    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("held", T.ArrayType(T.BooleanType()))])
    for name in ("lengths", "words", "numbers"):
        schema.add(name, T.BinaryType())
    # a number per block, drawn once and stored with it, so that a repeated task cannot change it
    return materialise(rows.mapInArrow(cut, schema).withColumn("block", F.monotonically_increasing_id()), "blocks")


@dataclass
class _Block:
    """A block's tokens as rows of its words, each with the word before it, and the pairs' keys."""

    lengths: np.ndarray
    words: np.ndarray
    token: np.ndarray
    before: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray

    @classmethod
    def read(cls, lengths: bytes, words: bytes, numbers: bytes) -> _Block:
        known = np.frombuffer(words, dtype=np.uint64)
        order = np.argsort(known)
        row = np.empty(len(known), dtype=np.int64)
        row[order] = np.arange(len(known))
        token = row[_unpack(numbers, np.uint32, False)]
        before = np.concatenate([row[:1], token[:-1]])  # number 0 is the end, and every text follows an end
        known = known[order]
        mixed = known[before] * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) + known[token]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        pairs, pair = np.unique(mixed ^ (mixed >> np.uint64(32)), return_inverse=True)
        return cls(np.frombuffer(lengths, dtype=np.uint32).astype(np.int64), known, token, before, pairs, pair)

    def keys(self, kind: int) -> np.ndarray:
        return self.pairs if kind == PAIR else self.words

    def cuts(self, kind: int, bits: int) -> np.ndarray:
        """Where each of the 2**bits ranges of keys begins and ends."""
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        keys = self.keys(kind)
        return np.append(np.searchsorted(keys, edges), len(keys))


def _requests(blocks: DataFrame, bits: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 1):
            row = batch.to_pylist()[0]
            block = _Block.read(row["lengths"], row["words"], row["numbers"])
            taught = np.repeat(~np.array(row["held"], dtype=bool), block.lengths)
            out: list[tuple] = []
            for kind, found in ((WORD, block.token), (PAIR, block.pair)):
                keys, cuts = block.keys(kind), block.cuts(kind, bits)
                counts = np.bincount(found[taught], minlength=len(keys)).astype(np.uint32)
                for part, (low, high) in enumerate(zip(cuts, cuts[1:])):
                    if low < high:
                        out.append((kind, part, row["block"], _pack(keys[low:high], True), _pack(counts[low:high], False)))
            yield pa.RecordBatch.from_pylist([dict(zip(("kind", "part", "block", "keys", "counts"), x)) for x in out], schema=asked)

    asked = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    return blocks.drop("doc_ids").mapInArrow(ask, "kind int, part int, block long, keys binary, counts binary")


def _answer(requests: pa.Table) -> pa.Table:
    """Adds up one range of keys over all blocks; for each block the totals of its keys, and sums once."""
    keys = [_unpack(x.as_py(), np.uint64, True) for x in requests["keys"]]
    counts = [_unpack(x.as_py(), np.uint32, False) for x in requests["counts"]]
    known, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(place, weights=np.concatenate(counts), minlength=len(known)).astype(np.uint64)
    ends = np.cumsum([len(x) for x in keys])
    answers = [_pack(totals[rows], False) for rows in np.split(place, ends[:-1])]
    taught = totals[totals > 0].astype(float)
    sums = [float(len(taught)), float(taught.sum()), *(float((taught**beta).sum()) for beta in BETAS)]
    n = requests.num_rows
    return pa.table({
        "block": requests["block"], "kind": requests["kind"], "part": requests["part"],
        "totals": pa.array(answers, pa.binary()), "sums": pa.array([sums, *[None] * (n - 1)], pa.list_(pa.float64())),
    })


@dataclass(frozen=True)
class Model:
    """What all blocks share: training tokens, different words, and beta."""

    tokens: int
    words: int
    beta: float

    def root(self, count: np.ndarray) -> np.ndarray:
        """Weights of the root's arcs."""
        return np.log10((count + ALPHA) / (self.tokens + ALPHA * (self.words + 1)))

    def failure(self, count: np.ndarray) -> np.ndarray:
        """Weights of the failure arcs; a word never seen has no state but the root, at no cost."""
        kinds = np.where(count > 0, count, 1.0) ** self.beta
        return np.where(count > 0, np.log10(kinds / (count + kinds)), 0.0)

    def arc(self, pair: np.ndarray, count: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Weights of the arcs of seen pairs."""
        kinds = count**self.beta
        return np.log10((pair + kinds * 10.0**root) / (count + kinds))


def heaps_exponent(pair_kinds: float, sums: np.ndarray) -> float:
    """The beta at which the sum of c(h)^beta over all words reaches the number of different pairs."""
    return float(np.interp(pair_kinds, sums, BETAS)) if sums[-1] > sums[0] else 1.0


def _walk(block: _Block, word_totals: np.ndarray, pair_totals: np.ndarray, model: Model) -> tuple:
    """Per text: tokens known, base score, score. The state before a token is the word before it."""
    root, failure = model.root(word_totals), model.failure(word_totals)
    seen = pair_totals[block.pair]
    weight = failure[block.before] + root[block.token]
    on_arc = np.flatnonzero(seen > 0)
    weight[on_arc] = model.arc(seen[on_arc], word_totals[block.before[on_arc]], root[block.token[on_arc]])
    starts = np.concatenate([[0], np.cumsum(block.lengths)[:-1]])
    known = np.add.reduceat((word_totals[block.token] > 0).astype(np.int64), starts)
    return known, np.add.reduceat(root[block.token], starts), np.add.reduceat(weight, starts)


def score_documents(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
    block_tokens: int = BLOCK_TOKENS, least_ranges: int = LEAST_RANGES,
) -> DataFrame:
    """Learns from the rows for which ``held_out`` is false and scores all: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score``."""
    blocks = blocks_of(docs, id_col, text_col, held_out, block_tokens)
    bits = max(least_ranges, blocks.count() // 4).bit_length()
    answers = materialise(
        _requests(blocks, bits).groupBy("kind", "part")
        .applyInArrow(_answer, "block long, kind int, part int, totals binary, sums array<double>"),
        "answers",
    )
    summed = [F.coalesce(F.sum(F.col("sums")[i]), F.lit(0.0)) for i in range(2 + len(BETAS))]
    sums = {row.kind: list(row)[1:] for row in answers.groupBy("kind").agg(*summed).collect()}  # two rows
    none = [0.0] * len(summed)
    words, pairs = sums.get(WORD, none), sums.get(PAIR, none)
    model = Model(int(words[1]), int(words[0]), heaps_exponent(pairs[0], np.array(words[2:])))
    id_type = docs.schema[id_col].dataType

    def score(texts: pa.Table, totals: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        block = _Block.read(row["lengths"], row["words"], row["numbers"])
        found: dict[int, list[tuple[int, bytes]]] = {WORD: [], PAIR: []}
        for kind, part, packed in zip(*(totals[name].to_pylist() for name in ("kind", "part", "totals"))):
            found[kind].append((part, packed))
        counts = [
            np.concatenate([_unpack(packed, np.uint64, False) for _, packed in sorted(found[kind])]).astype(float)
            for kind in (WORD, PAIR)
        ]
        known, base, full = _walk(block, *counts, model)
        return pa.table({
            "doc_id": texts["doc_ids"].combine_chunks().flatten(), "held_out": pa.array(row["held"], pa.bool_()),
            "n_tokens": block.lengths, "n_known": known, "train_tokens": np.full(len(known), model.tokens),
            "base_score": base, "score": full,
        })

    kinds = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return (
        blocks.groupBy("block").cogroup(answers.drop("sums").groupBy("block"))
        .applyInArrow(score, f"doc_id {id_type.simpleString()}, {kinds}")
    )


def op7_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), digest_bucket(F.col("doc_id"), FOLDS) == 0)
