"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Each bucket of hashed tokens owns a fixed sparse ternary index vector. The vector of a token is the sum of
the index vectors that stand near it in all documents. A document has two streams of tokens, its
words and their shapes (``A!!``, ``Aa``, ``9``, a repeat of the word before), and is pooled to the mean
vector of each stream. A network with one hidden layer scores it, and one temperature, fitted on
rows that the weights have not seen, turns scores into probabilities.

The sums are whole numbers: each task adds up its documents, and the sums of ``MERGED`` tasks at a time are added to one, slice by
slice of the buckets, until one is left; so they depend neither on the order nor on the split of the files. The network is fitted
on the driver from the pooled vectors of at most ``SAMPLE_ROWS`` labelled rows outside the held-out fold,
the ones with the smallest hash of their id; this bound is a parameter and does not grow with the tables. The driver sees no text. The
fitted model has a fixed size (see ``BUCKETS`` and ``WIDTH``). Every text is scored whole, in Arrow
batches inside tasks; work grows with its length.

Defined results: a null text is an empty text; an empty text has zero vectors and gets the network's
score for these; a null id is in the held-out fold; repeated rows are scored each; labels that
are null are ignored, several labels of one id count as their largest; without any label every score is 0.5.
Only the named columns are looked at, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmetrics.llm.common import digest_bucket, free_names, row_slices, table
from trailmetrics.llm.packed import pack, unpack
from trailmetrics.session import materialise

SAMPLE_ROWS = 6_000
BUCKETS = 1 << 16
WIDTH = 32
NONZEROS = 4
REACH = 2
HIDDEN = 24
EPOCHS = 60
FOLDS = 5
KEEP_AT = 0.3
SEED = 11
SLICES = 64
MERGED = 64
PIECE = 1 << 18
OFFSET = 2 * REACH * NONZEROS
LANE_ROWS = 2048
CHUNK = 4096

_AGAIN = zlib.crc32(b"\0again") % BUCKETS
#: Bytes of text as flags and classes; in UTF-8 the letters of Latin-1 are 0xC3 and one byte more.
_BLANK = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r "))
_MARK = np.isin(np.arange(256), list(b"!?.,;:*$%&#|\"'()[]"))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A] = ord("A"), ord("a"), ord("9")
_IN_RUNS = np.isin(np.arange(256), list(b"Aa9"))
_RANDOM = np.random.default_rng(SEED).integers(1, 1 << 63, (3, 256), dtype=np.uint64)
_BASE = 0xD1342543DE82EF95


@dataclass(frozen=True)
class Model:
    """Token vectors, scaling of the pooled input, both layers, temperature."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        x = (pooled - self.mean) / self.scale
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(pooled) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0)))


_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the base and more, and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, PIECE), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS


def _hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of random numbers: a polynomial, out of sums up to its two ends."""
    power, inverse = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    mixed = (sums[ends] - sums[starts]) * inverse[starts]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def word_features(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Of each word in some bytes: where it starts, its hash, its bucket without marks at its ends and in lower case, and that of its shape.

    Four rows. In a shape, runs of capitals, of small letters and of digits are one sign each. A text's start begins a word.
    """
    letter = np.zeros(len(data), dtype=bool)
    letter[1:] = data[:-1] == 0xC3  # the second byte of a letter of Latin-1
    large = letter & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    small = letter & (data >= 0x9F) & (data <= 0xBF) & (data != 0xB7)
    in_word = ~_BLANK[data]
    breaks = np.zeros(len(data) + 1, dtype=bool)
    breaks[text_starts] = True
    opens = in_word & (np.append(True, ~in_word[:-1]) | breaks[:-1])
    closes = in_word & (np.append(~in_word[1:], True) | breaks[1:])
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if not len(starts):
        return np.zeros((4, 0), dtype=np.uint64)
    whole = _hashes(_RANDOM[0][data], starts, ends)

    plain = in_word & ~_MARK[data]
    inner = np.flatnonzero(plain)
    before = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(plain, out=before[1:])
    low, high = before[starts], before[ends]
    some = high > low
    first, last = starts.copy(), starts.copy()
    first[some], last[some] = inner[low[some]], inner[high[some] - 1] + 1
    bare = _hashes(_RANDOM[1][np.where(large, data + 0x20, _LOWER[data]).astype(np.uint8)], first, last)

    sign = np.where(large, ord("A"), np.where(small, ord("a"), _CLASS[data])).astype(np.uint8)
    lead = np.append((large | small)[1:], False)  # goes with the byte after it
    kept = np.flatnonzero(in_word & ~lead)
    sign, word = sign[kept], np.cumsum(opens, dtype=np.int32)[kept]
    new = np.append(True, (sign[1:] != sign[:-1]) | (word[1:] != word[:-1]) | ~_IN_RUNS[sign[1:]])[: len(sign)]
    sign, word = sign[new], word[new]
    heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))  # every word has a sign
    shape = _hashes(_RANDOM[2][sign], heads, np.append(heads[1:], len(sign)))
    n = np.uint64(BUCKETS)
    return np.stack([starts.astype(np.uint64), whole, bare % n, shape % n])


def streams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words of some texts and of their shapes, two rows, and how many words each text has."""
    raw = [text.encode() for text in texts]
    sizes = np.array([len(text) for text in raw], dtype=np.int64)
    data, ends = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(sizes)
    starts = ends - sizes
    parts, low = [], 0
    while low < len(data):  # some PIECE bytes at a time, up to a blank
        high = min(low + PIECE, len(data))
        while high < len(data) and not _BLANK[data[high]]:
            high += 1
        own = starts[(starts >= low) & (starts < high)] - low
        found = word_features(data[low:high], own)
        found[0] += np.uint64(low)
        parts.append(found)
        low = high
    at, whole, bare, shape = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), dtype=np.uint64)
    counts = np.bincount(np.searchsorted(ends, at.astype(np.int64), side="right"), minlength=len(texts))
    again = np.append(False, whole[1:] == whole[:-1])[: len(whole)]
    again[(np.cumsum(counts) - counts)[counts > 0]] = False  # the first word of a text repeats none
    shape = np.where(again, np.uint64(_AGAIN), shape)
    return np.stack([bare, shape]).astype(np.int64), counts


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """For each text the mean vector of its words, then of their shapes."""
    streams, counts = streams_of(texts)
    out = np.zeros((len(texts), 2 * WIDTH))
    for low, stream in zip((0, WIDTH), streams):
        own = vectors[stream]
        at = 0
        for i, n in enumerate(counts.tolist()):
            for start in range(at, at + n, CHUNK):  # a chunk in single precision, their sum in double
                out[i, low : low + WIDTH] += own[start : min(start + CHUNK, at + n)].sum(axis=0)
            at += n
    return out / np.maximum(counts, 1)[:, None]


def index_vectors(seed: int) -> np.ndarray:
    """The index vector of each bucket, and one of zeros for no word."""
    rng = np.random.default_rng(seed)
    places = rng.integers(WIDTH, size=(BUCKETS, NONZEROS))
    signs = rng.choice(np.array([-1, 1]), size=(BUCKETS, NONZEROS))
    out = np.zeros((BUCKETS + 1, WIDTH), dtype=np.int8)
    np.add.at(out, (np.arange(BUCKETS)[:, None], places), signs.astype(np.int8))
    return out


class TokenSums:
    """Random indexing: for every bucket the sum of its neighbours' index vectors."""

    def __init__(self, seed: int = SEED) -> None:
        self.vectors = index_vectors(seed)
        self.total = np.zeros((BUCKETS, WIDTH), dtype=np.int64)

    def add(self, texts: list[str]) -> None:
        streams, counts = streams_of(texts)
        # as many places without a word after each text as a word has neighbours on one side
        at = np.arange(streams.shape[1]) + np.repeat(np.arange(len(counts)), counts) * REACH + REACH
        for stream in streams:
            if not len(stream):
                continue
            placed = np.full(len(stream) + (len(counts) + 1) * REACH, BUCKETS)
            placed[at] = stream
            near, vectors = np.zeros((len(placed) - 2 * REACH, WIDTH), dtype=np.int8), self.vectors[placed]
            for step in range(2 * REACH + 1):
                if step != REACH:
                    near += vectors[step : step + len(near)]
            order = np.argsort(stream, kind="stable")
            near = near[at[order] - REACH]
            own = stream[order]
            new = np.append(True, own[1:] != own[:-1])
            new[::LANE_ROWS] = True
            heads = np.flatnonzero(new)
            # four columns to a 64-bit word, each above zero and too small to run over into the next
            lanes = (near + OFFSET).astype(np.uint16).view(np.uint64)
            sums = np.add.reduceat(lanes, heads, axis=0).view(np.uint16).astype(np.int64)
            sums -= OFFSET * np.diff(np.append(heads, len(own)))[:, None]
            again = own[heads[1:]] == own[heads[:-1]]  # a bucket in several runs of rows
            for i in np.flatnonzero(again).tolist():
                sums[i + 1] += sums[i]
            last = np.append(~again, True)
            self.total[own[heads[last]]] += sums[last]


def unit_vectors(total: np.ndarray) -> np.ndarray:
    """The sums at length 1."""
    vectors = total.reshape(BUCKETS, WIDTH).astype(float)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(length > 0, length, 1.0)).astype(np.float32)


def token_vectors(docs: DataFrame, text_col: str = "text", seed: int = SEED) -> np.ndarray:
    """Vectors of all buckets from all documents; of fixed size, whatever the table."""
    width = BUCKETS * WIDTH // SLICES

    def rows(total: np.ndarray) -> pa.RecordBatch:
        packed = [pack(total[i * width : (i + 1) * width]) for i in range(SLICES)]
        return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], ["slice", "sums"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in row_slices(batches, 128):
            sums = sums or TokenSums(seed)
            sums.add([text or "" for text in batch.column(0).to_pylist()])
        if sums is not None:
            yield rows(sums.total.ravel())

    def merged(group: pa.Table) -> pa.Table:
        total = sum(unpack(packed.as_py(), np.int64) for packed in group["sums"])
        return pa.table({"slice": group["slice"][:1], "part": pa.array([group["part"][0].as_py() // MERGED]), "sums": pa.array([pack(total)], pa.binary())})

    parts = docs.select(text_col).mapInArrow(summed, "slice int, sums binary")
    parts = materialise(parts.withColumn("part", F.spark_partition_id().cast("long")), "token-sums")
    most = parts.agg(F.max("part")).first()[0] or 0
    while True:
        groups = parts.groupBy("slice", F.floor(F.col("part") / MERGED).alias("parent"))
        parts = materialise(groups.applyInArrow(merged, "slice int, part long, sums binary"), "token-sums")
        most //= MERGED
        if not most:
            break
    total = np.zeros(BUCKETS * WIDTH, dtype=np.int64)
    for row in parts.toLocalIterator():  # a row per slice
        total[row.slice * width : (row.slice + 1) * width] = unpack(row.sums, np.int64)
    return unit_vectors(total)


def _train(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple:
    """Adam on cross-entropy with a little weight decay."""
    n_in = x.shape[1]
    weights = [rng.normal(0, n_in**-0.5, (n_in, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for start in range(0, len(x), 128):
            rows = order[start : start + 128]
            hidden = np.tanh(x[rows] @ weights[0] + weights[1])
            error = (_sigmoid(hidden @ weights[2] + weights[3]) - y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (1 - hidden**2)
            gradients = [x[rows].T @ back, back.sum(0), hidden.T @ error, error.sum(keepdims=True)]
            step += 1
            for i, gradient in enumerate(gradients):
                gradient = gradient + 1e-3 * weights[i] * (i in (0, 2))
                m[i] = 0.9 * m[i] + 0.1 * gradient
                v[i] = 0.999 * v[i] + 0.001 * gradient**2
                weights[i] -= 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return weights[0], weights[1], weights[2], float(weights[3][0])


def fit(vectors: np.ndarray, x: np.ndarray, labels: list[int], seed: int = SEED) -> Model:
    """Weights from four fifths of the pooled rows in the order given, the temperature from the rest."""
    width = 2 * WIDTH
    if not len(x):
        return Model(vectors, np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    x = np.asarray(x, dtype=float)
    y = np.asarray(labels, dtype=float)
    kept = np.arange(len(x)) % FOLDS != 0
    kept |= kept.sum() == 0
    mean, scale = x[kept].mean(0), x[kept].std(0) + 1e-3
    layers = _train((x[kept] - mean) / scale, y[kept], np.random.default_rng(seed))
    raw = Model(vectors, mean, scale, *layers, 1.0)
    rest = ~kept if (~kept).any() else kept
    z, truth = raw.logits(x[rest]), y[rest]
    candidates = np.exp(np.linspace(np.log(0.5), np.log(8.0), 60))
    loss = [np.mean(np.logaddexp(0, -z / t) * truth + np.logaddexp(0, z / t) * (1 - truth)) for t in candidates]
    return Model(vectors, mean, scale, *layers, float(candidates[int(np.argmin(loss))]))


def fit_on_labels(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS
) -> Model:
    """Fits on labelled rows outside the held-out fold, at most ``sample_rows`` of them; their texts are pooled in tasks."""
    vectors = token_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .where(digest_bucket(F.col("doc_id"), folds) != 0)
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min("text").alias("text"))
        .select(F.xxhash64("doc_id").alias("hash"), F.col("doc_id").cast("string").alias("id"), (F.col("quality") > 0).cast("int").alias("label"), "text")
    )

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 128):
            found = [row.tobytes() for row in pooled([text or "" for text in batch.column(3).to_pylist()], shared.value)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], ["hash", "id", "label", "pooled"])

    fitted = rows.mapInArrow(pool, "hash long, id string, label int, pooled binary").orderBy("hash", "id").limit(sample_rows).collect()
    x = np.array([np.frombuffer(row.pooled) for row in fitted]).reshape(len(fitted), 2 * WIDTH)
    return fit(vectors, x, [row.label for row in fitted])


def with_score(docs: DataFrame, model: Model, text_col: str, kept: list[str], score_col: str) -> DataFrame:
    """The columns ``kept`` and the probability of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*kept).alias("kept"), F.col(text_col).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in row_slices(batches, 128):
            found = pooled([text or "" for text in batch.column(1).to_pylist()], fitted.vectors)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fitted.probabilities(found), pa.float64())], ["kept", "score"]
            )

    schema = f"kept {rows.schema['kept'].dataType.simpleString()}, score double"
    scored = rows.mapInArrow(score, schema)
    return scored.select(*(F.col("kept").getField(name).alias(name) for name in kept), F.col("score").alias(score_col))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, at_least: float = KEEP_AT) -> DataFrame:
    """The documents, with all columns, that score ``at_least``."""
    labels = table(spark, sf_dir, "labels")
    model = fit_on_labels(docs, labels)
    (name,) = free_names(docs.columns, "quality")
    return with_score(docs, model, "text", docs.columns, name).where(F.col(name) >= at_least).drop(name)


def op9_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_on_labels(docs, labels)
    return with_score(docs, model, "text", ["doc_id"], "score").select(
        "doc_id",
        (digest_bucket(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_AT).cast("int").alias("predicted"),
    )
