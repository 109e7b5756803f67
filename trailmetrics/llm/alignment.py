"""Alignment of two tokenizers over each document, through an associative fragment monoid.

Both tokenizers cut the bytes of a space and the text. Where both end a token, the document is cut into groups; an A and a B
token whose bytes overlap are linked. A fragment stands for a range of bytes of a document, of which the two tokenizers
may hold slightly different stretches. It is an open prefix (tokens before its first common cut), closed groups, and
an open suffix (tokens after its last one); without a common cut it is all prefix. Two neighbours compose: the suffix of
the left and the prefix of the right are joined and cut anew, everything else stays. That is associative, so fragments
of a document can be composed in any bracketing.

Texts of up to ``CHUNK_BYTES`` are one fragment, closed at both ends; a task aligns many of them at once. Longer ones are
cut at every ``CHUNK_BYTES`` characters, for each tokenizer at the next place where its result cannot depend on what is on the other side:
for A before white space or punctuation that follows a letter, for B between two characters that no piece holds side by side. Chunks of one text go to different
tasks, and a tree of rounds composes ``FAN_IN`` neighbours at a time until each document is one fragment.

Documents are stored in blocks with, for each one, the distinct id pairs of its links, as numbers of the block's own pairs. Spark adds up the
pairs of all blocks, finds the highest count of each B id, and joins the counts to the pairs of each block again. That is a row per block and
pair, so a pair that every document holds is no hot key. What is broadcast is bounded by the vocabularies: the tokenizers' files, and a row
per B id.

Defined results: texts that are null, empty, or not the same bytes after decoding (as B may normalise) have no tokens,
zeros and an empty digest; rows that share an id are documents each; an empty table gives no rows. Texts of any length are aligned
as a whole; a stretch in which a tokenizer has no safe place stays in one chunk. Only the named columns are looked at.
"""

from __future__ import annotations

import hashlib
import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmetrics.llm.common import row_slices, table
from trailmetrics.llm.packed import pack, unpack
from trailmetrics.session import materialise

TOKENIZER_FOLDER = "/opt/tokenizers"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_BYTES = 1 << 16
FAN_IN = 8
BLOCK_PAIRS = 1 << 22
BATCH = 128
#: Fixed value: how byte-level pre-tokenizers cut a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be shown, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, the bytes of each of their tokens, and where texts may be cut."""

    def __init__(self, byte_json: bytes, piece_model: bytes):
        spec, of = json.loads(byte_json), _byte_characters()
        specials = {token["id"] for token in spec.get("added_tokens", ())}
        vocabulary = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        ranks = {bytes(of[c] for c in token): i for token, i in vocabulary.items() if i not in specials}
        by_rank = all(vocabulary[a + b] == 256 + i for i, (a, b) in enumerate(merges))
        plain = spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"] and not spec["normalizer"]
        if by_rank and plain and len(ranks) == 256 + len(merges):  # ids in the order of merges: the same result, several times faster
            encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._encode = encoding.encode_to_numpy
        else:
            whole = tokenizers.Tokenizer.from_str(byte_json.decode())
            whole.encode_special_tokens = True
            self._encode = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.n_a, self.n_b = max(vocabulary.values()) + 1, self.pieces.get_piece_size()
        self.a_bytes = [b""] * self.n_a
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [self._piece(i) for i in range(self.n_b)]
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.digits = _digits(max(self.n_a, self.n_b))
        self.digit_count = (self.digits > 0).sum(axis=1)
        names = [self.pieces.id_to_piece(i).replace("▁", " ") for i in range(self.n_b) if not self._odd(i)]
        self.side_by_side = {pair for name in names for pair in zip(name, name[1:])}
        self.start = self.pieces.encode("\n")  # what stands before a chunk that does not begin a text
        self.can_start = not any("\n" in name for name in names) and b"".join(self.b_bytes[i] for i in self.start) == b" \n"

    def _odd(self, i: int) -> bool:
        return self.pieces.is_byte(i) or self.pieces.is_control(i) or self.pieces.is_unknown(i)

    def _piece(self, i: int) -> bytes:
        name = self.pieces.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.pieces.is_byte(i) else name.replace("▁", " ").encode()

    def a(self, text: str) -> np.ndarray:
        return self._encode(text)

    def a_may_cut(self, left: str, right: str) -> bool:
        word = left.isascii() and left.isalnum() or "一" <= left <= "龥" or "ぁ" <= left <= "ゖ" or "가" <= left <= "힣"
        return right in " \n\t" and (word or "!" <= left <= "~") or left not in "0123456789" and word and right in ".,;:!?、。，！？"

    def b_may_cut(self, left: str, right: str) -> bool:
        return self.can_start and "▁" not in (left, right) and (left, right) not in self.side_by_side


def _digits(n: int) -> np.ndarray:
    """The decimal digits of 0 to n - 1 as characters, filled up with zero bytes."""
    width = len(str(n))
    return np.array([str(i).encode() for i in range(n)], dtype=f"S{width}").view(np.uint8).reshape(n, width)


@lru_cache(maxsize=2)
def _built(byte_json: bytes, piece_model: bytes) -> Tokenizers:
    return Tokenizers(byte_json, piece_model)


@dataclass
class Aligned:
    """Groups and links of some documents (or of a closed stretch of one)."""

    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[memoryview]
    pair_doc: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def align(tokens: Tokenizers, a: np.ndarray, b: np.ndarray, doc_bytes: np.ndarray) -> Aligned:
    """Aligns documents that follow each other; ``doc_bytes`` says how many bytes each of them has in both tokenizers.

    Links are the stretches between neighbouring ends of either tokenizer, as each lies in one token of A and one of B.
    """
    a_end, b_end, doc_end = np.cumsum(tokens.a_size[a]), np.cumsum(tokens.b_size[b]), np.cumsum(doc_bytes)
    n_docs, size = len(doc_bytes), int(doc_end[-1]) if len(doc_bytes) else 0
    is_a, is_b = np.zeros(size + 1, dtype=np.int32), np.zeros(size + 1, dtype=np.int32)
    is_a[a_end], is_b[b_end] = 1, 1
    ends = np.flatnonzero(is_a | is_b)
    doc = np.searchsorted(doc_end, ends)
    a_at, b_at = (np.cumsum(is_a) - is_a)[ends], (np.cumsum(is_b) - is_b)[ends]
    n_pairs = tokens.n_a * tokens.n_b
    keys, times = np.unique(doc * n_pairs + b[b_at].astype(np.int64) * tokens.n_a + a[a_at], return_counts=True)

    both = is_a & is_b
    cuts = np.flatnonzero(both)
    group = np.cumsum(both) - both
    a_group, b_group = group[a_end], group[b_end]
    a_in, b_in = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
    # the place of each token in "a1,a2|b1;a3|b2,b3": its own before it, and those of the other tokenizer in earlier groups
    a_slot = np.arange(len(a)) + (np.cumsum(b_in) - b_in)[a_group]
    b_slot = np.arange(len(b)) + np.cumsum(a_in)[b_group]
    width = tokens.digits.shape[1]
    cells = np.zeros((len(a) + len(b), width + 1), dtype=np.uint8)
    cells[a_slot, :width], cells[b_slot, :width] = tokens.digits[a], tokens.digits[b]
    cells[a_slot, width] = np.where(is_b[a_end] > 0, ord("|"), ord(","))
    cells[b_slot, width] = np.where(is_a[b_end] > 0, ord(";"), ord(","))
    text = memoryview(cells[cells > 0].tobytes())
    a_chars = np.bincount(np.searchsorted(doc_end, a_end), weights=tokens.digit_count[a] + 1, minlength=n_docs)
    b_chars = np.bincount(np.searchsorted(doc_end, b_end), weights=tokens.digit_count[b] + 1, minlength=n_docs)
    at = np.concatenate([[0], np.cumsum(a_chars + b_chars)]).astype(np.int64)
    groups = [text[low : max(low, high - 1)] for low, high in zip(at[:-1].tolist(), at[1:].tolist())]
    n_groups = np.bincount(np.searchsorted(doc_end, cuts), minlength=n_docs)
    return Aligned(n_groups, np.bincount(doc, minlength=n_docs), groups, keys // n_pairs, keys % n_pairs, times)


def _none() -> np.ndarray:
    return np.zeros(0, dtype=np.uint32)


@dataclass
class Run:
    """Tokens of both tokenizers that follow each other, A's from byte ``a_from`` on and B's from ``b_from``."""

    a_from: int
    b_from: int
    a: np.ndarray = field(default_factory=_none)
    b: np.ndarray = field(default_factory=_none)

    def __add__(self, right: Run) -> Run:
        return Run(self.a_from, self.b_from, np.concatenate([self.a, right.a]), np.concatenate([self.b, right.b]))


@dataclass
class Closed:
    """What closed groups come to: how much they hold, their text, and the distinct pairs of their links."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    groups: tuple[bytes, ...] = ()
    pair: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def __add__(self, right: Closed) -> Closed:
        pair, place = np.unique(np.concatenate([self.pair, right.pair]), return_inverse=True)
        times = np.bincount(place, weights=np.concatenate([self.times, right.times]), minlength=len(pair)).astype(np.int64)
        return Closed(
            self.n_a + right.n_a, self.n_b + right.n_b, self.n_groups + right.n_groups, self.n_links + right.n_links,
            self.groups + right.groups, pair, times,
        )


@dataclass
class Fragment:
    """An element of the monoid; without ``closed``, all of it is prefix. ``broken`` ones have bytes that differ from the text."""

    prefix: Run
    closed: Closed | None = None
    suffix: Run | None = None
    broken: bool = False


def fragment(tokens: Tokenizers, run: Run) -> Fragment:
    """Cuts a run at its first and last common boundary and closes the groups between."""
    a_cut = run.a_from + np.concatenate([[0], np.cumsum(tokens.a_size[run.a])])
    b_cut = run.b_from + np.concatenate([[0], np.cumsum(tokens.b_size[run.b])])
    common, a_at, b_at = np.intersect1d(a_cut, b_cut, return_indices=True)
    if not len(common):
        return Fragment(run)
    (a0, a1), (b0, b1) = a_at[[0, -1]], b_at[[0, -1]]
    first, last = int(common[0]), int(common[-1])
    closed = Closed()
    if last > first:
        found = align(tokens, run.a[a0:a1], run.b[b0:b1], np.array([last - first]))
        closed = Closed(
            int(a1 - a0), int(b1 - b0), int(found.n_groups[0]), int(found.n_links[0]),
            (bytes(found.groups[0]),), found.pair, found.times,
        )
    return Fragment(Run(run.a_from, run.b_from, run.a[:a0], run.b[:b0]), closed, Run(last, last, run.a[a1:], run.b[b1:]))


def compose(tokens: Tokenizers, left: Fragment | None, right: Fragment | None) -> Fragment | None:
    """The fragment of two neighbours; None is the neutral element, a broken fragment the absorbing one."""
    if left is None or right is None:
        return left or right
    if left.broken or right.broken:
        return left if left.broken else right
    middle = fragment(tokens, (left.prefix if left.closed is None else left.suffix) + right.prefix)
    closed = [x.closed for x in (left, middle, right) if x.closed is not None]
    return Fragment(
        middle.prefix if left.closed is None else left.prefix,
        reduce(Closed.__add__, closed) if closed else None,
        middle.suffix if right.closed is None else right.suffix,
    )


def _pack_fragment(found: Fragment) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(found, protocol=5))


def _unpack_fragment(packed: bytes) -> Fragment:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(packed))


def cuts(text: str, step: int, may_cut) -> list[int]:
    """For every ``step`` characters the next place where the text may be cut; its end if there is none."""
    places = []
    for edge in range(step, len(text), step):
        at = max(edge, places[-1] if places else 0)
        while at < len(text) and not may_cut(text[at - 1], text[at]):
            at += 1
        places.append(at)
    return places


def chunk_fragment(tokens: Tokenizers, a_text: str, b_text: str, a_from: int, b_from: int) -> Fragment:
    """The fragment of a chunk; B takes a text's first chunk without its space, which it adds itself."""
    a = tokens.a(a_text) if a_text else _none()
    if not b_text:
        b = []
    elif b_from == 0:
        b = tokens.pieces.encode(b_text[1:])
    else:
        b = tokens.pieces.encode("\n" + b_text)[len(tokens.start) :]
    same = b"".join([tokens.b_bytes[i] for i in b]) == b_text.encode() and b"".join([tokens.a_bytes[i] for i in a]) == a_text.encode()
    run = Run(a_from, b_from, a, np.array(b, dtype=np.uint32))
    return fragment(tokens, run) if same else Fragment(run, broken=True)


class _Block:
    """Aligned documents on their way to a stored row."""

    def __init__(self, keep_groups: bool):
        self.keep_groups = keep_groups
        self.clear()

    def clear(self) -> None:
        self.ids, self.numbers, self.digests, self.groups, self.sizes, self.pairs, self.times, self.held = [], [], [], [], [], [], [], 0

    def add(self, ids: list, numbers: list, groups: list, sizes: list, pair: np.ndarray, times: np.ndarray) -> None:
        self.ids += ids
        self.numbers += numbers
        self.digests += [hashlib.sha256(x).hexdigest() if n[0] else "" for x, n in zip(groups, numbers)]
        if self.keep_groups:
            self.groups += [bytes(x).decode() for x in groups]
        self.sizes += sizes
        self.pairs.append(pair)
        self.times.append(times)
        self.held += len(pair)

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        pairs, times = np.concatenate(self.pairs), np.concatenate(self.times)
        own, place = np.unique(pairs, return_inverse=True)
        uses = np.bincount(place, weights=times, minlength=len(own)).astype(np.int64)
        values = [
            self.ids, np.array(self.numbers, dtype=np.int64).tobytes(), self.digests, self.groups if self.keep_groups else None,
            pack(np.array(self.sizes, dtype=np.uint32)), pack(place.astype(np.uint32), True), pack(times.astype(np.uint32)),
            pack(own.astype(np.uint64), True), pack(uses),
        ]
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema)], schema=schema)


_BLOCK = "doc_ids array<bigint>, numbers binary, digests array<string>, groups array<string>, sizes binary, places binary, times binary, pairs binary, uses binary"
_BLOCK_ARROW = pa.schema(
    [("doc_ids", pa.list_(pa.int64())), ("numbers", pa.binary()), ("digests", pa.list_(pa.string())), ("groups", pa.list_(pa.string()))]
    + [(name, pa.binary()) for name in ("sizes", "places", "times", "pairs", "uses")]
)


class Aligner:
    """The stages over documents with two given tokenizers."""

    def __init__(self, spark: SparkSession, folder: str = TOKENIZER_FOLDER, chunk: int = CHUNK_BYTES, keep_groups: bool = False):
        files = [Path(folder, name).read_bytes() for name in (BYTE_FILE, PIECE_FILE)]
        self.spark, self.chunk, self.keep_groups = spark, chunk, keep_groups
        self.files = spark.sparkContext.broadcast(files)  # two files of some MB, whatever the data
        self.n_a = _built(*files).n_a

    def _short(self, rows: DataFrame) -> DataFrame:
        files, keep = self.files, self.keep_groups

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens, block = _built(*files.value), _Block(keep)
            for batch in row_slices(batches, BATCH):
                _add_short(tokens, block, batch.column(0).to_pylist(), batch.column(1).to_pylist())
                if block.held >= BLOCK_PAIRS:
                    yield block.row(_BLOCK_ARROW)
            if block.ids:
                yield block.row(_BLOCK_ARROW)

        return rows.mapInArrow(blocks, _BLOCK)

    def _long(self, rows: DataFrame) -> DataFrame:
        files, step, keep = self.files, self.chunk, self.keep_groups

        def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = _built(*files.value)
            for batch in row_slices(batches, 1):
                row, doc_id, text = (batch.column(i)[0].as_py() for i in range(3))
                text = " " + text
                a_cuts, b_cuts = ([0, *cuts(text, step, may), len(text)] for may in (tokens.a_may_cut, tokens.b_may_cut))
                a_from = b_from = 0
                for part in range(len(a_cuts) - 1):
                    a_text, b_text = text[a_cuts[part] : a_cuts[part + 1]], text[b_cuts[part] : b_cuts[part + 1]]
                    values = (row, doc_id, part, a_text, b_text, a_from, b_from)
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, chunked)], schema=chunked)
                    a_from, b_from = a_from + len(a_text.encode()), b_from + len(b_text.encode())

        def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = _built(*files.value)
            for batch in row_slices(batches, 1):
                row, doc_id, part, *texts = (batch.column(i)[0].as_py() for i in range(7))
                yield one(row, doc_id, part, _pack_fragment(chunk_fragment(tokens, *texts)))

        def composed(group: pa.Table) -> pa.Table:
            tokens = _built(*files.value)
            ordered = group.sort_by("part")
            found = reduce(lambda left, packed: compose(tokens, left, _unpack_fragment(packed.as_py())), ordered["fragment"], None)
            part = ordered["part"][0].as_py() // FAN_IN
            return pa.Table.from_batches([one(ordered["row"][0].as_py(), ordered["doc_id"][0].as_py(), part, _pack_fragment(found))])

        def one(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, parted)], schema=parted)

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _Block(keep)
            for batch in row_slices(batches, 1):
                doc_id, found = batch.column(0)[0].as_py(), _unpack_fragment(batch.column(1)[0].as_py())
                whole = Closed() if found.broken else found.closed
                block.add(
                    [doc_id], [(whole.n_a, whole.n_b, whole.n_groups, whole.n_links)], [b";".join(whole.groups)],
                    [len(whole.pair)], whole.pair, whole.times,
                )
                if block.held >= BLOCK_PAIRS:
                    yield block.row(_BLOCK_ARROW)
            if block.ids:
                yield block.row(_BLOCK_ARROW)

        chunked = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("a_text", pa.string()), ("b_text", pa.string()), ("a_from", pa.int64()), ("b_from", pa.int64())])
        parted = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("fragment", pa.binary())])
        kinds = "row bigint, doc_id bigint, part bigint"
        numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        cut = materialise(numbered.mapInArrow(chunks, f"{kinds}, a_text string, b_text string, a_from bigint, b_from bigint"), "chunks")
        most = cut.agg(F.max("part")).first()[0] or 0
        spread = cut.repartition(F.col("row"), F.col("part"))
        found = materialise(spread.mapInArrow(fragments, f"{kinds}, fragment binary"), "fragments")
        while most > 0:
            groups = found.groupBy("row", F.floor(F.col("part") / FAN_IN).alias("parent"))
            found = materialise(groups.applyInArrow(composed, f"{kinds}, fragment binary"), "fragments")
            most //= FAN_IN
        return found.select("doc_id", "fragment").mapInArrow(blocks, _BLOCK)

    def blocks(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """All documents, aligned, in stored blocks."""
        rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
        is_long = F.octet_length("text") > self.chunk
        both = self._short(rows.where(~is_long)).unionAll(self._long(rows.where(is_long)))
        return materialise(both.withColumn("block", F.monotonically_increasing_id()), "aligned")

    def _pairs(self, blocks: DataFrame) -> DataFrame:
        """``block, pair, n``: how many links of each block hold a pair."""

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in row_slices(batches, 1):
                pairs, uses = unpack(batch.column(1)[0].as_py(), np.uint64, True), unpack(batch.column(2)[0].as_py(), np.int64)
                columns = [pa.array(np.full(len(pairs), batch.column(0)[0].as_py())), pa.array(pairs.astype(np.int64)), pa.array(uses)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "pair", "n"])

        return blocks.select("block", "pairs", "uses").mapInArrow(unpacked, "block bigint, pair bigint, n bigint")

    def pair_counts(self, blocks: DataFrame) -> DataFrame:
        """A stored table: ``pair, count, best``; a pair is ``b_id * n_a + a_id``, and best if its count is its B id's highest."""
        counts = materialise(self._pairs(blocks).groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
        b_id = F.floor(F.col("pair") / self.n_a)
        highest = counts.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("highest"))
        judged = counts.withColumn("b_id", b_id).join(F.broadcast(highest), "b_id")  # a row per B id at most
        return materialise(judged.select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "judged-pairs")

    def documents(self, blocks: DataFrame, counts: DataFrame) -> DataFrame:
        """A row per document; ``groups`` is its text of groups if the aligner keeps them."""
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]

        def judged(block: pa.Table, answers: pa.Table) -> pa.Table:
            row = block.to_pylist()[0]
            order = np.argsort(answers["pair"].to_numpy())
            count, best = answers["count"].to_numpy()[order], answers["best"].to_numpy()[order]
            place, times = unpack(row["places"], np.uint32, True), unpack(row["times"], np.uint32).astype(np.int64)
            ends = np.cumsum(unpack(row["sizes"], np.uint32).astype(np.int64))

            def per_doc(values: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])]
                return np.diff(sums)

            numbers = np.frombuffer(row["numbers"], dtype=np.int64).reshape(-1, 4)
            columns = [
                pa.array(row["doc_ids"], pa.int64()), *[pa.array(numbers[:, i]) for i in range(4)],
                pa.array(per_doc(times * best[place])), pa.array(per_doc(times * count[place])),
                pa.array(row["digests"], pa.string()), pa.array(row["groups"] or [None] * len(numbers), pa.string()),
            ]
            return pa.Table.from_arrays(columns, names)

        asked = self._pairs(blocks).select("block", "pair").join(counts, "pair")
        kinds = ", ".join(f"{name} bigint" for name in names[:-2]) + ", groups_sha256 string, groups string"
        return blocks.drop("uses", "pairs").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(judged, kinds)


def _add_short(tokens: Tokenizers, block: _Block, ids: list, texts: list[str]) -> None:
    """Aligns the texts of a batch together and adds them to the block."""
    spaced = [" " + text for text in texts]
    b = tokens.pieces.encode(texts, num_threads=1)
    sizes = [len(text.encode()) for text in spaced]
    good = [
        i for i, text in enumerate(texts)
        if text and b"".join([tokens.b_bytes[t] for t in b[i]]) == spaced[i].encode()
    ]
    a = {i: tokens.a(spaced[i]) for i in good}
    good = [i for i in good if tokens.a_size[a[i]].sum() == sizes[i]]
    number = dict.fromkeys(range(len(texts)), (0, 0, 0, 0))
    groups: dict[int, bytes | memoryview] = dict.fromkeys(range(len(texts)), b"")
    held = np.zeros(len(texts), dtype=np.int64)
    pair = times = np.zeros(0, dtype=np.int64)
    if good:
        all_b = np.array([t for i in good for t in b[i]], dtype=np.uint32)
        found = align(tokens, np.concatenate([a[i] for i in good]), all_b, np.array([sizes[i] for i in good]))
        for at, i in enumerate(good):
            number[i] = (len(a[i]), len(b[i]), int(found.n_groups[at]), int(found.n_links[at]))
            groups[i] = found.groups[at]
        held[good] = np.bincount(found.pair_doc, minlength=len(good))
        pair, times = found.pair, found.times
    block.add(ids, list(number.values()), list(groups.values()), held.tolist(), pair, times)


def align_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZER_FOLDER,
    chunk: int = CHUNK_BYTES, keep_groups: bool = False,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups``; the last only if kept."""
    aligner = Aligner(docs.sparkSession, folder, chunk, keep_groups)
    blocks = aligner.blocks(docs, id_col, text_col)
    return aligner.documents(blocks, aligner.pair_counts(blocks))


def op11_fragment_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents")).drop("groups")
