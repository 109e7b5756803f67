"""Fuzzy substring dedup: shared seeds, chained collinearly and aligned.

Seeds are runs of ``SEED_WORDS`` words; of every ``WINDOW`` neighbouring ones that with the least hash is used. A passage of
``LEAST_WORDS`` words or more of whose five-word shingles ``SIMILARITY`` are shared has an unbroken run of
12 words, hence a seed in common, so this choice loses none. Passages whose words are as similar but whose shingles are not, such as one with every
eighth word changed, are found as far as their seeds meet; the README has figures.

A seed in at most ``EVERY`` places of all texts meets each of its places in earlier texts. A commoner one meets the first text that has it and the one before,
and all others through pairs: two shared seeds that start within ``REACH`` words of each other, which is as far as chains bridge, are a key if one of them
is common. A pair in at most ``EVERY`` places meets all earlier ones again. The places of a commoner pair that say the same from its first seed to its
second are a class; of at most ``EVERY`` classes the first place of each meets those of all others. The rest of a class says what its first place says, so from seed to seed it has the same words in
common with other texts. Beyond the outer seeds of a common pair, words that a text other than the first of the class goes on with, at most six on a side, may stay unmatched; more are a long run.

Of more classes, each meets the one before and the references: the first class, and each whose two seeds stand nearer to each other than in all before it. A word that
an earlier text has between the two seeds, too, is then matched with a reference, or both texts differ from the reference by it. Such words are joined: each that
no long run has meets the first text that has it after the same word of the reference, else before the same word, else in the same stretch of it. The
two texts are aligned by what both have in common with the reference. So a line in many wordings costs what they differ in, never the pairs of its wordings. A word that occurs
several times in a stretch, with other words on both sides, may be asked of a text that has it elsewhere in that stretch, and references miss pairs over 25 words apart that chains just bridge.

A block of texts reports each seed once, and each wording of a pair that it has more than ``EVERY`` times. So a line that a third of all documents share is one
entry per block, never all pairs of them.

Unbroken runs of ``LEAST_PIECE`` words whose seed, that with the least hash, other documents share are joined too, every such run, wherever it starts, with the
first text that has it and the one before: a match of it is a piece in itself, whichever
document it is found in. So each word of a passage that lies in 12 words that an earlier document has is matched, and a chain of one seed alone is not aligned.

For each pair of documents, matches on one diagonal are joined to segments, and segments in order in both documents
chained: a segment gains its words and pays ``GAP_COST`` for each word left out on either side. The best
predecessor is a prefix maximum in a Fenwick tree over the other document's positions; as what a chain is worth to the next segment is
bounded by the cost of ``2 * GAP`` words, it is one within reach. Chains are then aligned:
segments grow while words agree, the gaps between them are aligned word by word.

Aligned pieces of at least ``LEAST_PIECE`` words that lie next to each other in a document make an island, even if parts
of it stand in different earlier documents. An island is cut where its words are not matched: each stretch of it of
``LEAST_WORDS`` words with ``SIMILARITY`` of them matched that lies in no longer such stretch is a passage, a row for each, with
the document that most of it stands in. Passages of one island may overlap. Only the first of equal texts is searched; each
later one is a passage of the first as a whole. Passages that repeat within one document only are not reported.

Defined results: null texts have no words; ids are whole numbers, a null one comes after all others; the order of rows that share an id is
arbitrary but fixed; rows that share id and text count as one; an empty table gives an empty result. Only the named columns are looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmetrics.llm.common import join_counted, row_slices, table, text_bytes, text_key
from trailmetrics.llm.packed import pack, unpack
from trailmetrics.llm.suffixes import LAST, blocks_of, first_rows, once, remixed
from trailmetrics.session import materialise

SEED_WORDS = 5
WINDOW = 8
LEAST_WORDS = 50
LEAST_PIECE = SEED_WORDS + WINDOW - 1  # words of so many neighbouring seeds that one of them is used
SIMILARITY = 0.8
GAP_COST = 0.1
GAP = 32
MARGIN = 16
STEP = 8
#: Places up to which each place of a seed, or of a pair of seeds, meets all earlier ones; with more, pairs and classes do.
EVERY = 16
#: Words from the start of a seed to that of another with which it makes a pair; chains bridge no more.
REACH = 2 * GAP + SEED_WORDS
#: Words of a reference in which texts that differ from it are compared; seeds of a pair lie within.
STRETCH = REACH + 2 * SEED_WORDS
BLOCK_BYTES = 2 << 20
LEAST_RANGES = 32
KEY = ["key_a", "key_b"]
#: Words in alignments, as 24 bits of their hashes: of different words, one pair in 16 million counts as equal.
_BYTES = 3


#: Separators become spaces and A-Z lower case, byte by byte.
_PLAIN = bytes(0x20 if b in b"\t\n\x0b\x0c\r " else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_RNG = np.random.default_rng(0x5EED)
_OF_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 17
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the base, and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 2 * CHUNK), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS


def hashed_words(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of texts that lie one after another, and how many words each text has.

    A word is a polynomial of its bytes' random numbers; sums up to each byte give those of all words at once.
    """
    data = np.frombuffer(raw.translate(_PLAIN), dtype=np.uint8)
    in_word = np.zeros(len(data) + 1, dtype=bool)
    in_word[:-1] = data != 0x20
    ends = np.cumsum(sizes)
    opens = in_word.copy()
    opens[1:] &= ~in_word[:-1]
    text_starts = (ends - sizes)[sizes > 0]
    opens[text_starts] = in_word[text_starts]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.zeros(len(sizes), dtype=np.int64)
    mixed = np.empty(len(starts), dtype=np.uint64)
    until = np.append(starts[1:], len(data))  # what lies between two words adds nothing
    low = 0
    while low < len(starts):  # words of some CHUNK bytes at a time
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + CHUNK)))
        first, last = starts[low], until[high - 1]
        power, inverse = _powers(last - first + 1)
        sums = np.zeros(last - first + 1, dtype=np.uint64)
        values = _OF_BYTE[data[first:last]]
        values *= in_word[first:last]
        values *= power[: last - first]
        np.cumsum(values, out=sums[1:])
        mixed[low:high] = (sums[until[low:high] - first] - sums[starts[low:high] - first]) * inverse[starts[low:high] - first]
        low = high
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return mixed, np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(sizes))


def short_words(hashes: np.ndarray) -> bytes:
    """``_BYTES`` bytes of each word's hash."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :_BYTES]).tobytes()


def from_short(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // _BYTES, 4), dtype=np.uint8)
    out[:, :_BYTES] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, _BYTES)
    return out.view(np.uint32).ravel()


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` words from each place on; there are at least ``k`` words."""
    n = len(hashes) - k + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for step in range(k):
        mixed = (mixed ^ hashes[step : step + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def long_grams(hashes: np.ndarray, counts: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place of the runs of ``LEAST_PIECE`` words whose least seed is among ``shared``, which is sorted.

    Given are the words of texts that follow each other, and how many each has.
    """
    if len(hashes) < LEAST_PIECE or not len(shared):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    ends = np.cumsum(counts)
    grams, width = gram_hashes(hashes, SEED_WORDS), LEAST_PIECE - SEED_WORDS + 1
    least = grams[: len(grams) - width + 1].copy()
    for step in range(1, width):
        np.minimum(least, grams[step : step + len(least)], out=least)
    least = remixed(least)
    at = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, least), len(shared) - 1)] == least)
    text = np.searchsorted(ends, at, side="right")
    within = at + LEAST_PIECE <= ends[text]
    at, text = at[within], text[within]
    return gram_hashes(hashes, LEAST_PIECE)[at], text, at - (ends - counts)[text]


def seeds(hashes: np.ndarray, counts: np.ndarray, k: int = SEED_WORDS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place of the chosen seeds of texts that follow each other, in order of text and place.

    Of ``window`` neighbouring runs of ``k`` words the first with the least hash; a text with fewer of them is one window.
    """
    none = np.empty(0, dtype=np.int64)
    if len(hashes) < k:
        return np.empty(0, dtype=np.uint64), none, none
    grams = gram_hashes(hashes, k)
    ends = np.cumsum(counts)
    starts, own = ends - counts, np.maximum(counts - k + 1, 0)
    chosen = []
    if len(grams) >= window:
        # the least of 1, 2, 4 … neighbours and where it is; a window over the end of a text is not used
        best, place, reach = grams, np.arange(len(grams)), 1
        while reach < window:
            step = min(reach, window - reach)
            left, right = best[: len(best) - step], best[step:]
            take = right < left
            best, place = np.where(take, right, left), np.where(take, place[step:], place[: len(place) - step])
            reach += step
        text = np.searchsorted(ends, np.arange(len(best)), side="right")
        chosen.append(place[np.arange(len(best)) + window + k - 1 <= ends[text]])
    for i in np.flatnonzero((own > 0) & (own < window)).tolist():
        chosen.append(np.array([starts[i] + grams[starts[i] : starts[i] + own[i]].argmin()]))
    place = np.unique(np.concatenate(chosen)) if chosen else none
    text = np.searchsorted(ends, place, side="right")
    return remixed(grams[place]), text, place - starts[text]


def segments(pair: np.ndarray, mine: np.ndarray, theirs: np.ndarray, k: int = SEED_WORDS, reach: int = 2 * WINDOW) -> tuple[np.ndarray, ...]:
    """Matches of one pair that follow each other on one diagonal: pair, my start, their start and words, in order of pair and my start."""
    order = np.lexsort((mine, theirs - mine, pair))
    pair, mine, theirs = pair[order], mine[order], theirs[order]
    cut = np.flatnonzero((np.diff(pair) != 0) | (np.diff(theirs - mine) != 0) | (np.diff(mine) > reach)) + 1
    heads = np.append(0, cut)[: len(pair)]
    tails = np.append(cut, len(mine))[: len(heads)] - 1
    pair, mine, theirs, n = pair[heads], mine[heads], theirs[heads], mine[tails] - mine[heads] + k
    order = np.lexsort((theirs, mine, pair))
    return pair[order], mine[order], theirs[order], n[order]


class PrefixMaximum:
    """A Fenwick tree of the largest value, and whose it is, up to each place."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, place: int, value: tuple[float, int]) -> None:
        place += 1
        while place < len(self.best):
            if value > self.best[place]:
                self.best[place] = value
            place += place & -place

    def up_to(self, places: int) -> tuple[float, int]:
        found = self.best[0]
        while places:
            found = max(found, self.best[places])
            places -= places & -places
        return found


def chains(parts: list[tuple[int, int, int]], gap_cost: float = GAP_COST, gap: int = GAP) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of segments, the best first; each segment is in one chain.

    What a chain is worth to the segment after it is bounded by the cost of ``2 * gap`` words, so none is linked over more than that on both
    sides together, and the tree's maximum is the best of those that can be linked.
    """
    most = 2 * gap * gap_cost
    theirs = sorted({a + n for _, a, n in parts})
    tree = PrefixMaximum(len(theirs))
    by_end = sorted(range(len(parts)), key=lambda i: parts[i][0] + parts[i][2])
    score, before, passed = [0.0] * len(parts), [-1] * len(parts), 0
    for j, (c, a, n) in enumerate(parts):
        while passed < len(parts) and parts[by_end[passed]][0] + parts[by_end[passed]][2] <= c:
            i = by_end[passed]
            end_c, end_a = parts[i][0] + parts[i][2], parts[i][1] + parts[i][2]
            if i < j:
                tree.put(bisect_left(theirs, end_a), (min(score[i], most) + gap_cost * (end_c + end_a), i))
            passed += 1
        value, i = tree.up_to(bisect_right(theirs, a))
        gain = value - gap_cost * (c + a)
        score[j] = float(n)
        if gain > 0:
            before[j] = i
            score[j] += gain
    used, out = [False] * len(parts), []
    for j in sorted(range(len(parts)), key=lambda j: -score[j]):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(parts[j])
            j = before[j]
        if chain:
            out.append(chain[::-1])
    return out


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places in both of the words of a longest common subsequence of two short runs; words that one of them lacks take no part."""
    in_b = set(b)
    mine = [i for i, word in enumerate(a) if word in in_b]
    if not mine:
        return []
    in_a = {a[i] for i in mine}
    theirs = [j for j, word in enumerate(b) if word in in_a]
    best = [[0] * (len(theirs) + 1)]
    for at in mine:
        word, above, row = a[at], best[-1], [0]
        for j, other in enumerate(theirs):
            row.append(max(above[j + 1], row[j], above[j] + (b[other] == word)))
        best.append(row)
    out, i, j = [], len(mine), len(theirs)
    while best[i][j]:
        if best[i - 1][j] == best[i][j]:
            i -= 1
        elif best[i][j - 1] == best[i][j]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((mine[i], theirs[j]))
    return out[::-1]


def matches(mine: np.ndarray, theirs: np.ndarray, chain: list[tuple[int, int, int]]) -> tuple[np.ndarray, tuple[int, int, int, int]]:
    """For each of my words the place of its equal in the other run or -1; my start and end, and theirs."""
    c, a, _ = chain[0]
    own, other = mine.tolist(), theirs.tolist()
    while c and a and own[c - 1] == other[a - 1]:
        c, a = c - 1, a - 1
    at_c, at_a, where = c, a, np.full(len(mine), -1, dtype=np.int64)
    for i, (start_c, start_a, n) in enumerate(chain):
        if i == 0:
            start_c, start_a, n = c, a, n + chain[0][0] - c
        if start_c < at_c or start_a < at_a:  # the segment before has grown into this one
            skip = max(at_c - start_c, at_a - start_a)
            start_c, start_a, n = start_c + skip, start_a + skip, n - skip
        if n <= 0:
            continue
        if start_c > at_c and start_a > at_a:
            for x, y in _common(own[at_c:start_c], other[at_a:start_a]):
                where[at_c + x] = at_a + y
        equal = np.flatnonzero(mine[start_c : start_c + n] == theirs[start_a : start_a + n])
        where[start_c + equal] = start_a + equal
        at_c, at_a = start_c + n, start_a + n
        stop_c, stop_a = (chain[i + 1][0], chain[i + 1][1]) if i + 1 < len(chain) else (len(mine), len(theirs))
        while at_c < stop_c and at_a < stop_a and own[at_c] == other[at_a]:
            where[at_c] = at_a
            at_c, at_a = at_c + 1, at_a + 1
    return where, (c, at_c, a, at_a)


def align(mine: np.ndarray, theirs: np.ndarray, chain: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int]:
    """My start and end, theirs, and the words that agree. Positions are those within the two runs of hashes."""
    where, ends = matches(mine, theirs, chain)
    return *ends, int((where >= 0).sum())


def matched_runs(where: np.ndarray) -> np.ndarray:
    """Rows of my start, their start and words: what agrees without a break in either text."""
    own = np.flatnonzero(where >= 0)
    cut = np.flatnonzero((np.diff(own) != 1) | (np.diff(where[own]) != 1)) + 1
    heads = np.append(0, cut)[: len(own)]
    return np.stack([own[heads], where[own[heads]], np.diff(np.append(heads, len(own)))], axis=1)


def stretches(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, end and matched words of the stretches that are long and alike enough and lie in no other one.

    Given are the matched runs, in order of ``start``; they may overlap.
    """
    reached = np.maximum.accumulate(end)
    heads = np.flatnonzero(np.append(True, start[1:] > reached[:-1]))
    low, high = start[heads], reached[np.append(heads[1:], len(start)) - 1]
    sum_high = np.cumsum(high - low)
    sum_low = sum_high - (high - low)
    # a stretch from run i to run j is alike enough if the surplus of matched words at the end of j is not below that at the start of i
    at_end, at_start = sum_high - SIMILARITY * high, sum_low - SIMILARITY * low
    best_from = np.maximum.accumulate(at_end[::-1])[::-1]
    last = np.searchsorted(-best_from, -(at_start - 1e-6), side="right") - 1
    found, so_far = [], -1
    for i, j in enumerate(last.tolist()):
        if j > so_far and high[j] - low[i] >= LEAST_WORDS:
            found.append((int(low[i]), int(high[j]), int(sum_high[j] - sum_low[i])))
            so_far = j
    return found


def range_cuts(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where the ranges of the first ``bits`` bits begin in sorted hashes, and the end."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2 … up to each of the sizes, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it; the first one does."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return new


class SeedBlock:
    """The words and seeds of a block's texts, seeds in order of hash, text and place.

    The block reports each hash once, with its places; of one in more than ``EVERY`` places with the first only, and the texts after it meet that one and
    the one before them within the block.
    """

    def __init__(self, row: dict) -> None:
        raw = zstandard.ZstdDecompressor().decompress(row["texts"]) if row["texts"] else b""
        self.numbers = np.frombuffer(row["orders"], dtype=np.int64)
        self.hashes, self.counts = hashed_words(raw, np.frombuffer(row["sizes"], dtype=np.int64))
        self.starts = np.cumsum(self.counts) - self.counts
        hashes, doc, places = seeds(self.hashes, self.counts)
        order = np.lexsort((places, self.numbers[doc], hashes))
        hashes, doc, places = hashes[order], doc[order], places[order]
        # a seed that comes again at once, as in a word said over and over, stands for STEP words of such a run
        new = _changes(hashes, doc, places // STEP)
        self.hash, self.doc, self.place = hashes[new], doc[new], places[new]
        first = _changes(self.hash, self.doc)
        self.first = np.flatnonzero(first)  # of each text with a hash, its first place
        self.entry = np.cumsum(first) - 1  # of each seed, which of these is its own
        head = _changes(self.hash[self.first])
        self.head = np.flatnonzero(head)  # of the entries, the first of each hash
        self.kind = (np.cumsum(head) - 1)[self.entry]  # of each seed, which of the hashes it has
        self.times = np.bincount(self.kind, minlength=len(self.head))

    def reported(self) -> np.ndarray:
        """The seeds this block reports: the first of each hash."""
        return self.first[self.head]

    def told(self) -> np.ndarray:
        """The seeds whose places the reports have."""
        told = (self.times <= EVERY)[self.kind]
        told[self.reported()] = True
        return np.flatnonzero(told)

    def known(self, shared: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each hash, whether another text has it, and whether it is a common one, out of the answers for the places told."""
        kind, n = self.kind[self.told()], len(self.head)
        repeated = np.diff(np.append(self.head, len(self.first))) > 1
        return repeated | (np.bincount(kind, shared, n) > 0), (self.times > EVERY) | (np.bincount(kind, common, n) > 0)

    def links(self, n: np.ndarray, partners: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, ...]:
        """Number, place, partner and their place of matches of seeds, out of the ``n`` answers for each place told."""
        told, often = self.told(), np.flatnonzero((self.times > EVERY)[self.kind])
        head = self.head[self.kind[often]]
        of_head = self.entry[often] == head
        again = often[of_head & (often != self.first[head])]  # other places of the text that the block reports
        own = np.concatenate([told, again])
        answer = np.searchsorted(told, np.concatenate([told, self.reported()[self.kind[again]]]))
        at = np.repeat((np.cumsum(n) - n)[answer], n[answer]) + _within(n[answer])
        own = np.repeat(own, n[answer])
        later, one = often[~of_head], self.first[head[~of_head]]
        two = self.first[self.entry[later] - 1]
        inside, other = np.concatenate([later, later[two != one]]), np.concatenate([one, two[two != one]])
        mine = np.concatenate([own, inside])
        partner = np.concatenate([partners[at], self.numbers[self.doc[other]]])
        return self.numbers[self.doc[mine]], self.place[mine].astype(np.int32), partner, np.concatenate([theirs[at], self.place[other].astype(np.int32)])

    def pairs(self, shared: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, ...]:
        """Key, hash of the words from the first seed to the second, number, place, distance and how many it stands for, of pairs of shared seeds.

        One of the two is common. They are in order of key; of one wording in more than ``EVERY`` places only the first is given.
        """
        at = np.flatnonzero(shared[self.kind])
        at = at[np.lexsort((self.place[at], self.doc[at]))]
        doc, place, often = self.doc[at], self.place[at], common[self.kind[at]]
        left, right, step = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], 1
        while step < len(at) and (near := (doc[step:] == doc[:-step]) & (place[step:] - place[:-step] <= REACH)).any():
            left.append(np.flatnonzero(near & (often[step:] | often[:-step])))
            right.append(left[-1] + step)
            step += 1
        one, two = at[np.concatenate(left)], at[np.concatenate(right)]
        key = remixed(remixed(self.hash[one]) ^ (self.hash[two] * np.uint64(_BASE)))
        power, inverse = _powers(len(self.hashes) + 1)
        sums = np.append(np.uint64(0), np.cumsum(self.hashes * power[: len(self.hashes)]))
        low, high = self.starts[self.doc[one]] + self.place[one], self.starts[self.doc[two]] + self.place[two] + SEED_WORDS
        wording = remixed((sums[high] - sums[low]) * inverse[low] + (high - low).astype(np.uint64))
        number, place, apart = self.numbers[self.doc[one]], self.place[one], self.place[two] - self.place[one]
        order = np.lexsort((place, number, wording, key))
        key, wording, number, place, apart = (column[order] for column in (key, wording, number, place, apart))
        new = _changes(key, wording)
        times = np.diff(np.append(np.flatnonzero(new), len(new)))[np.cumsum(new) - 1]
        kept = new | (times <= EVERY)
        times = np.where(times > EVERY, times, 1)
        return tuple(column[kept] for column in (key, wording, number, place.astype(np.int32), apart.astype(np.int32), times.astype(np.int32)))


def _unpacked(reports: pa.Table, **kinds: type) -> list[np.ndarray]:
    """Columns of packed numbers, one after another; those of ``hashes`` ascend in each report."""
    return [np.concatenate([np.empty(0, kind), *(unpack(x.as_py(), kind, name == "hashes") for x in reports[name])]) for name, kind in kinds.items()]


def _partners(reports: pa.Table) -> pa.Table:
    """For each place told of a seed: its places in all earlier texts, or of a common seed in the first text and the one before.

    Further ``n``, how many these are, and whether another of these texts has the seed (1) and whether it is common (2).
    """
    hashes, numbers, places, times = _unpacked(reports, hashes=np.uint64, numbers=np.int64, places=np.int32, times=np.int32)
    told = np.where(times > EVERY, 1, times)
    sizes = np.add.reduceat(told, np.append(0, np.cumsum([x.as_py() for x in reports["n"]])[:-1]))
    hashes, times = np.repeat(hashes, told), np.repeat(times // told, told)
    order = np.lexsort((places, numbers, hashes))
    hashes, numbers, places, times = hashes[order], numbers[order], places[order], times[order]
    new, new_text = _changes(hashes), _changes(hashes, numbers)
    kind, text = np.cumsum(new) - 1, np.cumsum(new_text) - 1
    start, text_start = np.flatnonzero(new)[kind], np.flatnonzero(new_text)
    own = text_start[text]
    before = text_start[text[np.maximum(own - 1, 0)]]
    common = (np.bincount(kind, times) > EVERY)[kind]
    n = np.where(common, (own > start).astype(np.int64) + ((own > start) & (before > start)), own - start)
    flags = ((np.bincount(kind[text_start]) > 1)[kind] + 2 * common).astype(np.uint8)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    step = _within(n[rank])
    row = np.repeat(rank, n[rank])
    at = np.where(common[row] & (step > 0), before[row], start[row] + step)
    cuts = np.cumsum(sizes)[:-1]
    found_cuts = np.append(0, np.cumsum(n[rank]))[cuts]
    columns = {"met": (n[rank].astype(np.int32), cuts), "flags": (flags[rank], cuts), "partners": (numbers[at], found_cuts), "theirs": (places[at], found_cuts)}
    out: dict = {"block": reports["block"], "part": reports["part"]}
    for name, (column, bounds) in columns.items():
        out[name] = pa.array([pack(part) for part in np.split(column, bounds)], pa.binary())
    return pa.table(out)


def _pair_links(reports: pa.Table) -> pa.Table:
    """Matches of the seeds of pairs, by block: of each place with all earlier texts, or of common pairs of the first text of each wording with those of others.

    Of more than ``EVERY`` wordings, these are the references and the text before.
    """
    block = np.repeat(reports["block"].to_numpy(), [x.as_py() for x in reports["n"]])
    kinds = {"hashes": np.uint64, "wordings": np.uint64, "numbers": np.int64, "places": np.int32, "apart": np.int32, "times": np.int32}
    key, wording, number, place, apart, times = _unpacked(reports, **kinds)
    order = np.lexsort((place, number, wording, key))
    key, wording, number, times = key[order], wording[order], number[order], times[order]
    kind = np.cumsum(_changes(key)) - 1
    kept = (np.bincount(kind, times) <= EVERY)[kind] | _changes(key, wording)
    order, key, number = order[kept], key[kept], number[kept]
    again = np.lexsort((place[order], number, key))
    order, key, number = order[again], key[again], number[again]
    block, place, apart = block[order], place[order], apart[order]
    new, new_text = _changes(key), _changes(key, number)
    kind = np.cumsum(new) - 1
    start, text_start = np.flatnonzero(new)[kind], np.flatnonzero(new_text)[np.cumsum(new_text) - 1]
    many = (np.bincount(kind) > EVERY)[kind]
    # of many classes, a reference is one whose seeds stand nearer to each other than those of all before it
    least = np.minimum.accumulate(apart - 2 * REACH * kind)
    reference = _changes(least)
    references = np.flatnonzero(reference)
    n_before = np.cumsum(reference) - reference
    n_references = n_before[text_start] - n_before[start]
    before = text_start[np.maximum(text_start - 1, 0)]
    n = np.where(many, n_references + ((text_start > start) & ~reference[before]), text_start - start)
    out = []
    for rows in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // LINKS)) + 1):
        rows = rows[np.argsort(block[rows], kind="stable")]
        for own in np.split(rows, np.flatnonzero(np.diff(block[rows])) + 1):
            if len(own) and n[own].sum():
                step = _within(n[own])
                own = np.repeat(own, n[own])
                of_many = many[own] & (step < n_references[own])
                other = np.where(many[own], before[own], start[own] + step)
                other[of_many] = references[(n_before[start[own]] + step)[of_many]]
                for marked in (False, True):
                    x, y = own[of_many == marked], other[of_many == marked]
                    if len(x):
                        mine, theirs = (np.concatenate([place[at], place[at] + apart[at]]) for at in (x, y))
                        out.append((int(block[x[0]]), pack(np.tile(number[x], 2)), pack(mine), pack(np.tile(number[y], 2)), pack(theirs), marked))
    kinds = [pa.int64(), *[pa.binary()] * 4, pa.bool_()]
    return pa.table([pa.array(column, kind) for column, kind in zip(zip(*out) if out else [[]] * 6, kinds)], names=_names(_MARKED))


_CHAIN = "number long, partner long, start int, size int, their_start int, their_size int, chain binary, words binary, reference boolean, inside boolean, known binary"


_REPORT = "part int, block long, n int, hashes binary, numbers binary, places binary, times binary"
_PAIR = f"{_REPORT}, wordings binary, apart binary"
_MET = "block long, numbers binary, mine binary, partners binary, theirs binary"
_MARKED = f"{_MET}, reference boolean"
_PIECE = "number long, start long, end long, partner long, runs binary"
_ALIGNED = f"{_PIECE}, n int, at int, words binary, places array<int>, keys array<long>, asks array<boolean>"
#: Matches that one row of them holds, but for those of one place.
LINKS = 1 << 18


def _names(kinds: str) -> list[str]:
    return [part.split()[0] for part in kinds.split(", ")]


def _met_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), *[pa.binary()] * 4]
    return pa.table([pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=_names(_MET))


def _long_matches(reports: pa.Table) -> pa.Table:
    """Matches of long runs of words with the first text that has them and the one before, by block."""
    sizes = [x.as_py() for x in reports["n"]]
    block = np.repeat(reports["block"].to_numpy(), sizes)
    hashes = np.concatenate([unpack(x.as_py(), np.uint64, True) for x in reports["hashes"]])
    numbers = np.concatenate([unpack(x.as_py(), np.int64) for x in reports["numbers"]])
    places = np.concatenate([unpack(x.as_py(), np.int32) for x in reports["places"]])
    order = np.lexsort((places, numbers, hashes))
    block, hashes, numbers, places = block[order], hashes[order], numbers[order], places[order]
    new = np.append(True, hashes[1:] != hashes[:-1])
    new_text = new | np.append(True, numbers[1:] != numbers[:-1])
    first, text = np.flatnonzero(new)[np.cumsum(new) - 1], np.cumsum(new_text) - 1
    starts = np.flatnonzero(new_text)
    later = np.flatnonzero(starts[text] != first)
    previous = starts[text[later] - 1]
    two = previous != first[later]
    own, other = np.concatenate([later, later[two]]), np.concatenate([first[later], previous[two]])
    order = np.argsort(block[own], kind="stable")
    own, other = own[order], other[order]
    out = []
    for at in np.split(np.arange(len(own)), np.flatnonzero(np.diff(block[own])) + 1):
        if len(at):
            out.append((int(block[own[at[0]]]), pack(numbers[own[at]]), pack(places[own[at]]), pack(numbers[other[at]]), pack(places[other[at]])))
    return _met_table(out)


def _long_runs(told: pa.Table) -> pa.Table:
    """The matches of a block's texts that overlap on one diagonal as one piece each, but for those inside another.

    A piece inside another matches no more words, nor does most of a passage stand in it.
    """
    kinds = {"numbers": np.int64, "mine": np.int32, "partners": np.int64, "theirs": np.int32}
    number, mine, partner, theirs = (np.concatenate([unpack(x.as_py(), kind) for x in told[name]]) for name, kind in kinds.items())
    order = np.lexsort((mine, theirs - mine, partner, number))
    number, mine, partner, theirs = number[order], mine[order], partner[order], theirs[order]
    breaks = (np.diff(number) != 0) | (np.diff(partner) != 0) | (np.diff(theirs - mine) != 0) | (np.diff(mine) > LEAST_PIECE)
    heads, tails = np.append(0, np.flatnonzero(breaks) + 1), np.append(np.flatnonzero(breaks), len(mine) - 1)
    number, partner, start, end, theirs = number[heads], partner[heads], mine[heads], mine[tails] + LEAST_PIECE, theirs[heads]
    order = np.lexsort((-theirs, partner, -end, start, number))
    number, partner, start, end, theirs = number[order], partner[order], start[order], end[order], theirs[order]
    reach = (np.cumsum(np.append(True, np.diff(number) != 0)) << 32) + end
    outer = np.append(True, reach[1:] > np.maximum.accumulate(reach)[:-1])
    number, partner, start, end, theirs = number[outer], partner[outer], start[outer], end[outer], theirs[outer]
    runs = [row.tobytes() for row in np.stack([start, theirs, end - start], axis=1).astype(np.int32)]
    columns = [pa.array(x.astype(np.int64)) for x in (number, start, end, partner)]
    return pa.table([*columns, pa.array(runs, pa.binary())], names=["number", "start", "end", "partner", "runs"])


def long_pieces(met: DataFrame) -> DataFrame:
    """``number, start, end, partner, runs`` of runs of ``LEAST_PIECE`` words and more that stand in an earlier text."""
    return met.groupBy("block").applyInArrow(_long_runs, _PIECE)


class LongRuns:
    """Where each text of a block has long runs that an earlier text has, in order of start and, as none lies in another, of end."""

    def __init__(self, told: pa.Table) -> None:
        self.of: dict[int, tuple[list[int], list[int]]] = {}
        if told.num_rows:
            for number, start, end in zip(*(column.to_pylist() for column in _long_runs(told).columns[:3])):
                starts, ends = self.of.setdefault(number, ([], []))
                starts.append(start)
                ends.append(end)

    def hold(self, number: int, start: int, end: int) -> bool:
        """Whether one run has all these words."""
        starts, ends = self.of.get(number, ([], []))
        at = bisect_right(starts, start) - 1
        return at >= 0 and ends[at] >= end

    def within(self, number: int, start: int, end: int) -> bytes:
        """Starts and ends of the runs that have some of these words, counted from the first of these."""
        starts, ends = self.of.get(number, ([], []))
        low, high = bisect_right(ends, start), bisect_left(starts, end)
        return (np.array([starts[low:high], ends[low:high]], dtype=np.int32) - np.int32(start)).tobytes()


def chained(texts: DataFrame, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Stored chains between a text and an earlier one, with the words of the text around them, and stored matches of long runs.

    A chain that lies in one long run, with as many words on each side as an exact run of it can have beyond its seeds without being a long one
    itself, is ``inside``: its words are matched without it, and most of no passage stands in it.
    """
    blocks = blocks_of(texts, block_bytes)
    bits = max(LEAST_RANGES, blocks.count() // 16).bit_length()

    def by_part(block: int, hashes: np.ndarray, **columns: tuple[np.ndarray | None, np.ndarray]) -> list[dict]:
        """A report for each range of the sorted hashes; columns with several values for a hash say where those of each end."""
        out, cuts = [], range_cuts(hashes, bits).tolist()
        for part, (low, high) in enumerate(zip(cuts, cuts[1:])):
            if high > low:
                packed = {}
                for name, (until, column) in columns.items():
                    own = slice(low, high) if until is None else slice(until[low - 1] if low else 0, until[high - 1])
                    packed[name] = pack(column[own])
                out.append({"part": part, "block": block, "n": high - low, "hashes": pack(hashes[low:high], True), **packed})
        return out

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 1):
            row = batch.to_pylist()[0]
            found = SeedBlock(row)
            told = found.told()
            until = np.cumsum(np.where(found.times > EVERY, 1, found.times))
            columns = {"numbers": (until, found.numbers[found.doc[told]]), "places": (until, found.place[told].astype(np.int32)), "times": (None, found.times.astype(np.int32))}
            fields = [pa.field(name, {"n": pa.int32(), "part": pa.int32(), "block": pa.int64()}.get(name, pa.binary())) for name in _names(_REPORT)]
            yield pa.RecordBatch.from_pylist(by_part(row["block"], found.hash[found.reported()], **columns), schema=pa.schema(fields))

    reports = blocks.mapInArrow(report, _REPORT)
    partners = reports.groupBy("part").applyInArrow(_partners, "block long, part int, met binary, flags binary, partners binary, theirs binary")

    def link(block: pa.Table, told: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        found = SeedBlock(row)
        n, flags, partners, theirs = _unpacked(told.sort_by("part"), met=np.int32, flags=np.uint8, partners=np.int64, theirs=np.int32)
        shared, common = found.known(flags & 1, flags & 2)
        linked = found.links(n.astype(np.int64), partners, theirs)
        rows = [{"kind": 0, "block": row["block"], **dict(zip(_names(_MET)[1:], map(pack, linked)))}] if len(linked[0]) else []
        key, *columns = found.pairs(shared, common)
        pairs = dict(zip(("wordings", "numbers", "places", "apart", "times"), columns))
        rows += [{"kind": 1, **x} for x in by_part(row["block"], key, **{name: (None, column) for name, column in pairs.items()})]
        rows += long_runs(found, found.hash[found.reported()][shared], row["block"])
        fields = {"kind": pa.int32(), "part": pa.int32(), "block": pa.int64(), "n": pa.int32()}
        return pa.Table.from_pylist(rows, schema=pa.schema([(name, fields.get(name, pa.binary())) for name in _names(every)]))

    def chain(block: pa.Table, told: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        of_long = told["reference"].is_null()
        runs, told = LongRuns(told.filter(of_long)), told.filter(pa.compute.invert(of_long))
        numbers, mine, partner, theirs = _unpacked(told, numbers=np.int64, mine=np.int32, partners=np.int64, theirs=np.int32)
        if len(numbers):
            marked = _unpacked(told.filter(told["reference"]), numbers=np.int64, partners=np.int64)
            marked = set(zip(*(column.tolist() for column in marked)))
            rows = chains_of(block.to_pylist()[0], numbers, mine.astype(np.int64), partner, theirs.astype(np.int64), marked, runs)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_(), pa.binary()]
        return pa.table([pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [[]] * 11, kinds)], names=_names(_CHAIN))

    def chains_of(block: dict, numbers: np.ndarray, mine: np.ndarray, partner: np.ndarray, theirs: np.ndarray, marked: set, runs: LongRuns) -> list[tuple]:
        order = np.lexsort((theirs, mine, partner, numbers))
        order = order[_changes(numbers[order], partner[order], mine[order], theirs[order])]  # a match may be in many pairs
        numbers, mine, partner, theirs = numbers[order], mine[order], partner[order], theirs[order]
        hashes, counts = hashed_words(zstandard.ZstdDecompressor().decompress(block["texts"]), np.frombuffer(block["sizes"], dtype=np.int64))
        texts = dict(zip(np.frombuffer(block["orders"], dtype=np.int64).tolist(), np.split(hashes, np.cumsum(counts)[:-1])))
        new, rows = _changes(numbers, partner), []
        heads = np.flatnonzero(new)
        part, c, a, n = segments(np.cumsum(new) - 1, mine, theirs)
        bounds = np.append(np.flatnonzero(_changes(part)), len(part)).tolist()
        c, a, n = c.tolist(), a.tolist(), n.tolist()
        for low, high in zip(bounds, bounds[1:]):
            own, other = int(numbers[heads[part[low]]]), int(partner[heads[part[low]]])
            words = texts[own]
            if high - low == 1:
                linked = [[(c[low], a[low], n[low])]]
            else:
                linked = chains(list(zip(c[low:high], a[low:high], n[low:high])))
            for parts in linked:
                if len(parts) == 1 and parts[0][2] == SEED_WORDS:  # an unbroken run of words: of 12 words and more these are joined as such
                    continue
                (c0, a0, _), (last_c, last_a, last_n) = parts[0], parts[-1]
                start, end = max(0, c0 - MARGIN), min(len(words), last_c + last_n + MARGIN)
                their_start, their_end = max(0, a0 - MARGIN), last_a + last_n + MARGIN
                shifted = np.array([(x - start, y - their_start, size) for x, y, size in parts], dtype=np.int32)
                beyond = LEAST_PIECE - SEED_WORDS - 1
                inside = runs.hold(own, max(0, c0 - beyond), min(len(words), last_c + last_n + beyond))
                reference = not inside and (own, other) in marked
                told = (reference, inside, runs.within(own, start, end) if reference else None)
                rows.append((own, other, start, end - start, their_start, their_end - their_start, shifted.tobytes(), b"" if inside else short_words(words[start:end]), *told))
        return rows

    def long_runs(found: SeedBlock, shared: np.ndarray, block: int) -> list[dict]:
        """Reports of the long runs, each in the block's first text that has it, and the matches of the texts after that one with it."""
        hashes, doc, places = long_grams(found.hashes, found.counts, shared)
        order = np.lexsort((places, found.numbers[doc], hashes))
        hashes, numbers, places = hashes[order], found.numbers[doc[order]], places[order].astype(np.int32)
        new = _changes(hashes)
        first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(hashes) else np.empty(0, dtype=np.int64)
        of_first = numbers == numbers[first]
        later = np.flatnonzero(~of_first)
        out = [{"kind": 2, **x} for x in by_part(block, hashes[of_first], numbers=(None, numbers[of_first]), places=(None, places[of_first]))]
        if len(later):
            packed = pack(numbers[later]), pack(places[later]), pack(numbers[first[later]]), pack(places[first[later]])
            out.append({"kind": 3, "block": block, **dict(zip(_names(_MET)[1:], packed))})
        return out

    every = f"kind int, {_PAIR}, mine binary, partners binary, theirs binary"
    together = blocks.groupBy("block").cogroup(materialise(partners, "partners").groupBy("block"))
    told = materialise(together.applyInArrow(link, every), "links")
    paired = told.where("kind = 1").select(_names(_PAIR)).groupBy("part").applyInArrow(_pair_links, _MARKED)
    linked = told.where("kind = 0").select(*_names(_MET), F.lit(False).alias("reference")).unionAll(paired)
    long_found = told.where("kind = 2").select([name for name in _names(_REPORT) if name != "times"]).groupBy("part").applyInArrow(_long_matches, _MET)
    long_met = materialise(told.where("kind = 3").select(_names(_MET)).unionAll(long_found), "long-matches")
    linked = linked.unionAll(long_met.withColumn("reference", F.lit(None).cast("boolean")))
    found = blocks.groupBy("block").cogroup(linked.groupBy("block")).applyInArrow(chain, _CHAIN)
    return materialise(found, "chains"), long_met


def pieces(found: DataFrame, texts: DataFrame) -> DataFrame:
    """``number, start, end, partner, runs`` of every aligned piece, those of texts that meet through a reference included; the runs say which of its words are matched, and where.

    Chains meet the words of the earlier text in a join whose skewed side Spark splits; of these words only the chain's own stretch goes on.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 128):
            raw = text_bytes(batch.column(1))
            hashes, counts = hashed_words(b"".join(raw), np.array([len(text) for text in raw], dtype=np.int64))
            words = [short_words(own) for own in np.split(hashes, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], ["partner", "their_words"])

    found = found.where("not inside")
    wanted = materialise(found.select(F.col("partner").alias("doc_order")).distinct(), "partner-texts")
    earlier = join_counted(texts.select("doc_order", "text"), wanted, ["doc_order"], "left_semi")
    words = earlier.mapInArrow(hashed, "partner long, their_words binary")
    stretch = F.substr("their_words", F.col("their_start") * _BYTES + 1, F.col("their_size") * _BYTES)
    joined = found.join(words, "partner").withColumn("their_words", stretch)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 512):
            out = []
            for number, partner, start, their_start, chain, mine, theirs, reference, known in zip(*(batch.column(i).to_pylist() for i in range(9))):
                parts = [tuple(part) for part in np.frombuffer(chain, dtype=np.int32).reshape(-1, 3).tolist()]
                words = from_short(mine)
                where, (c0, c1, _, _) = matches(words, from_short(theirs), parts)
                own, keys, asks = differences(words, where, partner, their_start, known) if reference and (where[c0:c1] < 0).any() else [[]] * 3
                n = int((where >= 0).sum())
                if n >= LEAST_PIECE or len(own):
                    runs = matched_runs(where) + (start, their_start, 0)
                    told = (start, mine, own, keys, asks) if len(own) else [None] * 5
                    out.append((number, start + c0, start + c1, partner, runs.astype(np.int32).tobytes(), n, *told))
            kinds = [*[pa.int64()] * 4, pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out) if out else [[]] * 11, kinds)], _names(_ALIGNED))

    ready = joined.select("number", "partner", "start", "their_start", "chain", "words", "their_words", "reference", "known")
    numbered = ready.mapInArrow(aligned, _ALIGNED).withColumn("piece", F.monotonically_increasing_id())
    stored = materialise(numbered, "aligned")
    return stored.where(F.col("n") >= LEAST_PIECE).select(_names(_PIECE)).unionAll(alike_pieces(stored))


def differences(words: np.ndarray, where: np.ndarray, partner: int, their_start: int, known: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words that a text has between matched ones and the reference has not, keys of them, and which are in no long run.

    A word has keys with the matched word before it, with that after it, and with the stretch of the reference that it belongs to, in this order.
    """
    own = np.flatnonzero(where >= 0)
    at = np.flatnonzero(where < 0)
    after = np.searchsorted(own, at)
    at, after = at[(after > 0) & (after < len(own))], after[(after > 0) & (after < len(own))]
    left, right = where[own[after - 1]] + their_start, where[own[after]] + their_start
    places = np.stack([4 * left, 4 * right + 1, 4 * (left // STRETCH) + 2, 4 * (left // STRETCH) + 6], axis=1).ravel().astype(np.uint64)
    key = remixed(np.repeat(words[at].astype(np.uint64), 4) + (places << np.uint64(24)))
    starts, ends = np.frombuffer(known, dtype=np.int32).reshape(2, -1)
    held = np.searchsorted(starts, at, side="right") - 1
    asks = (held < 0) | (np.append(ends, 0)[held] <= at)
    return at.astype(np.int32), remixed(key ^ (np.uint64(partner) * np.uint64(_BASE))).view(np.int64), asks


def through(mine: list[list[int]], theirs: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    """Chains of the words of two texts that are matched with the same words of a third, given the runs that each has in common with that."""
    parts, i, j = [], 0, 0
    while i < len(mine) and j < len(theirs):
        (a, same_a, n_a), (b, same_b, n_b) = mine[i], theirs[j]
        low, high = max(same_a, same_b), min(same_a + n_a, same_b + n_b)
        if low < high:
            parts.append((a + low - same_a, b + low - same_b, high - low))
        i, j = (i + 1, j) if same_a + n_a == high else (i, j + 1)
    out: list[list[tuple[int, int, int]]] = []
    for part in parts:
        if out and part[0] + part[1] - sum(out[-1][-1][:2]) - 2 * out[-1][-1][2] < 2 * GAP:
            out[-1].append(part)
        else:
            out.append([part])
    return out


def alike_pieces(stored: DataFrame) -> DataFrame:
    """Pieces of texts that differ from a reference in the same word at the same place: each with the first text that does.

    Each such word that no long run has asks for one text: one in which it follows the same word, else comes before the same word, else is in the same stretch.
    """
    told = stored.where("places is not null")
    each = told.select("piece", "number", "places", "asks", F.posexplode("keys").alias("nth", "key"))
    each = each.selectExpr("piece", "number", "key", "nth % 4 as kind", "places[nth div 4] as place", "asks[nth div 4] as asks")
    firsts = each.groupBy("key").agg(F.min(F.struct("number", "piece")).alias("first"), F.max(F.when(F.col("asks"), F.col("number"))).alias("last"))
    firsts = firsts.where("last > first.number").select("key", F.col("first.piece").alias("other"), F.col("first.number").alias("partner"))
    asked = each.where("asks").join(firsts, "key").where("number > partner")
    answers = asked.groupBy("piece", "place").agg(F.min(F.struct("kind", "other")).alias("best"))
    pairs = answers.select("piece", F.col("best.other").alias("other")).distinct()
    mine = told.select("piece", "number", "at", "words", "runs")
    theirs = told.select(F.col("piece").alias("other"), F.col("number").alias("partner"), F.col("at").alias("their_at"), F.col("words").alias("their_words"), F.col("runs").alias("their_runs"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 512):
            out = []
            for number, start, words, runs, partner, their_start, their_words, their_runs in zip(*(batch.column(i).to_pylist() for i in range(8))):
                one, two = ((np.frombuffer(x, dtype=np.int32).reshape(-1, 3) - (at, 0, 0)).tolist() for x, at in ((runs, start), (their_runs, their_start)))
                own, other = from_short(words), from_short(their_words)
                for parts in through(one, two):
                    where, (c0, c1, _, _) = matches(own, other, parts)
                    if (where >= 0).sum() >= LEAST_PIECE:
                        found = matched_runs(where) + (start, their_start, 0)
                        out.append((number, start + c0, start + c1, partner, found.astype(np.int32).tobytes()))
            kinds = [*[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out) if out else [[]] * 5, kinds)], _names(_PIECE))

    both = pairs.join(mine, "piece").join(theirs, "other")
    return both.select(*mine.columns[1:2], "at", "words", "runs", "partner", "their_at", "their_words", "their_runs").mapInArrow(met, _PIECE)


def island_passages(partners: list[int], runs: list[bytes]) -> list[tuple[int, int, float, int, int]]:
    """``start, end, similarity, partner, source_start`` of the passages of one island, given its pieces."""
    parts = [np.frombuffer(run, dtype=np.int32).reshape(-1, 3).astype(np.int64) for run in runs]
    piece = np.repeat(np.arange(len(parts)), [len(part) for part in parts])
    mine, theirs, n = np.concatenate(parts).T
    order = np.lexsort((piece, mine))
    piece, mine, theirs, n = piece[order], mine[order], theirs[order], n[order]
    out = []
    for start, end, same in stretches(mine, mine + n):
        low, high = np.searchsorted(mine, [start, end])
        held, at, back = np.unique(piece[low:high], return_index=True, return_inverse=True)
        words = np.bincount(back, weights=n[low:high])
        _, partner, source = max((words[i], -partners[held[i]], int(theirs[low + at[i]])) for i in range(len(held)))
        out.append((start, end, same / (end - start), -partner, source))
    return out


_PASSAGE = "number long, start long, end long, similarity double, partner long, source_start long"


def passages(found: DataFrame) -> DataFrame:
    """Neighbouring pieces of a document joined to islands, of these the stretches that are long and alike enough, with where most of each stands."""
    along = W.partitionBy("number").orderBy("start", "end", "partner")
    reached = F.max("end").over(along.rowsBetween(W.unboundedPreceding, -1))
    new = reached.isNull() | (F.col("start") > reached + GAP)
    marked = found.withColumn("new", new.cast("int"))
    marked = marked.withColumn("island", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    islands = marked.groupBy("number", "island").agg(
        (F.max("end") - F.min("start")).alias("words"), F.collect_list("partner").alias("partners"), F.collect_list("runs").alias("runs")
    )
    islands = islands.where(F.col("words") >= LEAST_WORDS).select("number", "partners", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 512):
            columns = (batch.column(i).to_pylist() for i in range(3))
            out = [(number, *row) for number, partners, runs in zip(*columns) for row in island_passages(partners, runs)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            names = [part.split()[0] for part in _PASSAGE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out) if out else [[]] * 6, kinds)], names)

    return islands.mapInArrow(cut, _PASSAGE)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, start_word, end_word, similarity, source_doc_id, source_start``: a row per repeated passage."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    rows = docs.select(F.col(id_col).alias("doc_id"), order.alias("place"), *text_key(text), text.alias("text"))
    firsts = first_rows(rows, "place").orderBy("place", *KEY)
    firsts = materialise(firsts.withColumn("doc_order", F.monotonically_increasing_id()), "numbered")  # rises with the id
    texts = join_counted(rows.select(*KEY, "place", "text"), firsts, [*KEY, "place"], "inner")
    texts = once(texts.select("doc_order", *KEY, "text"), firsts)
    chains_found, met = chained(texts, block_bytes)
    found = materialise(passages(pieces(chains_found, texts).unionAll(long_pieces(met))), "passages")
    names = firsts.select(F.col("doc_order"), F.when(F.col("place") != LAST, F.col("place")).alias("doc_id"))
    own = join_counted(found.withColumnRenamed("number", "doc_order"), names, ["doc_order"], "inner").drop("doc_order")
    source = names.select(F.col("doc_order").alias("partner"), F.col("doc_id").alias("source_doc_id"))
    own = join_counted(own, source, ["partner"], "inner")
    n_words = F.size(F.array_remove(F.split("text", r"[\x09-\x0D\x20]+"), "")).cast("long")
    later = join_counted(rows, firsts.select(*KEY, F.col("place").alias("first")), KEY, "inner").where(F.col("place") > F.col("first"))
    copies = later.select("doc_id", F.lit(0).cast("long").alias("start_word"), n_words.alias("end_word"), F.lit(1.0).alias("similarity"), F.col("first").alias("source_doc_id"), F.lit(0).cast("long").alias("source_start"))
    return own.select(
        "doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "similarity", "source_doc_id", "source_start"
    ).unionAll(copies.where(F.col("end_word") >= LEAST_WORDS))


def op5_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
