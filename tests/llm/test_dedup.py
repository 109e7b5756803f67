"""Near-duplicates, repeated substrings and passages against plain versions."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import LOWERED, awkward, documents, folder, prose, rows
from trailmetrics.llm.components import connected_components
from trailmetrics.llm.common import words_of
from trailmetrics.llm.passages import SeedBlock, align, chains, hashed_words, op5_collinear_chains, seeds, segments, stretches
from trailmetrics.llm.simhash import class_links, one_of_each, op4_vantage_simhash, shards, tree_links
from trailmetrics.llm.suffixes import common_prefixes, op8_two_stage_suffixes, remove_repeats, suffix_array


def plain_fingerprint(text):
    words = [w for w in (text or "").translate(LOWERED).encode().split() if w]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components_equal_all_pairs(spark):
    given = awkward()
    prints = [plain_fingerprint(text) for _, text in given]
    label = list(range(len(given)))
    for _ in given:
        for i in range(len(given)):
            for j in range(len(given)):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    expected = []
    for i, (doc_id, _) in enumerate(given):
        ids = [d for (d, _), other in zip(given, label) if other == label[i] and d is not None]
        expected.append((doc_id, format(prints[i], "016x"), min(ids, default=None)))
    path = folder(spark, documents=documents(spark, given))
    assert rows(op4_vantage_simhash(spark, path)) == sorted(expected, key=repr)
    assert op4_vantage_simhash(spark, folder(spark, documents=documents(spark, []))).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark, awkward())
    left = one_of_each(docs)
    assert left.columns == docs.columns
    kept = sorted((row.doc_id for row in left.collect()), key=repr)
    linked = op4_vantage_simhash(spark, folder(spark, documents=docs)).collect()
    assert kept == sorted({row.component_id for row in linked}, key=repr)
    assert {3, 5, None} <= set(kept) and not {6, 7, 9} & set(kept)


@pytest.mark.parametrize("spread", [3, 40])
def test_tree_finds_what_all_pairs_find(spread):
    rng = np.random.default_rng(spread)
    fp = rng.integers(1 << 63, size=30).astype(np.uint64)[rng.integers(30, size=1_500)]
    for _ in range(spread):
        fp ^= np.where(rng.random(1_500) < 0.3, np.uint64(1) << rng.integers(64, size=1_500).astype(np.uint64), np.uint64(0))
    mask = (1 << 64) - 1
    a, b = tree_links(fp, np.arange(len(fp)), mask, 4, 4)
    assert (np.bitwise_count(fp[a] ^ fp[b]) <= 64).all()

    def labels(pairs):
        label = np.arange(len(fp))
        while True:
            before = label.copy()
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
            if (label == before).all():
                return label

    near = np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    assert (labels(near) == labels(np.stack([a, b], axis=1))).all()


@pytest.mark.parametrize("split", [(1, 1, 1), (2, 1, 1), (1, 2, 1), (1, 1, 2)])
def test_linked_pairs_meet_however_many_levels(spark, split):
    rng, levels = np.random.default_rng(sum(3**i * n for i, n in enumerate(split))), 6
    fp = rng.integers(1 << 63, size=800).astype(np.uint64)
    other = fp.copy()
    for (low, high), n in zip(((0, 21), (21, 43), (43, 64)), split):
        for i in range(len(fp)):
            for bit in rng.choice(np.arange(low, high), size=n, replace=False).tolist():
                other[i] ^= np.uint64(1 << bit)
    a, b = fp.view(np.int64).tolist(), other.view(np.int64).tolist()
    classes = spark.createDataFrame([(x,) for x in {*a, *b}], "fp long")
    where = {}
    for row in shards(classes, levels).collect():
        where.setdefault(row.fp, {})[row.segment, row.path] = row.home
    meet = [any(where[x][k] or where[y][k] for k in where[x].keys() & where[y].keys()) for x, y in zip(a, b)]
    assert all(meet), f"{meet.count(False)} of {len(meet)} pairs never meet"
    found = {frozenset(row) for row in class_links(classes, 2_048 << (levels - 1)).collect()}
    assert found == {frozenset(pair) for pair in zip(a, b)}


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def plain_repeats(given, span=100):
    """Rows in order of id, null last; rows equal in id and text are one document."""
    seen, done, out = set(), {}, []
    for doc_id, text in sorted(given, key=lambda row: (row[0] is None, row[0] or 0)):
        data = (text or "").encode()
        if (doc_id, data) not in done:
            gone, own = set(), []
            for i in range(len(data) - span + 1):
                if data[i : i + span] in seen:
                    gone |= set(range(i, i + span))
                seen.add(data[i : i + span])
            runs = sum(1 for i in gone if i - 1 not in gone)
            kept = bytes(x for i, x in enumerate(data) if i not in gone)
            done[doc_id, data] = (doc_id, len(data), len(gone), runs, hashlib.sha256(kept).hexdigest())
        out.append(done[doc_id, data])
    return sorted(out, key=repr)


REPEATS = [
    *awkward(), (20, prose(7, 50)), (21, prose(8, 20) + prose(7, 50)[40:220] + prose(9, 9)), (22, prose(7, 50)[:180] + "!" + prose(7, 50)[181:]),
    *((30 + i, prose(50 + i, 12) + " shared " + prose(10, 40) + " end " + prose(90 + i, 6)) for i in range(6)), (40, "\0" * 260),
]


@pytest.mark.parametrize("hot", [2_048, 1])
def test_removed_bytes_equal_a_plain_search(spark, hot):
    docs = documents(spark, REPEATS)
    kept = remove_repeats(docs, block_bytes=20_000, hot=hot).collect()
    found = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in kept), key=repr)
    assert found == plain_repeats(REPEATS)


def test_registered_removal_on_an_empty_and_a_short_table(spark):
    assert op8_two_stage_suffixes(spark, folder(spark, documents=documents(spark, []))).count() == 0
    found = op8_two_stage_suffixes(spark, folder(spark, documents=documents(spark, [(1, "x"), (2, "x")])))
    assert {(r.doc_id, r.n_removed) for r in found.collect()} == {(1, 0), (2, 0)}


@pytest.mark.parametrize("data", [b"", b"a", b"mississippi", b"abababab" * 5, b"\0\0\0", bytes(range(250)) * 2, b"banana" * 30])
def test_suffix_array_is_sorted_to_its_depth(data):
    text = np.frombuffer(data, dtype=np.uint8)
    array = suffix_array(text, 8)
    assert sorted(array.tolist()) == list(range(len(data)))
    keys = [(data + bytes(8))[i : i + 8] for i in array]
    assert keys == sorted(keys)
    keys = [(data + b"\xff" * 8)[i : i + 8] for i in array]
    shared = [next((n for n in range(8) if a[n] != b[n]), 8) for a, b in zip(keys, keys[1:])]
    assert common_prefixes(text, array, 8).tolist()[1:] == shared


def test_chains_go_forward_in_both_texts_and_prefer_near_segments():
    found = segments(np.array([0, 0, 0, 0, 0, 7, 7]), np.array([0, 5, 10, 40, 20, 2, 1]), np.array([100, 105, 110, 140, 20, 2, 9]))
    assert list(zip(*(x.tolist() for x in found)))[-2:] == [(7, 1, 9, 5), (7, 2, 2, 5)]
    parts = [tuple(part) for part in zip(*(x[:-2].tolist() for x in found[1:]))]
    best = chains(parts)[0]
    assert best == [(0, 100, 15), (40, 140, 5)] or best == [(0, 100, 15)]
    for chain in chains([(0, 50, 9), (12, 10, 9), (12, 64, 9), (30, 80, 9)]):
        assert all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in zip(chain, chain[1:]))


def test_alignment_grows_over_equal_words_and_bridges_changes():
    mine = np.arange(60, dtype=np.uint32)
    theirs = mine.copy()
    theirs[30] = 999
    assert align(mine, theirs, [(10, 10, 5), (40, 40, 5)]) == (0, 60, 0, 60, 59)


def test_passages_name_where_they_come_from(spark):
    passage = prose(11, 70)
    changed = passage.split()
    changed[35] = "altered"
    given = [
        (1, prose(12, 40) + " " + passage + " " + prose(13, 20)), (2, prose(14, 30) + " " + passage), (3, " ".join(changed)), (4, prose(15, 200)),
        (5, prose(15, 200)), (6, " ".join(passage.split()[:30])), (7, None), (8, ""), (None, passage.upper()), (2, prose(14, 30) + " " + passage),
        (9, "x " * 80), (10, prose(16, 10) + " x" * 80),
    ]
    found = {}
    for row in op5_collinear_chains(spark, folder(spark, documents=documents(spark, given))).collect():
        found.setdefault(row.doc_id, []).append(row)
    assert {2, 3, 5, None} <= set(found) and not {1, 4, 6, 7, 8} & set(found)
    assert {row.source_doc_id for doc_id in (2, 3, None) for row in found[doc_id]} <= {1, 2, 3}
    assert (found[3][0].start_word, found[3][0].end_word) == (0, 70) and 0.95 < found[3][0].similarity < 1
    assert (found[5][0].source_doc_id, found[5][0].end_word, found[5][0].similarity) == (4, 200, 1.0)
    assert op5_collinear_chains(spark, folder(spark, documents=documents(spark, []))).count() == 0


def test_each_passage_of_an_island_stands_by_itself(spark):
    one, two, line = prose(61, 55), prose(62, 55), prose(63, 12)
    exact, gap = prose(64, 52), prose(65, 20)
    given = [
        (1, prose(71, 40) + " " + one + " " + prose(72, 40)), (2, prose(73, 40) + " " + two + " " + prose(74, 40)),
        (3, one + " " + prose(75, 30) + " " + two), (4, prose(76, 30) + " " + exact + " " + prose(77, 30)),
        (5, prose(78, 60) + " " + line + " " + prose(79, 60)), (6, exact + " " + gap + " " + line),
        (7, one + " " + prose(80, 30) + " " + two + " " + prose(81, 9)),
    ]
    found = op5_collinear_chains(spark, folder(spark, documents=documents(spark, given))).collect()
    spans = {}
    for row in found:
        spans.setdefault(row.doc_id, []).append((row.start_word, row.end_word, row.similarity, row.source_doc_id))
    assert sorted(spans.get(3, [])) == [(0, 55, 1.0, 1), (85, 140, 1.0, 2)]
    assert spans.get(6) == [(0, 52, 1.0, 4)]
    chain = spans.get(7, [])  # both passages in one chain with document 3; a word of the gap may agree by chance
    assert len(chain) == 2 and all(any(a <= low and high <= b and like >= 0.8 for a, b, like, _ in chain) for low, high in ((0, 55), (85, 140)))


@pytest.mark.parametrize("seed", range(6))
def test_stretches_are_the_maximal_ones_of_all(seed):
    rng = np.random.default_rng(seed)
    start = np.sort(rng.integers(0, 400, size=25))
    end = start + rng.integers(1, 30, size=25)
    covered = {x for a, b in zip(start.tolist(), end.tolist()) for x in range(a, b)}
    heads, tails = ([x for x in covered if x + step not in covered] for step in (-1, 1))
    good = [
        (a, b + 1, n) for a in heads for b in tails
        if b + 1 - a >= 50 and 10 * (n := len(covered & set(range(a, b + 1)))) >= 8 * (b + 1 - a)
    ]
    assert stretches(start, end) == sorted(x for x in good if not any(y[:2] != x[:2] and y[0] <= x[0] and x[1] <= y[1] for y in good))


def test_common_seeds_do_not_hide_a_passage(spark):
    passage = prose(101, 60).split()

    def stock(seed):  # every 5-word run of the passage, in other surroundings
        return " ".join(prose(seed + i, 4) + " " + " ".join(passage[i : i + 8]) for i in range(0, 56, 4))

    rng = np.random.default_rng(9)
    phrases = [prose(500 + i, 8) for i in range(30)]
    letters = [" ".join(phrases[i] for i in rng.permutation(30)[:14]) for _ in range(12)]
    letters[9] = " ".join([letters[9], " ".join(letters[2].split()[16:80])])
    whole = " ".join(passage)
    texts = [stock(2_000), prose(102, 20) + " " + whole, stock(3_000), prose(103, 30) + " " + whole + " " + prose(104, 10), *letters]
    found = op5_collinear_chains(spark, folder(spark, documents=documents(spark, list(enumerate(texts))))).collect()
    earlier, expected = set(), []
    for number, text in enumerate(texts):
        words = text.split()
        grams = [tuple(words[i : i + 12]) for i in range(len(words) - 11)]
        hit = sorted({x for i, gram in enumerate(grams) if gram in earlier for x in range(i, i + 12)})
        earlier |= set(grams)
        for run in np.split(hit, np.flatnonzero(np.diff(hit) != 1) + 1) if hit else []:
            if len(run) >= 50:
                expected.append((number, int(run[0]), int(run[-1]) + 1))
    assert (3, 30, 90) in expected and any(number == 13 for number, _, _ in expected)
    spans = [(row.doc_id, row.start_word, row.end_word) for row in found]
    assert [x for x in expected if not any(d == x[0] and a <= x[1] and x[2] <= b for d, a, b in spans)] == []
    assert next(row.source_doc_id for row in found if row.doc_id == 3) == 1


def test_words_and_seeds_of_a_block_equal_those_of_each_text():
    rng = np.random.default_rng(4)
    texts = [b"", b" ", b"one", b"a b c d e", b"x" * 300_000 + b" y", "Gr\u00fc\u00dfe \t\x0b\x0c\r\n  ENDE".encode()]
    texts += [" ".join(rng.choice(["aa", "b", "Cc", "d\u00e9", "e"], size=n)).encode() + rng.choice([b"", b" "]) for n in rng.integers(0, 60, 80).tolist()]
    hashes, counts = hashed_words(b"".join(texts), np.array([len(text) for text in texts]))
    found = [words_of(text) for text in texts]
    assert counts.tolist() == [len(words) for words in found]
    number = {}
    assert all(number.setdefault(word, h) == h for word, h in zip((w for words in found for w in words), hashes.tolist()))
    assert len(set(number.values())) == len(number)
    alone = []
    for i, low in enumerate((np.cumsum(counts) - counts).tolist()):
        own = seeds(hashes[low : low + counts[i]], counts[i : i + 1])
        alone += [(h, i, place) for h, place in zip(own[0].tolist(), own[2].tolist())]
    assert alone == list(zip(*(x.tolist() for x in seeds(hashes, counts))))


def test_a_block_reports_a_common_line_once():
    line = prose(5, 30)
    texts = [f"{prose(i, 20)} {line} {prose(900 + i, 9)}".encode() for i in range(300)]
    import zstandard

    block = SeedBlock({
        "texts": zstandard.ZstdCompressor().compress(b"".join(texts)), "orders": np.arange(300).tobytes(),
        "sizes": np.array([len(text) for text in texts]).tobytes(),
    })
    hottest = np.bincount(np.searchsorted(np.unique(block.hash), block.hash)).max()
    assert hottest >= 300 and len(np.unique(block.hash[block.reported()])) == len(block.reported())


@pytest.mark.parametrize("like", [0.95, 0.9, 0.85, 0.8])
def test_passages_of_similar_shingles_are_found(spark, like):
    """Of 40 pairs of 100 words whose five-word shingles are that similar, the share found for 80 words and more."""
    rng, given = np.random.default_rng(int(like * 100)), []
    for i in range(40):
        words, changed = prose(3_000 + i, 100).split(), None
        changed = list(words)
        while True:
            other = list(changed)
            other[rng.integers(0, 100)] = f"new{rng.integers(1 << 30)}"
            a, b = ({tuple(x[j : j + 5]) for j in range(96)} for x in (words, other))
            if len(a & b) / len(a | b) < like:
                break
            changed = other
        given.append((i, prose(4_000 + i, 60) + " " + " ".join(words)))
        given.append((1_000 + i, prose(5_000 + i, 50) + " " + " ".join(changed) + " " + prose(6_000 + i, 50)))
    found = {}
    for row in op5_collinear_chains(spark, folder(spark, documents=documents(spark, given))).collect():
        found[row.doc_id] = max(found.get(row.doc_id, 0), min(row.end_word, 150) - max(row.start_word, 50))
    assert sum(found.get(1_000 + i, 0) >= 80 for i in range(40)) >= 36


def far_and_near(seed, words, changes):
    """Texts that each have a few words of the passage, every run of 8 of which stands in two of them, once before and once after the text it came from."""
    stock = [" ".join([prose(seed + i, 6), *words[i : i + 8], prose(seed + 500 + i, 6)]) for i in range(0, len(words) - 7)]
    changed = [f"other{seed}x{i}" if i in changes else word for i, word in enumerate(words)]
    return stock, changed


@pytest.mark.parametrize("copies", [1, 12])
def test_a_passage_is_found_in_a_text_that_no_seed_has_first_or_last(spark, copies):
    """52 words, one changed, of a document whose seeds all stand in earlier and in later ones; with 12 of these each, all seeds are common."""
    words = prose(7_010, 52).split()
    given, stocks = [], [far_and_near(20_000 + 2_000 * i, words, {11}) for i in range(2 * copies)]
    for stock, _ in stocks[:copies]:
        given += stock
    source = len(given)
    given.append(" ".join([prose(7_902, 30), *words, prose(7_903, 30)]))
    for stock, _ in stocks[copies:]:
        given += stock
    given.append(" ".join([prose(7_904, 20), *stocks[0][1], prose(7_905, 20)]))
    found = op5_collinear_chains(spark, folder(spark, documents=documents(spark, list(enumerate(given))))).collect()
    last = [(row.source_doc_id, row.start_word, row.end_word) for row in found if row.doc_id == len(given) - 1]
    assert last == [(source, 20, 72)]


def test_no_two_texts_with_a_seed_or_a_pair_of_common_ones_are_left_apart(spark):
    """Each text meets each earlier one that it shares a rare seed with, and of common pairs the first with each wording."""
    from trailmetrics.llm import passages

    line = [prose(8_100 + i, 20) for i in range(2)]
    rare = [prose(8_200 + i, 20) for i in range(3)]
    texts = [f"{prose(8_300 + i, 20)} {rare[i % 3]} {prose(8_400 + i, 20)}" for i in range(12)]
    texts += [f"{prose(8_500 + i, 20)} {line[0]} fill{i % 7} in {line[1]} {prose(8_600 + i, 20)}" for i in range(40)]
    frame = spark.createDataFrame([(i, i, i, text) for i, text in enumerate(texts)], "doc_order long, key_a long, key_b long, text string")
    for block_bytes in (1 << 9, 1 << 20):
        met = {(row.number, row.partner) for row in passages.chained(frame, block_bytes)[0].collect()}
        assert {(i, j) for i in range(12) for j in range(i % 3, i, 3)} <= met
        assert {(12 + i, 12 + j) for i in range(7) for j in range(i)} <= met
        assert all(other < own for own, other in met)


def test_a_group_of_many_wordings_costs_no_pair_of_each(spark):
    """Texts that each say two common lines in a wording of their own: the matches grow with their number, not with its square."""
    from trailmetrics.llm import passages

    line = [prose(8_700 + i, 20) for i in range(2)]
    made = []
    for n in (40, 160):
        texts = [f"{prose(9_000 + i, 20)} {line[0]} fill{i} in {line[1]} {prose(9_300 + i, 20)}" for i in range(n)]
        frame = spark.createDataFrame([(i, i, i, text) for i, text in enumerate(texts)], "doc_order long, key_a long, key_b long, text string")
        made.append(passages.chained(frame, 1 << 12)[0].count())
    assert made[1] <= 6 * made[0]


def test_words_that_many_wordings_hide_are_matched_with_the_text_that_has_them(spark):
    """Nine words of a common passage and three of the text's own, eight times: fewer than 0.8 are the first text's; the last text has one more of each
    three in common with a text in the middle, which makes 0.85. The passage's seeds are common, and their pairs across other words have a wording in each text."""
    base = [prose(9_700 + i, 9) for i in range(8)]

    def said(name, shared=None):
        return " ".join(f"{run} {name}a{i} {shared or name}b{i} {name}c{i}" for i, run in enumerate(base))

    texts = [f"{prose(9_800 + i, 25)} {said(f'own{i}', 'shared' if i in (12, 25) else None)} {prose(9_850 + i, 25)}" for i in range(26)]
    found = op5_collinear_chains(spark, folder(spark, documents=documents(spark, list(enumerate(texts))))).collect()
    assert {row.doc_id for row in found} == {25}
    (row,) = found
    assert row.source_doc_id == 12 and row.end_word - row.start_word >= 80 and row.similarity > 0.8


def test_texts_that_differ_alike_from_a_third_meet_through_it():
    from trailmetrics.llm.passages import differences, matches, through

    base = np.arange(100, 140, dtype=np.uint32)
    one, two = np.append(7, base), base.copy()
    one[[16, 21]] = two[[15, 22]] = 5, 6
    keys = []
    for text, start in ((one, 1), (two, 0)):
        where, _ = matches(text, base, [(start, 0, 5), (start + 30, 30, 5)])
        at, own, asks = differences(text, where, 3, 1_000, np.array([[0], [17]], dtype=np.int32).tobytes())
        keys.append((at.tolist(), own.reshape(-1, 4), asks.tolist()))
    assert [x[0] for x in keys] == [[16, 21], [15, 22]] and keys[0][2] == [False, True]
    assert (keys[0][1][0] == keys[1][1][0]).all() and not np.isin(keys[0][1][1][:2], keys[1][1]).any()
    assert through([[1, 0, 15], [17, 16, 4], [22, 21, 9]], [[0, 0, 15], [16, 16, 6], [90, 120, 9]]) == [[(1, 0, 15), (17, 16, 4), (22, 21, 1)]]
    assert through([[0, 0, 9], [90, 90, 9]], [[0, 0, 9], [90, 90, 9]]) == [[(0, 0, 9)], [(90, 90, 9)]]


def test_the_text_that_differs_alike_is_aligned(spark):
    """Of three texts two have the same other word at the same place of a reference: the later one meets the earlier one, and no other."""
    from trailmetrics.llm.passages import _ALIGNED, alike_pieces, differences, matched_runs, matches, short_words

    rng = np.random.default_rng(12)
    base = rng.integers(1 << 40, 1 << 62, 40).astype(np.uint64)
    base &= ~np.uint64(0xFF000000)
    stored = []
    for number, changes in ((9, {15: 1, 20: 2}), (5, {15: 1, 22: 3}), (7, {15: 4, 20: 5})):
        text = base.copy()
        text[list(changes)] = list(changes.values())
        short, other = (x.astype(np.uint32) & np.uint32(0xFFFFFF) for x in (text, base))
        where, _ = matches(short, other, [(0, 0, 5), (30, 30, 5)])
        told = differences(short, where, 3, 0, b"")
        stored.append((number, 0, 40, 3, matched_runs(where).astype(np.int32).tobytes(), 38, 0, short_words(text), *(x.tolist() for x in told), number))
    frame = spark.createDataFrame([(*row[:4], bytearray(row[4]), *row[5:7], bytearray(row[7]), *row[8:]) for row in stored], f"{_ALIGNED}, piece long")
    (found,) = alike_pieces(frame).collect()
    assert (found.number, found.start, found.end, found.partner) == (9, 0, 40, 5)
    assert np.frombuffer(found.runs, dtype=np.int32).reshape(-1, 3).tolist() == [[0, 0, 20], [21, 21, 1], [23, 23, 17]]
