"""Alignment of two tokenizers against a plain version."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import reduce
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
import tokenizers as hf

from tests.llm.helpers import awkward, documents, folder, prose, rows
from trailmetrics.llm import alignment
from trailmetrics.llm.alignment import Tokenizers, align_documents, chunk_fragment, compose, cuts, op11_fragment_monoid

FILES = [Path(alignment.TOKENIZER_FOLDER, name) for name in (alignment.BYTE_FILE, alignment.PIECE_FILE)]


@pytest.fixture(scope="module")
def tokens():
    return Tokenizers(*[path.read_bytes() for path in FILES])


@pytest.fixture(scope="module")
def libraries():
    a = hf.Tokenizer.from_file(str(FILES[0]))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=str(FILES[1]))


def both_ways(libraries, text):
    """``(id, bytes)`` of both tokenizers' tokens, or none if their bytes are not the text's."""
    a, b = libraries
    shown = {chr(c): c for c in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
    shown |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if chr(c) not in shown)}
    of_a = [(i, bytes(shown[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    of_b = [
        (i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
        for i in b.encode(text)
    ]
    whole = (" " + text).encode()
    return (of_a, of_b) if all(b"".join(x for _, x in found) == whole for found in (of_a, of_b)) else ([], [])


def spans(found):
    at, out = 0, []
    for i, piece in found:
        out.append((i, at, at + len(piece)))
        at += len(piece)
    return out


def plain(libraries, given):
    docs, counts = [], Counter()
    for doc_id, text in given:
        of_a, of_b = map(spans, both_ways(libraries, text)) if text else ([], [])
        links = [(i, j) for i, s, e in of_a for j, t, f in of_b if max(s, t) < min(e, f)] if len(of_a) < 400 else fast(of_a, of_b)
        counts.update(links)
        cuts_at = sorted({e for *_, e in of_a} & {e for *_, e in of_b})
        groups = [["", ""] for _ in cuts_at]
        for side, found in enumerate((of_a, of_b)):
            for i, _, end in found:
                own = groups[bisect_left(cuts_at, end)]
                own[side] += f",{i}" if own[side] else str(i)
        groups = ["|".join(group) for group in groups]
        docs.append((doc_id, len(of_a), len(of_b), groups, links))
    highest = defaultdict(int)
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    out = []
    for doc_id, n_a, n_b, groups, links in docs:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        best = sum(counts[link] == highest[link[1]] for link in links)
        out.append((doc_id, n_a, n_b, len(groups), len(links), best, sum(counts[link] for link in links), digest))
    return sorted(out, key=repr)


def fast(of_a, of_b):
    out, x, y = [], 0, 0
    while x < len(of_a) and y < len(of_b):
        out.append((of_a[x][0], of_b[y][0]))
        a_end, b_end = of_a[x][2], of_b[y][2]
        x, y = x + (a_end <= b_end), y + (b_end <= a_end)
    return out


ODD = [
    (20, "<|endoftext|> and </s> <s>"), (21, "two  spaces   and\ttabs \n\n end "), (22, " leading"), (23, "日本語のテキストです。改行。"), (24, "a▁b"),
    (25, "ﬁ ligature ① é"), (26, "don't we'll I'm 'tis they've"), (27, "👩‍👩‍👧 flags 🇩🇪"), (28, "\x00\x01 control"), (29, "x" * 700), (30, " "),
    (31, "0123456789" * 30), (32, "Ünïcödé 한국어 텍스트 русский текст"), (33, "\r\n\r\n  　  nbsp"), (34, "the the the the"),
]


@pytest.mark.parametrize("chunk", [alignment.CHUNK_BYTES, 40])
def test_alignment_equals_a_plain_version(spark, libraries, chunk):
    given = [(i, text if text is None else text[:1_500]) for i, text in awkward()] + ODD
    found = align_documents(documents(spark, given).repartition(3), chunk=chunk).drop("groups")
    assert rows(found) == plain(libraries, given)


def test_query_and_empty_table(spark, libraries):
    given = ODD[:8] + [(40, prose(9, 15_000)), (41, None), (42, "")]
    path = folder(spark, documents=documents(spark, given))
    assert rows(op11_fragment_monoid(spark, path)) == plain(libraries, given)
    path = folder(spark, documents=documents(spark, []))
    assert rows(op11_fragment_monoid(spark, path)) == []


def test_groups_are_kept_when_asked_for(spark, libraries):
    (row,) = align_documents(documents(spark, [(1, "some words")]), keep_groups=True).collect()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256
    assert row.groups.count(";") == row.n_groups - 1


def random_text(rng):
    kinds = ["abcde", "the ing", "  \n\t", "0123", ".,;!?'", "日本語中文", "éüß", "한국", "👩🇩", "'s't", "ABC", " 　", "<>|_"]
    return "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(1, 400))) + " " + prose(rng.randint(0, 99), 20)


def fragments(tokens, text, step):
    spaced = " " + text
    edges = [[0, *cuts(spaced, step, may), len(spaced)] for may in (tokens.a_may_cut, tokens.b_may_cut)]
    at = [[len(spaced[:i].encode()) for i in found] for found in edges]
    (a, b), (a_at, b_at) = edges, at
    return [chunk_fragment(tokens, spaced[a[i] : a[i + 1]], spaced[b[i] : b[i + 1]], a_at[i], b_at[i]) for i in range(len(a) - 1)]


def same(left, right):
    def shape(x):
        runs = [(r.a_from, r.b_from, r.a.tolist(), r.b.tolist()) for r in (x.prefix, x.suffix) if r is not None]
        closed = x.closed and (x.closed.n_a, x.closed.n_b, x.closed.n_groups, x.closed.n_links, b";".join(x.closed.groups), x.closed.pair.tolist(), x.closed.times.tolist())
        return runs, closed

    return shape(left) == shape(right)


def test_fragments_compose_in_any_bracketing_to_the_whole(tokens, libraries):
    rng, open_ends = random.Random(5), 0
    for _ in range(120):
        text = random_text(rng)
        whole = chunk_fragment(tokens, " " + text, " " + text, 0, 0)
        parts = fragments(tokens, text, rng.choice([3, 10, 40]))
        if whole.broken:
            assert any(part.broken for part in parts)
            continue
        open_ends += sum(len(part.prefix.a) + len(part.prefix.b) > 0 for part in parts)
        left = reduce(lambda x, y: compose(tokens, x, y), parts, None)
        assert same(left, whole)
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [compose(tokens, parts[i], parts[i + 1])]
        assert same(parts[0], whole)
        assert not len(whole.prefix.a) and not len(whole.suffix.b)
        assert both_ways(libraries, text)[0] and whole.closed.n_a == len(both_ways(libraries, text)[0])
    assert open_ends > 50  # chunks of the two tokenizers do end at different places


def test_ids_equal_those_of_the_library(tokens, libraries):
    rng = random.Random(6)
    for text in [random_text(rng) for _ in range(200)] + [text for _, text in ODD]:
        assert tokens.a(" " + text).tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids
        assert isinstance(tokens.a(text), np.ndarray)
