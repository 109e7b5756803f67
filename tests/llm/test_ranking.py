"""Ranked search against a plain version."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from tests.llm.helpers import LOWERED, awkward, documents, folder, prose
from trailmetrics.llm import ranking
from trailmetrics.llm.ranking import Heaps, op13_reversed_search, rank_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWERED))


def plain(docs, items, k=20):
    counts = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counts = [(doc_id, found) for doc_id, found in counts if found]
    n_docs, n_terms = len(counts), sum(sum(found.values()) for _, found in counts)
    held_by = Counter(term for _, found in counts for term in found)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, found in counts:
            m = 100 - 25 + (25 * sum(found.values()) * n_docs) // n_terms
            score = 0
            for term in terms(text):
                if tf := found.get(term, 0):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held_by[term] + 1)))
                    score += w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id, score))
        for rank, (*_, doc_id, score) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1):
            out.append((item_id, rank, doc_id, score))
    return sorted(out, key=repr)


def items():
    long = prose(2, 6_000)
    return [
        (1, prose(1, 120)), (2, None), (3, ""), (4, "THE the Grüße-😀_one2two"), (5, prose(99, 40)), (6, long), (6, "one two"),
        (None, " ".join(prose(1, 120).split()[40:60])), (7, "?! ."),
    ]


def found(df):
    return sorted(((row.item_id, row["rank"], row.doc_id, row.score) for row in df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes, slice_", [(16 << 20, 64), (100, 2), (1, 64)])
def test_ranking_equals_a_plain_search(spark, monkeypatch, block_bytes, slice_):
    monkeypatch.setattr(ranking, "SLICE", slice_)
    given = awkward() + [(100 + i, prose(1, 30 + i % 3)) for i in range(70)] + [(90, prose(1, 30))] * 3
    item_rows = spark.createDataFrame(items(), "item_id long, text string")
    ranked = rank_documents(documents(spark, given).repartition(3), item_rows, block_bytes=block_bytes)
    assert found(ranked) == plain(given, items())


def test_query_and_empty_tables(spark):
    schema = "item_id long, text string"
    some, none = spark.createDataFrame(items(), schema), spark.createDataFrame([], schema)
    path = folder(spark, documents=documents(spark, awkward()), benchmark=some)
    assert found(op13_reversed_search(spark, path)) == plain(awkward(), items())
    for docs, item_rows in ((documents(spark, []), some), (documents(spark, awkward()), none), (documents(spark, [(1, "?")]), some)):
        assert found(rank_documents(docs, item_rows)) == []


def test_scores_over_32_bits_are_exact(spark):
    words = prose(5, 200)
    docs, item_rows = [(i, words if i % 2 else prose(i, 50)) for i in range(9)], [(1, " ".join([words] * 300))]
    ranked = rank_documents(documents(spark, docs), spark.createDataFrame(item_rows, "item_id long, text string"))
    assert found(ranked) == plain(docs, item_rows) and plain(docs, item_rows)[0][3] > 1 << 33


def test_heaps_stay_small_with_ties():
    import numpy as np

    heaps = Heaps(2, 3)
    heaps.offer(np.arange(50, 0, -1), np.array([[7, 0]] * 50))
    heaps.offer(np.array([3, 99]), np.array([[7, 5], [8, 0]]))
    assert sorted(heaps.rows()) == [(0, 1, 7), (0, 2, 7), (0, 99, 8), (1, 3, 5)]
