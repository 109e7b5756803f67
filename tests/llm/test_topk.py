"""Top-k search: blocks and batches of full size in little memory, cuts of any size, bounds that end a search early."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import rows
from trailmetrics.llm import topk
from trailmetrics.llm.topk import Best, Lists, scaled, threshold_top_k, top_k


def plain(queries, vectors, k):
    """For pairs of an id and a vector."""
    out = []
    for query_id, q in queries:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in vectors if i != query_id and len(v) == len(q))
        out += [(query_id, rank, i, -score) for rank, (score, i) in enumerate(scores[:k], 1)]
    return out


def test_full_blocks_and_batches_in_2_gb(spark):
    """Of 24 blocks with 32,768 vectors each, for 2,048 queries."""

    def x(seed):
        return ((F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2001)) - 1000) / 1000).cast("float")

    table = spark.range(24 * 32_768).select(F.col("id").alias("vec_id"), F.array(x(1), x(2)).alias("embedding"))
    spark.sparkContext.setLocalProperty("resource.pyspark.memory", "2048")  # a limit for each Python worker, in MB
    try:
        found = top_k(table, F.col("vec_id") % 384 == 0, 5).collect()
    finally:
        spark.sparkContext.setLocalProperty("resource.pyspark.memory", None)
    assert len(found) == 5 * 2_048
    stored = table.select("vec_id", scaled(F.col("embedding")).alias("v")).select("vec_id", F.col("v")[0].alias("a"), F.col("v")[1].alias("b")).toPandas()
    ids, a, b = (stored[name].to_numpy() for name in ("vec_id", "a", "b"))
    for query_id in (0, 384 * 7, 384 * 2_047):
        own = np.flatnonzero(ids == query_id)[0]
        scores = np.where(ids == query_id, -(1 << 62), a * a[own] + b * b[own])
        best = np.lexsort((ids, -scores))[:5]
        expected = [(rank, ids[i], scores[i]) for rank, i in enumerate(best, 1)]
        assert sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == query_id) == expected


@pytest.mark.parametrize("limits", [{"BATCH_QUERIES": 3}, {"CELLS": 40}, {"BATCH_BEST": 9, "PARTS": 1}, {"BLOCK_ROWS": 1, "PARTS": 5}])
def test_any_cut_gives_the_same_rows(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    given = [(int(i), rng.integers(-9, 9, 2 + i % 2).tolist()) for i in rng.permutation(70)]
    given += [(100 + i, [3, 3, 3]) for i in range(40)] + [(200, [1 << 31, 1, 2]), (201, [1 << 30, -5, 2]), (202, []), (203, [])]
    table = spark.createDataFrame(given + [(7, [5, 5, 5])] * 3 + [(None, [1, 1, 1]), (300, None)], "vec_id long, embedding array<long>")
    queries = [(i, v) for i, v in given if i % 4 == 0]
    found = top_k(table, F.col("vec_id") % 4 == 0, 4, convert=lambda v: v)
    assert rows(found) == sorted(plain(queries, given + [(7, [5, 5, 5])] * 3, 4), key=repr)


@pytest.mark.parametrize("seed", range(40))
def test_search_of_blocks_equals_all_products(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    for name, sizes in (("TILE_QUERIES", (1, 3, 256)), ("TILE_ROWS", (1, 5, 2_048)), ("FIRST_DEPTH", (1, 2, 16))):
        monkeypatch.setattr(topk, name, int(rng.choice(sizes)))
    dims, most = int(rng.integers(5)), int(rng.choice([2, 100, 5_000, 1 << 20, 1 << 29]))
    query_ids, k = rng.choice(50, 9, replace=False), int(rng.integers(1, 8))
    queries = rng.integers(-most, most, (9, dims))
    best, all_vectors = Best(query_ids, k), []
    for _ in range(3):
        n = int(rng.integers(1, 60))
        vectors, ids = rng.integers(-most, most, (n, dims)) // int(rng.choice([1, 10, 100])), rng.integers(0, 50, n)
        threshold_top_k(Lists.of(vectors, ids), queries, best)
        all_vectors += zip(ids.tolist(), vectors.tolist())
    expected = plain(zip(query_ids.tolist(), queries.tolist()), all_vectors, k)
    assert best.rows().to_pylist() == [{"query_id": q, "vec_id": i, "score": score} for q, _, i, score in expected]


def test_the_bound_ends_a_search(monkeypatch):
    offered = []

    class Counting(Best):
        def offer(self, asks, products, ids):
            offered.append(products.size)
            super().offer(asks, products, ids)

    vectors = np.random.default_rng(1).integers(-1_000, 1_000, (20_000, 2))
    best = Counting(np.array([-1, -2]), 5)
    queries = np.array([[900, 1], [-3, 700]])
    threshold_top_k(Lists.of(vectors, np.arange(20_000)), queries, best)
    assert sum(offered) < 2_000
    low = Lists.of(vectors // 100, np.arange(20_000, 40_000))
    before = sum(offered)
    threshold_top_k(low, queries, best)
    assert sum(offered) == before  # what it could score at most is below what was found
    exact = vectors @ queries.T
    assert best.scores.tolist() == np.sort(exact, axis=0)[::-1][:5].T.tolist()
