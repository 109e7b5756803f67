"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmetrics.llm.common import join_counted
from trailmetrics.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of the edges ``a, b``; the label is the component's least node.

    Each round first hangs the larger neighbours of a node on its least neighbour, then the smaller ones;
    edges never grow in number and every component is a star after a logarithmic number of rounds. Rounds
    are stored, so no lineage piles up. Edges with a null end and loops are ignored.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialise(edges, "edges"), None
    while (now := _state(edges)) != before:
        both = edges.unionAll(edges.select(F.col("b"), F.col("a")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = join_counted(both, least, ["a"], "inner").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct(), "large-star")
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = join_counted(large, least, ["a"], "inner")
        small = small.select("b", "m").unionAll(least.select("a", "m")).where("b <> m")
        edges = materialise(small.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "small-star")
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of ``n`` nodes' components."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new
