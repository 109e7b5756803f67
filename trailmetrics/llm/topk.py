"""Exact top-k search by inner product, with Fagin's threshold algorithm.

Vectors are dealt into blocks. A block sorts one list per dimension, once, and keeps its vectors in the order in which going
down all lists from both ends comes to them, with the values that follow in each list after every round; depth grows by half each
round. A query goes down all lists at once and scores the vectors of one round after another. Whatever it has not met can score at
most the sum of the products with what follows from the end where its weight makes the product large; once that bound is below
the k-th score found, the block is done with that query. All queries of a batch go together, ``TILE_QUERIES`` of them
against ``TILE_ROWS`` vectors at a time, so that no more scores than these are held beside the k best of each query.

Every block, packed into a row, meets every batch of queries, packed into a row too. Spark pairs their partitions and reads them
anew for each task, so no copies of vectors are written. A task has a ``PARTS``-th of the blocks, which come to it one by one,
and one batch. The k best of each query so far go along from block to block; those of all tasks then meet in one ranking per
query, at most k rows for each task.

Blocks and batches have bounded sizes (``BLOCK_ROWS``, ``BATCH_QUERIES``, ``CELLS`` numbers, ``BATCH_BEST`` rows held); these only
set how the work is cut. Small tables are cut into ``PARTS`` blocks for the sake of parallel tasks.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows
without an id. A query only meets vectors of as many dimensions as it has; without dimensions all scores are 0. Rows that
repeat an id are candidates each, but make one query (of the least vector). Candidates never have the
query's id. Ties go to the smaller id, then to the row of the other; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmetrics.llm.common import let, row_slices, table
from trailmetrics.session import materialise

BLOCK_ROWS = 32_768
BATCH_QUERIES = 8_192
CELLS = 1 << 21
BATCH_BEST = 1 << 20
PARTS = 24
TILE_QUERIES, TILE_ROWS = 256, 2_048
FIRST_DEPTH = 16
#: Below these, sums of products are exact in floating point.
_EXACT = ((float(1 << 24), np.float32), (float(1 << 53), np.float64))
#: The score of no vector, and its id.
NOTHING, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def scaled(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null where any component is null or not finite."""

    def whole(x: Column) -> Column:
        x = x.cast("double")
        return F.floor(F.when(F.abs(x) < float("inf"), x) * scale).cast("long")

    return let(F.transform(embedding, whole), lambda v: F.when(~F.exists(v, lambda x: x.isNull()), v))


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold the largest."""
    low, high = (values.min(), values.max()) if values.size else (0, 0)
    for kind in (np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return values.astype(kind)
    return values.astype(np.int64)


def _longest(vectors: np.ndarray) -> float:
    return float(np.sqrt(np.square(vectors, dtype=float).sum(axis=1).max(initial=0)))


@dataclass
class Lists:
    """A block: vectors in the order in which the lists come to them, how many are met when each round is over,
    and, per round and dimension, the greatest and the least value that the lists have left before it."""

    ids: np.ndarray
    vectors: np.ndarray
    ends: np.ndarray
    edges: np.ndarray
    longest: float

    @classmethod
    def of(cls, vectors: np.ndarray, ids: np.ndarray) -> Lists:
        vectors = _narrow(vectors)
        n, dims = vectors.shape
        lists = np.argsort(vectors, axis=0, kind="stable")  # per dimension, ascending
        depth = np.minimum(np.arange(n), np.arange(n)[::-1])  # of a place, from the nearer end
        met = np.full(n, n if dims else 0)
        for places in lists.T:
            met[places] = np.minimum(met[places], depth)
        order = np.argsort(met, kind="stable")
        ends, edges, at, every = [], [], 0, np.arange(dims)
        while not ends or ends[-1] < n:
            edges.append(np.stack([vectors[lists[n - 1 - at], every], vectors[lists[at], every]], axis=1))
            at += max(FIRST_DEPTH, at // 2)
            ends.append(np.searchsorted(met, at, sorter=order))
        return cls(ids[order], vectors[order], np.array(ends), np.array(edges, dtype=np.int64), _longest(vectors))


class Best:
    """The k best vectors so far of each query, best first."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.scores = np.full((len(query_ids), k), NOTHING)
        self.ids = np.full((len(query_ids), k), NO_ID)

    def offer(self, asks: np.ndarray, products: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some queries, a row each, for vectors with these ids; what may not count has the least value."""
        least = self.scores[asks, -1]
        floor = least.astype(products.dtype)
        if len(ids) > self.k and (least == NOTHING).any():
            floor = np.maximum(floor, np.partition(products, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        hit = np.flatnonzero(products.max(axis=1) >= floor)
        ask, row = np.nonzero(products[hit] >= floor[hit, None])
        score, vec_id, own = products[hit[ask], row].astype(np.int64), ids[row], asks[hit[ask]]
        worst = self.scores[own, -1]
        better = (score > worst) | ((score == worst) & (vec_id < self.ids[own, -1]) & (score > NOTHING))
        if not better.any():
            return
        changed, ask = np.unique(own[better], return_inverse=True)
        ask = np.concatenate([ask, np.repeat(np.arange(len(changed)), self.k)])
        score = np.concatenate([score[better], self.scores[changed].ravel()])
        vec_id = np.concatenate([vec_id[better], self.ids[changed].ravel()])
        order = np.lexsort((vec_id, ~score, ask))
        first = np.searchsorted(ask[order], np.arange(len(changed)))
        order = order[first[:, None] + np.arange(self.k)]
        self.scores[changed], self.ids[changed] = score[order], vec_id[order]

    def rows(self) -> pa.RecordBatch:
        found = self.scores > NOTHING
        query_ids = np.repeat(self.query_ids, self.k).reshape(found.shape)
        columns = [pa.array(x[found], pa.int64()) for x in (query_ids, self.ids, self.scores)]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])


def threshold_top_k(block: Lists, queries: np.ndarray, best: Best) -> None:
    """Takes the vectors of a block into the k best of each query."""
    most = _longest(queries) * block.longest
    kind = next((kind for limit, kind in _EXACT if most < limit), np.int64)
    vectors, weights = block.vectors.astype(kind), queries.astype(kind)
    none = -np.inf if kind is not np.int64 else NOTHING
    held = np.empty(TILE_QUERIES * TILE_ROWS, dtype=kind)
    by_id = np.argsort(block.ids, kind="stable")  # to find vectors that have the query's id
    low, high = (np.searchsorted(block.ids, best.query_ids, side, sorter=by_id) for side in ("left", "right"))
    for start in range(0, len(queries), TILE_QUERIES):
        active = np.arange(start, min(start + TILE_QUERIES, len(queries)))
        same = np.repeat(active, high[active] - low[active])
        same_row = np.concatenate([by_id[low[i] : high[i]] for i in active])
        row = 0
        for end, edge in zip(block.ends, block.edges):
            signed = queries[active].astype(float)
            bound = np.maximum(signed, 0) @ edge[:, 0] + np.minimum(signed, 0) @ edge[:, 1]
            doubt = np.abs(signed) @ np.abs(edge.astype(float)).max(axis=1, initial=0) * (len(edge) * 1e-15)
            active = active[~(best.scores[active, -1].astype(float) > bound + doubt)]
            if not len(active):
                break
            for row in range(row, end, TILE_ROWS):
                until = min(row + TILE_ROWS, end)
                shape = len(active), until - row
                products = np.matmul(weights[active], vectors[row:until].T, out=held[: shape[0] * shape[1]].reshape(shape))
                own = np.flatnonzero((row <= same_row) & (same_row < until))
                if len(own := own[np.isin(same[own], active)]):
                    products[np.searchsorted(active, same[own]), same_row[own] - row] = none
                best.offer(active, products, block.ids[row:until])
            row = end


def _packed(frame: DataFrame, number: str, of: Callable[[np.ndarray, np.ndarray], list], schema: str) -> DataFrame:
    """One row for all vectors of the same dimensions and number: what ``of`` makes of them and their ids."""
    names = [field.split(" ")[0] for field in schema.split(", ")]

    def row(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        dims = key[0].as_py()
        flat = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = flat.reshape(group.num_rows, dims) if dims else np.zeros((group.num_rows, 0), dtype=np.int64)
        found = of(vectors, group["vec_id"].to_numpy().astype(np.int64))
        own = {name: pa.array([x.as_py()], pa.int32()) for name, x in zip(("dims", number), key)}
        return pa.table(own | {name: [value] for name, value in zip(names, found)})

    return frame.select("dims", number, "vec_id", "v").groupBy("dims", number).applyInArrow(row, f"dims int, {number} int, {schema}")


def _lists(vectors: np.ndarray, ids: np.ndarray) -> list:
    block = Lists.of(vectors, ids)
    packed = (x.tobytes() for x in (block.ids, block.vectors, block.ends, block.edges))
    return [*packed, block.vectors.dtype.str, block.longest]


def _queries(vectors: np.ndarray, ids: np.ndarray) -> list:
    narrow = _narrow(vectors)
    return [ids.tobytes(), narrow.tobytes(), narrow.dtype.str]


def _search(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], Best] = {}
        for pair in row_slices(pairs, 1):
            own = {name: column[0].as_py() for name, column in zip(pair.schema.names, pair.columns)}
            dims = own["dims"]

            def numbers(name: str, kind: object, *shape: int) -> np.ndarray:
                return np.frombuffer(own[name], dtype=kind).reshape(shape)

            ids, ends, query_ids = (numbers(name, np.int64, -1) for name in ("ids", "ends", "query_ids"))
            vectors, edges = numbers("vectors", own["kind"], len(ids), dims), numbers("edges", np.int64, len(ends), dims, 2)
            best = found.setdefault((dims, own["batch"]), Best(query_ids, k))
            queries = numbers("queries", own["query_kind"], len(query_ids), dims)
            threshold_top_k(Lists(ids, vectors, ends, edges, own["longest"]), queries, best)
        for best in found.values():
            yield best.rows()

    return search


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    convert: Callable[[Column], Column] = scaled,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best for each row that ``is_query`` holds for."""
    usable = vectors.select(F.col(id_col).alias("vec_id"), convert(F.col(vector_col)).alias("v"), is_query.alias("q"))
    # stored before anything asks for v, which Spark would else convert anew wherever it is named
    usable = materialise(usable.where(F.col("vec_id").isNotNull()), "vectors")
    usable = usable.where(F.col("v").isNotNull()).withColumn("dims", F.size("v"))
    queries = usable.where("q").groupBy("vec_id", "dims").agg(F.min("v").alias("v"))
    first_of_id = W.partitionBy("vec_id").orderBy("v")
    queries = queries.withColumn("nth", F.row_number().over(first_of_id)).where("nth = 1")
    asked = F.when(F.col("q"), F.col("dims"))
    size = usable.agg(F.count("*"), F.sum("dims"), F.count(asked), F.sum(asked)).first()
    n_rows, cells, n_queries, query_cells = (n or 0 for n in size)
    n_blocks = PARTS * max(1, -(-n_rows // (PARTS * BLOCK_ROWS)), -(-cells // (PARTS * CELLS)))
    n_batches = max(1, -(-n_queries // BATCH_QUERIES), -(-query_cells // CELLS), -(-n_queries * k // BATCH_BEST))

    # a third of all vectors may be equal, so rows are dealt by id and value together with a number that
    # repeated rows do not share
    spread = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")
    blocks = _packed(usable.withColumn("block", spread), "block", _lists, "ids binary, vectors binary, ends binary, edges binary, kind string, longest double")
    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(n_batches)).cast("int")
    batches = _packed(queries.withColumn("batch", dealt), "batch", _queries, "query_ids binary, queries binary, query_kind string")

    # an equality would send all vectors of as many dimensions to one task
    blocks = blocks.repartitionById(PARTS, F.col("block") % PARTS).hint("shuffle_replicate_nl")
    batches = batches.withColumnRenamed("dims", "own").repartitionById(n_batches, "batch")
    pairs = blocks.join(batches, (F.col("dims") <= F.col("own")) & (F.col("dims") >= F.col("own")))
    partial = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP2_SQL = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
