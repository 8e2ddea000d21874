"""Exact top-k inner products by KD-trees, one per shard of the candidates.

A tree halves its vectors at the median of the widest dimension and keeps the tight bounding box of every node. For a
query, ``sum(max(q * low, q * high))`` bounds every inner product in a box. The search takes nodes best bound first and
ends when no bound reaches the k-th score. That score is carried along: the first shard a query visits gives it a floor
that all other shards start from, so most of their boxes are never opened.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import written

#: Vectors of a shard about, of a leaf at most, and queries that a task takes at a time.
SHARD_ROWS, LEAF_ROWS, QUERY_BATCH = 8192, 64, 256
_NO_FLOOR = -(2**63)


class KdTree:
    """Over integer vectors with ids; equal vectors go to leaves of their own in order of id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high, self.children, self.rows = [], [], [], []
        self._build(np.arange(len(ids)))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, rows: np.ndarray) -> int:
        """The node over ``rows``; halving keeps the depth at the logarithm of their number."""
        node = len(self.children)
        own = self.vectors[rows]
        low, high = own.min(axis=0), own.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.children.append(None)
        self.rows.append(None)
        widest = int((high - low).argmax())
        if len(rows) <= LEAF_ROWS or low[widest] == high[widest]:
            self.rows[node] = np.sort(rows)
            return node
        by = rows[np.argsort(own[:, widest], kind="stable")]
        middle = len(by) // 2
        self.children[node] = (self._build(by[:middle]), self._build(by[middle:]))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): no vector in the node's box has a higher inner product."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own_id: int, bounds: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """The (score, id) among the best ``k`` whose score reaches ``floor``; of equal scores the smaller ids."""
        best: list[tuple[int, int]] = []  # a heap whose first entry is the worst: (score, -id)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            kth = best[0][0] if len(best) == k else floor
            if -bound < kth:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    if bounds[child] >= kth:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            rows = self.rows[node]
            scores = self.vectors[rows] @ query
            for at in np.flatnonzero(scores >= kth):
                entry = (int(scores[at]), -int(self.ids[rows[at]]))
                if -entry[1] == own_id or entry[0] < floor:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                elif (self.low[node] == self.high[node]).all():
                    break  # the leaf holds one vector, and its smaller ids came first
        return [(score, -ident) for score, ident in best]


def _exact(vectors: np.ndarray, queries: np.ndarray) -> type:
    """Floats if every inner product is a whole number that they hold exactly (their products are fast), else long."""
    largest = max((int(np.abs(v).max()) for v in (vectors, queries) if v.size), default=0)
    return np.float64 if largest**2 * max(1, vectors.shape[1]) < 2**52 else np.int64


def _search_shards(rows: DataFrame, k: int) -> DataFrame:
    """Per (shard, query): its best matches there. ``rows``: (shard, is_query, vec_id, vector, floor).

    Rows of a task come sorted: the candidates of a shard, then its queries, which stream by in batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, vectors, tree = None, [], [], None

        def answer(part: list[tuple[int, list[int], int]]) -> pa.RecordBatch:
            queries = np.array([q[1] for q in part], dtype=np.int64)
            kind = _exact(tree.vectors, queries)
            if tree.vectors.dtype != kind:
                tree.vectors, tree.low, tree.high = (x.astype(kind) for x in (tree.vectors, tree.low, tree.high))
            queries = queries.astype(kind)
            bounds = tree.bounds(queries)
            out = [
                (ident, match, score)
                for (ident, _, floor), query, bound in zip(part, queries, bounds, strict=True)
                for score, match in tree.search(query, ident, bound, k, floor)
            ]
            columns = zip(*out, strict=True) if out else ([], [], [])
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=pa.int64()) for c in columns], names=["query_id", "vec_id", "score"]
            )

        waiting: list[tuple[int, list[int], int]] = []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "is_query", "vec_id", "vector", "floor"))
            for s, is_query, ident, vector, floor in zip(*columns, strict=True):
                if s != shard:
                    if waiting:
                        yield answer(waiting)
                    shard, ids, vectors, tree, waiting = s, [], [], None, []
                if not is_query:
                    ids.append(ident)
                    vectors.append(vector)
                    continue
                if tree is None and ids:
                    tree = KdTree(np.array(ids, dtype=np.int64), np.array(vectors, dtype=np.int64))
                if tree is not None:
                    waiting.append((ident, vector, floor))
                    if len(waiting) == QUERY_BATCH:
                        yield answer(waiting)
                        waiting = []
        if waiting:
            yield answer(waiting)

    ordered = rows.repartition("shard").sortWithinPartitions("shard", "is_query", "vec_id")
    return ordered.mapInArrow(run, "query_id long, vec_id long, score long")


def _best(matches: DataFrame, k: int) -> DataFrame:
    """The first ``k`` per query, with their rank; the input has ``k`` rows per query and shard at most."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return matches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "vector",
    scale: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): exact top ``k`` inner products of the vectors ``floor(scale * x)``.

    Queries are the rows where ``is_query`` holds, candidates all rows but those of the query's own id. Ties go to the
    smaller id. Vectors that are null, empty or hold null or non-finite components take no part, nor rows without id;
    repeated rows are candidates each; vectors must have one length. Components beyond a long are cut to it. Fewer
    than ``k`` candidates give fewer ranks, an empty table none.
    """
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v))
    rows = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & sound).select(
        F.col(id_col).cast("long").alias("vec_id"), whole.alias("vector"), is_query.alias("is_query")
    )
    rows = written(rows, "vectors")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    # Rows of one id are spread too: the hash takes the vector in.
    candidates = rows.select(
        F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int").alias("shard"),
        F.lit(False).alias("is_query"),
        "vec_id",
        "vector",
        F.lit(_NO_FLOOR).cast("long").alias("floor"),
    )
    queries = rows.filter("is_query").select("vec_id", "vector").distinct()
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    first = queries.select(
        home.alias("shard"), F.lit(True).alias("is_query"), "vec_id", "vector", F.lit(_NO_FLOOR).cast("long").alias("floor")
    )
    at_home = written(_search_shards(candidates.unionByName(first), k), "home-matches")
    kth = at_home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    kth = kth.select("query_id", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(_NO_FLOOR)).alias("floor"))
    away = (
        queries.join(kth, queries["vec_id"] == kth["query_id"], "left")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .filter(F.col("shard") != home)
        .select(
            "shard",
            F.lit(True).alias("is_query"),
            "vec_id",
            "vector",
            F.coalesce("floor", F.lit(_NO_FLOOR)).cast("long").alias("floor"),
        )
    )
    found = at_home.unionByName(_search_shards(candidates.unionByName(away), k))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
