"""Exact top-k by inner product: a k-d tree for each shard of vectors, searched best first.

A shard is a bounded run of rows of one input partition. Its tree splits at the median of the widest dimension, down
to small leaves, and every node keeps the tight bounding box of its vectors. For a query, the largest inner product
that a box allows bounds everything below a node; nodes are visited by falling bound until the bound is under the kth
best score. That kth score is propagated: it starts from the kth score among the queries of the same block, and carries
on from shard to shard within a task.

Queries come in blocks of at most ``QUERY_BLOCK``, so what is broadcast (one block) has a fixed bound; candidates are
never replicated. Results of shards meet by query, k rows from each shard at most.

Defined cases: vectors that are null or hold a null or non-finite component take no part, as query or candidate; only
vectors of equal length are compared; rows that repeat an id count as rows of their own, but never match their own id;
ties go to the smaller id; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.common import cut

QUERY_BLOCK = 4096
SHARD_ROWS = 16384
LEAF_ROWS = 64
SCALE = 1024.0


def integer_vectors(column: pa.Array, scale: float = SCALE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: row numbers and floor(scale * x) as a float64 matrix, of the valid vectors only."""
    column = pa.concat_arrays([column])
    lists = np.asarray(column.is_valid())
    offsets = np.asarray(column.offsets, dtype=np.int64)
    values = column.values
    numbers = np.asarray(values.cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
    good = lists & (bad[offsets[1:]] == bad[offsets[:-1]])
    lengths = np.diff(offsets)
    out = {}
    for d in np.unique(lengths[good]):
        rows = np.flatnonzero(good & (lengths == d))
        at = offsets[rows][:, None] + np.arange(d)[None, :]
        out[int(d)] = (rows, np.floor(scale * numbers[at]))
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-number matrices, (n, d) by (m, d)."""
    top = (np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
    if top < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Tree:
    """A k-d tree with median splits and tight boxes; node 0 is the root."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.span: list[tuple[int, int]] = []
        self.kids: list[tuple[int, int] | None] = []
        low, high = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node, own = len(self.span), points[self.order[a:b]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            self.span.append((a, b))
            self.kids.append(None)
            low.append(lo)
            high.append(hi)
            if parent >= 0:
                was = self.kids[parent] or (0, 0)
                self.kids[parent] = (node, was[1]) if side == 0 else (was[0], node)
            if b - a > leaf and len(lo) and (hi > lo).any():
                wide, middle = int(np.argmax(hi - lo)), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, wide], middle)]
                todo += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.low, self.high = np.array(low), np.array(high)
        self.points = points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product each node's box allows, (queries, nodes)."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each query the k best (score, -id) of the tree that may still count; ``floor``, the kth scores so far, is raised in place."""
    ids = ids[tree.order]
    bounds = tree.bounds(queries)
    # A relative slack for float rounding keeps the bound an upper one.
    slack = np.abs(queries).sum(axis=1) * max(1.0, np.abs(tree.points).max(initial=0.0)) * 1e-12
    out = []
    for i, (q, own) in enumerate(zip(queries, query_ids.tolist())):
        best: list[tuple[int, int]] = []
        heap = [(-bounds[i, 0], 0)] if len(ids) else []
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound + slack[i] < floor[i]:
                break
            if kids := tree.kids[node]:
                for x in kids:
                    heapq.heappush(heap, (-bounds[i, x], x))
                continue
            a, b = tree.span[node]
            scores = inner(q[None, :], tree.points[a:b])[0]
            for j in np.flatnonzero(scores >= floor[i]).tolist():
                if (x := int(ids[a + j])) != own:
                    item = (int(scores[j]), -x)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            if len(best) == k:
                floor[i] = max(floor[i], best[0][0])
        out.append(best)
    return out


def _seed_floor(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each query's kth score, from the other queries of its block."""
    floor = np.full(len(ids), -np.inf)
    for a in range(0, len(ids), 512):
        scores = inner(vectors[a : a + 512], vectors).astype(np.float64)
        scores[ids[a : a + 512][:, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            floor[a : a + 512] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
    return floor


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            held.append(part := batch.slice(a, rows))
            n += part.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _block_search(spark, vectors: DataFrame, block: list[tuple[int, list[float]]], k: int, scale: float) -> DataFrame:
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    ids = np.array([x[0] for x in block], np.int64)
    for d, (rows, points) in integer_vectors(pa.array([x[1] for x in block], pa.list_(pa.float64())), scale).items():
        by_length[d] = (points, ids[rows], _seed_floor(points, ids[rows], k))
    shared = spark.sparkContext.broadcast(by_length)

    def work(batches):
        floors = {d: f.copy() for d, (_, _, f) in shared.value.items()}
        for run in _runs(batches, SHARD_ROWS):
            all_ids = np.asarray(run.column(0).combine_chunks().cast(pa.int64()))
            for d, (rows, points) in integer_vectors(run.column(1).combine_chunks(), scale).items():
                if d not in shared.value:
                    continue
                queries, query_ids, _ = shared.value[d]
                found = search(Tree(points), all_ids[rows], queries, query_ids, k, floors[d])
                out = [(q, -x, s) for q, best in zip(query_ids.tolist(), found) for s, x in best]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query_id", "vec_id", "score"])

    found = vectors.mapInArrow(work, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = SCALE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k best candidates among all rows but its own id."""
    spark = vectors.sparkSession
    picked = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).filter("id is not null")
    parts, block = [], []

    def flush():
        if block:
            part = _block_search(spark, picked, list(block), k, scale)
            parts.append(part)
            block.clear()

    queries = vectors.filter(is_query).select(F.col(id_column).cast("long"), F.col(vector_column).cast("array<double>")).filter(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull())
    for row in queries.toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == query_block:
            flush()
            parts[-1] = cut(parts[-1])
    flush()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
