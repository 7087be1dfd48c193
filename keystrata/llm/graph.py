"""Connected components of an edge table: contraction within files, then large-star and small-star steps across them.

Each file's edges are first contracted to stars by a union-find over that file alone, so chains shrink at once and few
rounds are left. A round is two grouped minima (with partial aggregation) and joins that adaptive execution may split, so a
hub's edges need not meet in one task; it is written to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import cut

EDGES_A_FILE = 200_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as (node, smallest node it reaches there)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in root]
    u, v = (np.array(x, np.int64) for x in (list(zip(*pairs)) or ((), ())))
    keep = u != v
    if keep.any():
        yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])


def components(edges: DataFrame, rounds: int = 60, most: int | None = None) -> DataFrame:
    """(u, v) edges of longs, of which there are at most ``most``, if known -> (node, component): for every node of an edge the smallest node it reaches."""

    def contracted(d: DataFrame, many: int) -> DataFrame:
        # Few edges are kept in few files, so that a round over them makes few shuffle files.
        return cut(d.coalesce(many // EDGES_A_FILE + 1).mapInArrow(_stars, "u long, v long"))

    def state(d: DataFrame) -> tuple:
        return tuple(d.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30)))).first())

    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), most)
    e = contracted(e, e.count())
    last = state(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = contracted(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), last[0])
        del both, least, large, down, small
        now = state(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
