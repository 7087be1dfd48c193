"""Top-k search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import kdsearch
from tests.conftest import SF_DIR


def brute(vectors, queries, k):
    out = []
    valid = {i: np.floor(1024 * np.array(v, float)).astype(object) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in queries:
        if q in valid:
            scores = sorted((-int(sum(valid[q] * v)), i) for i, v in valid.items() if i != q and len(v) == len(valid[q]))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_small_table_with_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(kdsearch, "SHARD_ROWS", 7)
    r = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in r.integers(-2, 3, 4) / 1024]) for i in range(60)]
    vectors += [(100, None), (200, [1.0, None, 0.0, 0.0]), (300, [float("nan")] * 4), (400, [1.0, 2.0]), (500, [0.5, -1.0]), (600, [])]
    d = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).repartition(3)
    for block in (4096, 3):
        got = kdsearch.top_k(d, F.col("vec_id") % 10 == 0, 10, query_block=block)
        assert sorted(map(tuple, got.collect())) == brute(vectors, [i for i, _ in vectors if i % 10 == 0], 10)


def test_empty(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert kdsearch.top_k(d, F.lit(True)).count() == 0


def test_matches_sql(spark, duck):
    from keystrata.llm.queries import ORACLE_SQL, QUERIES

    got = sorted(map(tuple, QUERIES["op2_kd_topk"](spark, SF_DIR).collect()))
    assert got == sorted(duck.execute(ORACLE_SQL["op2_kd_topk"]).fetchall())


def test_boxes_are_tight_and_bounds_hold():
    r = np.random.default_rng(2)
    p = np.floor(r.normal(size=(500, 5)) * 100)
    t = kdsearch.Tree(p, leaf=16)
    q = np.floor(r.normal(size=(20, 5)) * 100)
    bounds = t.bounds(q)
    for node, (a, b) in enumerate(t.span):
        own = t.points[a:b]
        assert (own.min(axis=0) == t.low[node]).all() and (own.max(axis=0) == t.high[node]).all()
        assert (q @ own.T).max(axis=1) == pytest.approx(np.minimum((q @ own.T).max(axis=1), bounds[:, node]))
