import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import topk as T


def brute(rows, is_query, k):
    """All scores in whole numbers of any size; every row but the query's own, repeated ids included."""
    good = []
    for i, v in rows:
        if i is None or v is None or any(x is None or math.isnan(x) or math.isinf(x) for x in v):
            continue
        good.append((i, [math.floor(256 * Fraction(x)) for x in v]))
    out = []
    for n, (i, q) in enumerate(good):
        if is_query(i):
            best = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for m, (j, c) in enumerate(good) if m != n)[:k]
            out += [(i, rank + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for rank, (s, j) in enumerate(best)]
    return sorted(out)


def vectors(n=300, dims=24, seed=1):
    r = random.Random(seed)
    out = [(k, [float(f"{r.gauss(0, 0.125):.6f}") for _ in range(dims)]) for k in range(n)]
    hot = out[10][1]
    return out + [(n + k, hot) for k in range(40)] + [(n + 50, [0.0] * dims), (n + 51, [1e9] * dims), (n + 52, [-1e9] * dims)]


@pytest.mark.parametrize(("cells", "queries"), [(1 << 18, 4096), (1, 3)])
def test_exact_for_any_blocking(spark, monkeypatch, cells, queries):
    monkeypatch.setattr(T, "CELLS", cells)
    monkeypatch.setattr(T, "QUERIES", queries)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, T.top_k(df, F.col("id") % 7 == 0).collect()))
    assert got == brute(rows, lambda i: i % 7 == 0, 5)


def test_odd_vectors(spark):
    rows = [(0, [0.5, -0.25]), (2, None), (4, [None, 1.0]), (6, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [0.5, 0.5]), (10, []), (12, [1.0]), (14, [0.5, -0.25]), (14, [0.5, -0.25]), (14, [0.25, -0.25]), (15, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2.0, [1]) for r in rows], "vec_id long, embedding array<double>, id int, score double, v array<int>")
    got = sorted(map(tuple, T.top_k(df, F.col("id") % 2 == 0).collect()))
    assert got == brute(rows, lambda i: i % 2 == 0, 5) and {r[0] for r in got} == {0, 10, 12, 14}
    assert sum(r[0] == 14 for r in got) == 15


def test_large_values_and_repeated_ids(spark):
    """Components beyond 2^23, scores beyond a long, and rows that share an id."""
    rows = [(50, [1.0, 1.0]), (1, [40000.0, 0.0]), (2, [50000.0, 0.0]), (3, [1.0, 0.0]), (3, [0.0, 9e4]), (3, [0.0, 9e4]), (4, [-7e9, 3.0]), (5, [1e18, -1.0]), (6, [2e18, 1e18]), (100, [3e9, 2.5e-3]), (100, [1e14, 1e14])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for k in (2, 5, 20):
        assert sorted(map(tuple, T.top_k(df, F.col("id") % 50 == 0, k).collect())) == brute(rows, lambda i: i % 50 == 0, k)
    best = {r["rank"]: (r.id, r.score) for r in T.top_k(df.where("vec_id < 3 OR vec_id = 50"), F.col("id") == 50).collect()}
    assert best == {1: (2, 3276800000), 2: (1, 2621440000)}
    floats = spark.createDataFrame([(0, [3e38, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert T.top_k(floats, F.col("id") == 1).first().score == (1 << 63) - 1


def test_no_rows_and_no_queries(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert T.top_k(empty, F.col("id") % 2 == 0).count() == 0
    assert T.top_k(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), F.col("id") % 2 == 0).count() == 0


@pytest.mark.parametrize("clustered", [True, False])
def test_most_rows_are_proven_out(clustered):
    """Few rows are scored exactly, segments are left over, and the result is that of all scores."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 32, size=(3000, 64))
    if clustered:
        x = x / 4 + rng.normal(0, 32, size=(30, 64))[rng.integers(0, 30, 3000)]
    x = np.floor(x)
    index = T.BlockIndex(np.arange(3000), x)
    scored, processed = [], []
    for own in range(0, 3000, 150):
        at, scores, n, postings = index.search(own, x[own], 5)
        every = x @ x[own]
        every[own] = -np.inf
        assert at.tolist() == np.lexsort((np.arange(3000), -every))[:5].tolist() and scores.tolist() == every[at].tolist()
        scored.append(n)
        processed.append(postings)
    assert np.mean(scored) < 0.1 * 3000 and np.mean(processed) < 0.75 * x.size


def test_equal_rows_can_not_be_proven_out():
    x = np.ones((500, 8))
    at, scores, n, postings = T.BlockIndex(np.arange(500), x).search(3, np.ones(8), 5)
    assert at.tolist() == [0, 1, 2, 4, 5] and set(scores) == {8.0} and n == 499 and postings == x.size


def test_work_is_reported(spark):
    df = spark.createDataFrame(vectors(2000, 16), "vec_id long, embedding array<double>")
    got = T.work(df, F.col("id") % 500 == 0).collect()
    assert {r.query_id for r in got} == {0, 500, 1000, 1500, 2000} and all(0 < r.scored < 2043 for r in got)
