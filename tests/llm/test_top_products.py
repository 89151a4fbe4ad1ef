import math
import random

import numpy as np
import pytest

from ohmlake.llm import top_products as T
from ohmlake.llm.top_products import OP12_SQL, op12_top_products
from tests.oracle import compare, connected


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, queries, k, scale=256):
    """rows, queries: (id, vector)."""
    whole = lambda v: [math.floor(scale * x) for x in v]
    out = []
    for q, a in queries:
        if not fine(a):
            continue
        found = [(sum(x * y for x, y in zip(whole(a), whole(b))), i) for i, b in rows if fine(b) and len(b) == len(a) and (i is None or i != q)]
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out, key=str)


def vectors(rng, n, kind):
    if kind == "lengths":  # very uneven lengths, some zero
        return [[rng.gauss(0, 1) * 10 ** rng.uniform(-3, 2) for _ in range(6)] if i % 17 else [0.0] * 6 for i in range(n)]
    if kind == "clusters":  # near copies: cosines near 1
        centers = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(8)]
        return [[x + rng.gauss(0, 0.02) for x in rng.choice(centers)] for _ in range(n)]
    return [[float(rng.randint(-2, 2)) for _ in range(3)] for _ in range(n)]  # ties


@pytest.mark.parametrize("kind", ["lengths", "clusters", "ties"])
def test_pruned_search(spark, kind):
    rng = random.Random(kind)
    rows = list(enumerate(vectors(rng, 600, kind)))
    queries = rows[::25] + [(9999, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as rank", "3 as id")
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    for k, bytes_ in ((5, 1 << 20), (1, 400), (700, 1 << 20)):
        got = T.top_k(df, asked, k, block_bytes=bytes_)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, queries, k)


def test_both_prunings_are_chosen_and_drop_nothing(monkeypatch):
    monkeypatch.setattr(T, "CELLS", 500)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 0.01
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)  # of one length, but for rounding
    x[::3] //= 3  # shorter ones
    q = np.concatenate([x[1:91:3], np.floor(rng.normal(size=(30, 16)) * 99).astype(np.int64)])
    search = T.Search(np.arange(60), q, 4)
    order = np.argsort(-np.linalg.norm(x, axis=1), kind="stable")
    for at in range(0, 3000, 250):
        own = order[at : at + 250]
        search.bucket(own, np.zeros(len(own), bool), x[own])
    assert search.by_coordinates > 20 and search.by_length > 50
    assert search.by_coordinates + search.by_length < 60 * 12  # some buckets are skipped as a whole
    scores = q @ x.T
    scores[np.arange(60), np.arange(60)] = -(2**60)
    for i in range(60):
        want = np.lexsort((np.arange(3000), -scores[i]))[:4]
        own = search.best[0] == i
        assert search.best[3][own].tolist() == want.tolist() and search.best[1][own].tolist() == scores[i][want].tolist()


def test_large_scores():
    big = np.array([[2**30, 1], [2**30, 2], [2**30 - 1, 2**29]], np.int64)
    search = T.Search(np.array([50]), np.array([[2**31, 3]]), 2)
    search.bucket(np.arange(3), np.zeros(3, bool), big)
    assert search.best[3].tolist() == [1, 0] and search.best[1].tolist() == [2**61 + 6, 2**61 + 3]
    with pytest.raises(ValueError):
        search.bucket(np.arange(3), np.zeros(3, bool), big * 4)


def test_small_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, []), (300, [1.0, 2.0, 3.0]), (350, [0.0, 0.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (400, [-1.0, -2.0]), (3, [0.5, -0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = [r for r in rows if r[0] is not None and r[0] % 50 == 0]
    got = T.top_k(df, df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, queries, 5)
    nobody = df.where("vec_id is null").withColumnRenamed("vec_id", "query_id")
    assert sorted(map(tuple, T.top_k(df, nobody, 2).collect()), key=str) == [(None, 1, 0, 5 * 65536), (None, 2, 0, 5 * 65536)]
    for a, b in ((df.limit(0), df), (df, df.limit(0)), (df.where("vec_id = 50"), df)):
        assert T.top_k(a, b.withColumnRenamed("vec_id", "query_id")).count() == 0


def test_query(spark):
    at = "/root/testdata/sf0.001"
    got = op12_top_products(spark, at)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert compare(got, connected(at), OP12_SQL) == 50
