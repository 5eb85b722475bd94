"""The vector index against all pairs: recall at several floors, the exact way, odd vectors."""

import numpy as np
import pytest

from claimweave.functions import vector_index
from claimweave.functions.vectors import vector_join


def planted(seed, n, dim, floor, pairs):
    """Random vectors, and pairs of them at cosines just over the floor."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(pairs):
        side = r.normal(size=dim)
        side -= (side @ x[2 * i]) * x[2 * i]
        c = floor + 0.002 + (1 - floor) * 0.2 * r.random()
        x[2 * i + 1] = c * x[2 * i] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    return [(i, (v * (1 + i % 5)).tolist()) for i, v in enumerate(x)]


VECTORS = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("floor", [0.7, 0.85, 0.95])
def test_recall_and_the_exact_way(spark, monkeypatch, floor):
    monkeypatch.setattr(vector_index, "LIST", 32)
    monkeypatch.setattr(vector_index, "BLOCK", 40)
    rows = planted(int(100 * floor), 3000, 64, floor, 400)
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(v @ v.T >= floor, 1)), strict=True)}
    for exact in (True, False):
        got = vector_index.near_pairs(df, "vec_id", floor, exact=exact).collect()
        found = {(r.a, r.b) for r in got}
        assert len(found) == len(got) and found <= want
        assert found == want if exact else len(found) >= 0.97 * len(want)
        assert all(abs(r.similarity - v[r.a] @ v[r.b]) < 1e-12 for r in got)


def test_index_equals_all_pairs_on_dense_groups(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "LIST", 16)
    monkeypatch.setattr(vector_index, "BLOCK", 30)
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(200, 16)), r.normal(size=16) + 0.2 * r.normal(size=(150, 16))])
    df = spark.createDataFrame([(f"k{i:04}", v.tolist()) for i, v in enumerate(x)], "key string, embedding array<double>")
    pairs = lambda d: sorted((p.a, p.b, round(p.similarity, 9)) for p in d.collect())
    want = pairs(vector_join(df, "key", 0.6))
    assert pairs(vector_index.near_pairs(df, "key", 0.6, exact=True)) == want and len(want) > 9_000


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, nan]), (6, [1.0, None]), (7, [-1.0, 0.0]), (1, [3.0, 0.0])]
    got = vector_index.near_pairs(spark.createDataFrame(rows, VECTORS), "vec_id", 0.9).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1.0), (1, 2, 1.0)]
    assert vector_index.near_pairs(spark.createDataFrame([], VECTORS), "vec_id", 0.9).count() == 0
