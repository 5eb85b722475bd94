"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import embedding_dedup as pq

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows, floor=0.98):
    n = len(rows)
    usable = lambda v, k: v is not None and k is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    at, links = list(range(n)), [0] * n
    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if usable(v, k) else None for _, v, k in rows]

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    groups = {}
    for i, (_, v, k) in enumerate(rows):
        if unit[i] is not None:
            groups.setdefault((k, len(v)), []).append(i)
    for own in groups.values():
        m = np.stack([unit[i] / np.linalg.norm(unit[i]) for i in own])
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= floor, 1)), strict=True):
            i, j = own[a], own[b]
            links[i] += 1
            links[j] += 1
            at[top(i)] = top(j)
    least = {}
    for i, (v, _, _) in enumerate(rows):
        least.setdefault(top(i), []).append(v)
    name = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((v, links[i], name[top(i)], v == name[top(i)]) for i, (v, _, _) in enumerate(rows)), key=str)


def cloud(seed, n, dim, groups, noise=0.1, label=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    for size in groups:
        x = np.concatenate([x, r.normal(size=dim) + noise * r.normal(size=(size, dim))])
    return [(i, v.astype(np.float32).tolist(), label) for i, v in enumerate(x[r.permutation(len(x))])]


def got(spark, rows, schema=VECTORS, **more):
    docs = spark.createDataFrame(rows, schema).withColumn("list", F.lit(1)).withColumn("c", F.lit("x")).withColumn("n_links", F.lit(7)).repartition(5)
    return sorted((tuple(r) for r in pq.near_duplicates(docs, **more).collect()), key=str)


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pq, "LIST", 16)  # many lists and blocks on few rows
    monkeypatch.setattr(pq, "BLOCK", 50)
    rows = cloud(1, 500, 64, [150, 40, 2, 2, 2, 5]) + [(2000 + i, v, 5) for i, v, _ in cloud(2, 300, 64, [30], 0.15)]
    rows += [(5000 + i, [2.5 * x for x in v], k) for i, v, k in rows[:40]]  # other lengths, same direction
    rows += rows[:30] + [(None, v, k) for _, v, k in rows[20:60]] + [(9999, v, k) for _, v, k in rows[::90]]
    want = plain(rows)
    assert sum(r[1] for r in want) > 20_000
    assert got(spark, rows) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, nan], 1), (6, [1.0, inf], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (None, None, None), (12, [1e30, 1e30], 1), (13, [1e-30, 1e-30], 1), (14, [-1.0, 0.0], 1)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []
    assert got(spark, [(1, None, 1)]) == [(1, 0, 1, True)]
    big = [(i, [1e300 * x for x in v], "é" if k else None) for i, v, k in cloud(4, 30, 9, [6], 0.01)]
    assert got(spark, big, "vec_id long, embedding array<double>, label string") == plain(big)


@pytest.mark.parametrize(("dim", "noise"), [(64, 0.09), (64, 0.14), (7, 0.1), (200, 0.1)])
def test_recall_of_fewer_probes(spark, monkeypatch, dim, noise):
    monkeypatch.setattr(pq, "LIST", 16)
    rows = cloud(5, 1500, dim, [3] * 300, noise)
    want = sum(r[1] for r in plain(rows))
    assert sum(r[1] for r in got(spark, rows)) == want
    assert sum(r[1] for r in got(spark, rows, reach=0.25)) >= 0.9 * want


def test_estimates_never_hide_a_link():
    r = np.random.default_rng(7)
    x = r.normal(size=(4000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ix = pq.Index(x, np.full(len(x), 4))
    home, others = ix.probes(x, 4, 0.1)
    near = x + 0.19 * r.normal(size=x.shape).astype(np.float32) / np.sqrt(32)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    home2, others2 = ix.probes(near, 4, 0.1)
    linked = (x.astype(float) * near).sum(axis=1) >= 0.98
    for i in np.flatnonzero(linked):
        assert home[i] == home2[i] or home2[i] in others[i] or home[i] in others2[i]
    rest = x - ix.centroids[4][home]
    codes, decoded = ix.code(rest)
    error = np.sqrt(((rest - decoded) ** 2).sum(axis=1))
    query = near - ix.centroids[4][home]
    for i in range(0, 4000, 40):
        est = ix.estimates(query[i : i + 1], codes[i : i + 1], (decoded[i : i + 1] ** 2).sum(axis=1))[0, 0]
        assert abs(est - ((query[i] - decoded[i]) ** 2).sum()) < 1e-4
        assert not linked[i] or est <= (0.2 + error[i]) ** 2 + 1e-4
    assert pq.spread(np.repeat(x[:5], 100, axis=0), 50).shape[0] == 5
