"""Iterations to convergence: trust, modularity, centrality, against plain versions on small graphs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.functions.rounds import settle
from claimweave.operators import centrality, modularity, network, trust

@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Many small rounds: two tasks each are enough."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


EDGES = "src long, dst long, weight double, rel_type string"


def test_settle_stops_early_and_counts_rounds(spark):
    start = spark.createDataFrame([(1.0, 0.0)], "x double, was double")
    step = lambda now: now.select((F.col("x") / 2).alias("x"), F.col("x").alias("was"))
    got = settle(start, step, F.max(F.abs(F.col("x") - F.col("was"))), 50, 0.1)
    assert (got.rounds, got.settled) == (4, True) and got.state.first().x == 1 / 16
    assert not settle(start, step, F.max(F.abs(F.col("x") - F.col("was"))), 2, 0.1).settled
    assert settle(start.limit(0), step, F.max("x"), 5, 0.1).rounds == 1


def plain_trust(t0, edges, damping=0.85, rounds=20, tol=1e-6, compat=False):
    ids = sorted(t0)
    at = {v: i for i, v in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for s, d, w in edges:
        if s in at and d in at:
            a[at[s], at[d]] += w
    total = np.zeros(len(ids))
    for s, d, w in edges:  # the divisor counts edges from unknown nodes, too
        if d in at:
            total[at[d]] += w
    total[total == 0] = 1
    a = a / (total[:, None] if compat else total[None, :])
    start = np.array([t0[v] for v in ids])
    t = start.copy()
    for k in range(rounds):
        new = (1 - damping) * start + damping * (a.T @ t)
        done = np.linalg.norm(new - t) < tol
        t = new
        if done:
            break
    scaled = (t - t.min()) / (t.max() - t.min()) if t.max() > t.min() else np.zeros_like(t)
    return dict(zip(ids, scaled, strict=True)), k + 1


@pytest.mark.parametrize("compat", [False, True])
def test_trust_settles_as_by_matrix(spark, compat):
    rng = random.Random(3)
    t0 = {i: rng.random() for i in range(30)}
    edges = [(rng.randrange(32), rng.randrange(32), rng.choice([1.0, 0.5, 0.7, -0.2])) for _ in range(120)]
    nodes = spark.createDataFrame(list(t0.items()), "node long, t0 double")
    e = spark.createDataFrame([*edges, (None, 1, 1.0), (1, 2, None)], "src long, dst long, w double")
    want, _ = plain_trust(t0, edges, compat=compat)
    got = {r.node: r.trust for r in trust.settled_trust(nodes, e, compat_norm=compat).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    seeds = {3: 0.9, 7: 0.0}
    want, _ = plain_trust({**t0, **seeds}, edges, compat=compat)
    s = spark.createDataFrame([*seeds.items(), (3, 0.1), (99, 1.0), (None, 1.0), (5, None)], "node long, score double")
    got = {r.node: r.trust for r in trust.settled_trust(nodes, e, s, compat_norm=compat).collect()}
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_trust_stops_when_settled_and_for_each_user_alone(spark):
    t0 = {i: 0.5 + i / 20 for i in range(6)}
    edges = [(i, i + 1, 1.0) for i in range(5)]
    nodes, e = spark.createDataFrame(list(t0.items()), "node long, t0 double"), spark.createDataFrame(edges, "src long, dst long, w double")
    users = spark.createDataFrame([(1, 0, 1.0), (1, 3, 0.0), (2, 5, 0.2), (3, 77, 1.0), (None, 1, 1.0)], "user_id long, node long, score double")
    got = {(r.user_id, r.node): r.trust for r in trust.personal_trust(users, nodes, e).collect()}
    for user, own in ((1, {0: 1.0, 3: 0.0}), (2, {5: 0.2}), (3, {})):
        want, rounds = plain_trust({**t0, **own}, edges)
        assert rounds < 20 and all(abs(got[user, k] - want[k]) < 2e-6 for k in want)
    assert len(got) == 18
    assert trust.settled_trust(nodes.limit(0), e).count() == 0
    flat = trust.settled_trust(nodes.withColumn("t0", F.lit(0.5)), e.limit(0)).collect()
    assert {r.trust for r in flat} == {0.0}


def plain_modularity(edges, place):
    w = [(s, d, x) for s, d, x in edges if s != d and x > 0]
    m = sum(x for *_, x in w)
    deg = {}
    for s, d, x in w:
        deg[s], deg[d] = deg.get(s, 0) + x, deg.get(d, 0) + x
    tot = {}
    for v, k in deg.items():
        tot[place[v]] = tot.get(place[v], 0) + k
    return sum(x for s, d, x in w if place[s] == place[d]) / m - sum(t * t for t in tot.values()) / (4 * m * m)


def plain_louvain(edges):
    """One node at a time, level by level, until nothing gains."""
    nodes = sorted({v for s, d, _ in edges for v in (s, d)})
    place = {v: v for v in nodes}
    now = list(edges)
    while True:
        adj, deg, m = {}, {}, sum(x for *_, x in now)
        for s, d, x in now:
            adj.setdefault(s, {}).setdefault(d, 0)
            adj.setdefault(d, {}).setdefault(s, 0)
            if s != d:
                adj[s][d] += x
                adj[d][s] += x
            deg[s], deg[d] = deg.get(s, 0) + x, deg.get(d, 0) + x
        c, tot, moved, again = {v: v for v in adj}, dict(deg), False, True
        while again:
            again = False
            for v in sorted(adj):
                own = c[v]
                tot[own] -= deg[v]
                w = {own: 0.0}
                for u, x in adj[v].items():
                    if u != v:
                        w[c[u]] = w.get(c[u], 0) + x
                best = max(sorted(w), key=lambda k: (w[k] - tot[k] * deg[v] / (2 * m), k == own))
                c[v] = best
                tot[best] += deg[v]
                again |= best != own
                moved |= best != own
        place = {v: c[place[v]] for v in place}
        if not moved:
            return place
        merged = {}
        for s, d, x in now:
            k = (min(c[s], c[d]), max(c[s], c[d]))
            merged[k] = merged.get(k, 0) + x
        now = [(s, d, x) for (s, d), x in merged.items()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_louvain_comes_near_the_plain_one(spark, seed):
    rng = random.Random(seed)
    groups = [range(10 * k, 10 * k + rng.randint(4, 10)) for k in range(6)]
    edges = [(a, b, rng.choice([0.5, 1.0, 2.0])) for g in groups for a in g for b in g if a < b and rng.random() < 0.6]
    edges += [(rng.choice(rng.choice(groups)), rng.choice(rng.choice(groups)), 0.5) for _ in range(15)]
    edges = [x for x in edges if x[0] != x[1]]
    want = plain_modularity(edges, plain_louvain(edges))
    rows = [(s, d, w, "CITES") for s, d, w in edges] + [(0, 55, 9.0, "CONTRADICTS"), (1, 1, 5.0, "CITES"), (2, 3, -1.0, "CITES")]
    levels = modularity.louvain(spark.createDataFrame(rows, EDGES).repartition(3))
    reached = [x.modularity for x in levels]
    assert reached == sorted(reached) and reached[-1] >= want - 0.03
    for level in levels:
        place = {r.node: r.community for r in level.place.collect()}
        assert abs(plain_modularity(edges, place) - level.modularity) < 1e-9
        assert all(min(v for v in place if place[v] == c) == c for c in set(place.values()))
    for a, b in zip(levels, levels[1:]):  # a level only joins what the one before it held together
        fine, coarse = ({r.node: r.community for r in x.place.collect()} for x in (a, b))
        assert len({(fine[v], coarse[v]) for v in fine}) == len(set(fine.values()))


def test_louvain_defaults_and_edges(spark):
    rows = [(1, 2, None, "CITES"), (2, 3, None, "RELATED_TO"), (3, 4, None, "OTHER"), (4, 5, None, "CONTRADICTS"), (5, 6, 2.0, None), (7, 8, 0.0, "CITES")]
    got = sorted(map(tuple, modularity.undirected(spark.createDataFrame(rows, EDGES)).where("src < dst").collect()))
    assert got == [(1, 2, 1.0), (2, 3, 0.5), (3, 4, 0.5), (5, 6, 2.0)]
    assert modularity.louvain(spark.createDataFrame([], EDGES)) == [] or modularity.communities(spark.createDataFrame([], EDGES)).count() == 0
    out = modularity.communities(spark.createDataFrame(rows, EDGES)).where("level = 1").collect()
    assert {r.node for r in out} == {1, 2, 3, 4, 5, 6} and {r.community for r in out if r.node > 4} == {5}


def plain_betweenness(n, edges, pivots=None):
    out = dict.fromkeys(range(n), 0.0)
    adj = {}
    for (s, d), w in edges.items():
        adj.setdefault(s, []).append((d, w))
    for s in pivots if pivots is not None else range(n):
        dist, todo = {s: 0}, {s}
        while todo:
            v = min(todo, key=lambda x: dist[x])
            todo.remove(v)
            for u, w in adj.get(v, []):
                if u not in dist or dist[v] + w < dist[u]:
                    dist[u] = dist[v] + w
                    todo.add(u)
        order = sorted(dist, key=lambda x: dist[x])
        paths = dict.fromkeys(order, 0.0)
        paths[s] = 1.0
        back = {v: [] for v in order}
        for v in order:
            for u, w in adj.get(v, []):
                if dist[v] + w == dist[u]:
                    paths[u] += paths[v]
                    back[u].append(v)
        dep = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in back[v]:
                dep[u] += paths[u] / paths[v] * (1 + dep[v])
            if v != s:
                out[v] += dep[v]
    return out


@pytest.mark.parametrize("weighted", [True, False])
def test_betweenness_equals_plain_version(spark, weighted):
    rng = random.Random(4)
    edges = {}
    for _ in range(60):
        s, d = rng.randrange(20), rng.randrange(20)
        if s != d:
            edges[s, d] = rng.choice([1, 2, 2, 3])
    rows = [(s, d, float(w), "CITES") for (s, d), w in edges.items()] + [(0, 19, 5.0, "CONTRADICTS"), (3, 3, 1.0, "CITES"), (None, 1, 1.0, "CITES")]
    rows += [(s, d, w / 2, "CITES") for s, d, w, k in rows[:10] if k == "CITES"]  # lighter parallel edges
    e = spark.createDataFrame(rows, EDGES).repartition(3)
    own = edges if weighted else dict.fromkeys(edges, 1)
    want = plain_betweenness(20, own)
    got = {r.node: r.betweenness for r in centrality.betweenness(e, weighted=weighted).collect()}
    assert all(abs(got.get(v, 0.0) - want[v]) < 1e-9 for v in want)
    some = spark.createDataFrame([(2,), (5,), (None,), (2,)], "node long")
    got = {r.node: r.betweenness for r in centrality.betweenness(e, some, weighted=weighted).collect()}
    assert all(abs(got.get(v, 0.0) - x) < 1e-9 for v, x in plain_betweenness(20, own, [2, 5]).items())


def test_betweenness_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1, 0.1 * (1 + i % 3), "CITES") for i in range(20)], EDGES)
    got = {r.node: r.betweenness for r in centrality.betweenness(e).collect()}
    assert got == {i: float(i * (20 - i)) for i in range(21)}
    old = {r.node: r.betweenness for r in network.betweenness(e, spark.range(21).withColumnRenamed("id", "node")).collect()}
    assert old[10] == 100.0  # no step is too far
    assert centrality.betweenness(e.limit(0)).count() == 0


@pytest.mark.parametrize("weighted", [True, False])
def test_betweenness_by_blocks_shuffles_no_row_for_each_pivot_and_edge(spark, weighted, monkeypatch):
    from claimweave.operators import brandes
    from test_bounded import shuffled

    for name, few in (("PIVOTS", 16), ("BLOCK", 512), ("ROWS", 8), ("PART", 64)):
        monkeypatch.setattr(brandes, name, few)
    rng = random.Random(8)
    edges = {(s, d): rng.choice([1, 2, 3]) for s in range(80) for d in rng.sample(range(80), 25) if s != d}
    e = spark.createDataFrame([(s, d, float(w), "CITES") for (s, d), w in edges.items()], EDGES)
    got, rows = shuffled(spark, lambda: {r.node: r.betweenness for r in centrality.betweenness(e, weighted=weighted).collect()})
    want = plain_betweenness(80, edges if weighted else dict.fromkeys(edges, 1))
    assert got.keys() == want.keys() and all(abs(got[v] - x) < 1e-9 for v, x in want.items())
    assert rows < 40_000  # 80 pivots times 1,975 edges are 158,000


@pytest.mark.parametrize("few", [{}, {"KINDS": 2}, {"FULL": 0, "PART": 8}, {"ALONE": 150, "WAVE": 600}, {"OWN": 0, "WORK": 500, "HELD": 40}, {"SPLIT": 0, "WAVE": 1}])
def test_betweenness_by_components(spark, monkeypatch, few):
    from claimweave.operators import brandes

    for name, value in few.items():
        monkeypatch.setattr(brandes, name, value)
    rng = random.Random(9)
    edges = {}
    for start, n, k in ((0, 30, 7), (30, 25, 3), (55, 3, 1), (58, 2, 1)):
        for s in range(start, start + n):
            for d in rng.sample(range(start, start + n), k):
                if s != d:
                    edges[s, d] = rng.choice([1, 2, 2, 3])
    edges |= {(i, i + 1): 1 for i in range(60, 79)}
    rows = [(s, d, float(w), "CITES") for (s, d), w in edges.items()] + [(90, 91, 1.0, "CONTRADICTS")]
    e = spark.createDataFrame(rows, EDGES).repartition(5)
    own = plain_betweenness(92, edges)
    got = {r.node: r.betweenness for r in centrality.betweenness(e).collect()}
    assert {90, 91} <= got.keys() and all(abs(got.get(v, 0.0) - x) < 1e-9 for v, x in own.items())
    some = spark.createDataFrame([(2,), (35,), (61,), (90,)], "node long")
    want = plain_betweenness(92, dict.fromkeys(edges, 1), [2, 35, 61])
    got = {r.node: r.betweenness for r in centrality.betweenness(e, some, weighted=False).collect()}
    assert all(abs(got.get(v, 0.0) - x) < 1e-9 for v, x in want.items())
    steps = {r.node: r.betweenness for r in centrality.betweenness(e, some, weighted=False, longest=3).collect()}
    assert steps[62] == 2.0 and steps[63] == 1.0 and steps[64] == 0.0


def test_parted_graphs_shuffle_edges_alone(spark):
    from test_bounded import shuffled

    rng = random.Random(10)
    edges = [(60 * c + s, 60 * c + d, 1.0, "CITES") for c in range(20) for s in range(60) for d in rng.sample(range(60), 12) if s != d]
    e = spark.createDataFrame(edges, EDGES)
    got, rows = shuffled(spark, lambda: centrality.betweenness(e).count())
    assert got == 1_200 and rows < 150_000  # 1,200 nodes squared are 1,440,000


def test_influence_equals_plain_version(spark):
    rng = random.Random(6)
    n, edges = 15, {}
    for i in range(n):
        for d in rng.sample(range(n), 3):
            if d != i:
                edges[i, d] = rng.choice([0.25, 0.5, 1.0, 2.0])
    rows = [(s, d, w, "CITES") for (s, d), w in edges.items()]
    got = {r.node: r for r in centrality.influence(spark.createDataFrame(rows, EDGES)).collect()}
    a = np.zeros((n, n))
    for (s, d), w in edges.items():
        a[s, d] = w
    out = a.sum(axis=1)
    r = np.full(n, 1 / n)
    for _ in range(200):
        r = 0.15 / n + 0.85 * ((a / np.where(out > 0, out, 1)[:, None]).T @ r + r[out == 0].sum() / n)
    x = np.full(n, 1 / n)
    for _ in range(2000):
        x = x + a.T @ x
        x /= np.linalg.norm(x)
    b = plain_betweenness(n, edges)
    for v in range(n):
        between = b[v] / ((n - 1) * (n - 2))
        if r[v] > 0.011 or between > 0.051 or x[v] > 0.051:
            assert abs(got[v].pagerank - r[v]) < 1e-4 and abs(got[v].eigenvector - x[v]) < 1e-4 and abs(got[v].betweenness - between) < 1e-6
            assert abs(got[v].influence - (r[v] + x[v] + between) / 3) < 1e-4
            assert [(p.target, p.strength) for p in got[v].paths] == sorted((d, w) for (s, d), w in edges.items() if s == v and w > 0.5)
    assert len(got) >= 10 and centrality.pivot_error(100, 100) == 0 and 0.05 < centrality.pivot_error(10_000, 1000) < 0.1
    part = centrality.influence(spark.createDataFrame(rows, EDGES), pivots=8).collect()
    assert all(abs(p.betweenness - b[p.node] / ((n - 1) * (n - 2))) <= centrality.pivot_error(n, 8) for p in part)


def test_the_query_of_influence_takes_all_nodes_for_pivots(spark, sf, monkeypatch):
    from claimweave.plans.registry import QUERIES

    asked = []
    monkeypatch.setattr(centrality, "influence", lambda edges, pivots=None, **more: asked.append(pivots) or edges)
    QUERIES["g10_influence_in_full"](spark, sf)
    assert asked == [None]
