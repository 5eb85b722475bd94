"""Work of hubs, many rows and many runs is dealt among tasks: the same results, no task with all of it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.functions import rounds, vector_index
from claimweave.operators import components, network


def by_search(links):
    near = {}
    for u, v in links:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    found = {}
    for start in sorted(near):
        todo = [start] if start not in found else []
        while todo:
            if (x := todo.pop()) not in found:
                found[x] = start
                todo += near[x]
    return found


def test_links_of_a_hub_stay_where_they_lie(spark):
    star = spark.range(1, 2001, numPartitions=8).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    got = components._large_star(star, 100).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("v").alias("v")).collect()
    assert sum(r.n for r in got) == 2000 and max(r.n for r in got) <= 250 and {r.v for r in got} == {0}


def test_components_with_hubs_equal_a_search(spark, monkeypatch):
    monkeypatch.setattr(components, "HEAVY", 3)
    rng = random.Random(5)
    links = [(0, k) for k in range(1, 40)] + [(900, k) for k in range(100, 130)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(39, 130), (129, 900), (7, 7)]
    found = by_search([x for x in links if x[0] != x[1]])
    df = spark.createDataFrame([*links, *links[:20], (None, 1), (2, None)], "u long, v long")
    assert {r.node: r.component for r in components.components(df).collect()} == found
    assert components.components(df.limit(0)).count() == 0


def test_shuffles_go_by_rows_not_bytes(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    with rounds.by_rows(spark, 20 * rounds.ROWS):
        assert spark.range(100).groupBy((F.col("id") % 7).alias("k")).count().rdd.getNumPartitions() == 21
    assert {k: spark.conf.get(k) for k in was} == was


@pytest.mark.parametrize("kind", ["long", "string"])
def test_low_floors_go_by_blocks_and_lose_no_pair(spark, monkeypatch, kind):
    monkeypatch.setattr(vector_index, "FEWEST", 100)
    labels, write = [], vector_index.written
    monkeypatch.setattr(vector_index, "written", lambda df, label: labels.append(label) or write(df, label))
    x = np.random.default_rng(4).normal(size=(900, 16)) * np.array([1e-200, 1, 1e200])[np.arange(900) % 3][:, None]
    key = [i if kind == "long" else f"k{i:03}" for i in [*range(899), 5]]  # a key that repeats
    rows = spark.createDataFrame([*zip(key, x.tolist(), strict=True), (None, [1.0] * 16), (key[0], [0.0] * 16)], f"id {kind}, embedding array<double>")
    got = [(r.a, r.b, round(r.similarity, 6)) for r in vector_index.near_pairs(rows, "id", 0.35, exact=True).collect()]
    assert "blocks" in labels and "listed" not in labels
    u = vector_index.unit([v.tobytes() for v in x])
    sims = u @ u.T
    want = [(*sorted((key[i], key[j])), round(sims[i, j], 6)) for i in range(900) for j in range(i) if key[i] != key[j] and sims[i, j] >= 0.35]
    assert len(got) == len(want) > 1000 and all(g[:2] == w[:2] and abs(g[2] - w[2]) < 2e-6 for g, w in zip(sorted(got), sorted(want), strict=True))


def test_influence_does_not_shuffle_its_edges_in_rounds(spark):
    """Edges are dealt by target: a round's sums over them come without an exchange."""
    e = spark.createDataFrame([(i % 7, 10 + i % 13) for i in range(100)], "src long, dst long").withColumn("p", F.lit(0.5))
    state = e.select("src").distinct().withColumn("x", F.lit(1.0))
    with rounds.dealt(e, "dst") as a:
        a.count()
        got = a.join(rounds.light(state, 7), "src").groupBy("dst").agg(F.sum(F.col("p") * F.col("x")).alias("x"))
        assert {r.dst: r.x for r in got.collect()} == {r.dst: r["count"] / 2 for r in e.groupBy("dst").count().collect()}
        assert "hashpartitioning(dst" not in got._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    none = network.influence(e.limit(0).select("src", "dst"))
    assert none.columns == ["node", "pagerank", "eigenvector", "influence"] and none.count() == 0


def test_communities_deal_a_hub_and_stay_the_same(spark, monkeypatch):
    e = spark.createDataFrame([(0, k, 1.0) for k in range(1, 301)] + [(k, k + 1, 2.0) for k in range(301, 320)], "src long, dst long, weight double")
    want = {tuple(r) for r in network.communities(e).collect()}
    monkeypatch.setattr(rounds, "ROWS", 40)
    with rounds.dealt(e, "src", "dst") as a:
        assert max(r["count"] for r in a.groupBy(F.spark_partition_id()).count().collect()) < 100
    assert {tuple(r) for r in network.communities(e).collect()} == want and len(want) == 321
