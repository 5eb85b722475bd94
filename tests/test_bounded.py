"""Rows that are shuffled: of jobs on pairs and paths, on graphs where pairs and paths are many more than edges."""

import pytest
from pyspark.sql import functions as F

from claimweave.operators import citations, graph, network


def shuffled(spark, run):
    """What run returns, and the rows that its stages shuffled."""
    sc = spark.sparkContext
    gateway = sc._gateway

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(gateway.jvm.java.util.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    out = run()
    return out, total() - before


def written_bytes(spark, run):
    """What run returns, and the bytes that its stages shuffled."""
    sc = spark.sparkContext
    gateway = sc._gateway

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(gateway.jvm.java.util.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    out = run()
    return out, total() - before


def test_reach_carries_claims_as_arrays(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(citations, "PIECE", 7)
    # 1,000 claims, each with 2 of 40 entities: 50 claims an entity, whose ids lie 64 apart
    m = spark.range(1000).selectExpr("id * 64 as claim_id", "explode(array(id % 40, (id * 7 + id div 40) % 40)) as entity")
    try:
        got, rows = shuffled(spark, lambda: citations.entity_reach(m).toPandas())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    own = m.distinct().toPandas().groupby("claim_id")["entity"].apply(set).to_dict()
    for claim, n in got.sample(50, random_state=1).itertuples(index=False):
        assert n == sum(bool(own[claim] & other) for other in own.values()) - 1
    assert len(got) == 1000
    assert rows < 40_000  # a row for each claim that a set of entities meets would be 100,000


def test_reach_counts_the_claims_of_an_entity(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    # 12,000 claims, each with up to 4 of 6,000 entities, 8 claims an entity; 20 pairs of claims are the same
    m = spark.range(12_000).selectExpr("id * 64 as claim_id", "explode(transform(sequence(0, 3), i -> pmod(xxhash64(id % 11980, i), 6000))) as entity").localCheckpoint()
    try:
        got, carried = written_bytes(spark, lambda: citations.entity_reach(m).toPandas())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = m.distinct().toPandas()
    own, of = rows.groupby("claim_id")["entity"].apply(set).to_dict(), rows.groupby("entity")["claim_id"].apply(set).to_dict()
    assert {r.claim_id: r.n_partners for r in got.itertuples()} == {c: len(set().union(*(of[e] for e in es))) - 1 for c, es in own.items()}
    assert carried < 3_000_000  # the claims of an entity as arrays, sent to each set that holds it, are 48,000 arrays of 8 words


def _random_graph(spark, n=600, degree=60):
    return spark.range(n * degree).selectExpr(f"id % {n} as src", f"pmod(xxhash64(id), {n}) as dst", "1.0 + pmod(xxhash64(id, 7), 50) / 10 as weight").where("src <> dst").dropDuplicates(["src", "dst"]).localCheckpoint()


def test_top_cascades_and_chains_unite_few_paths(spark):
    e = _random_graph(spark)
    edges = e.toPandas()
    after = edges.groupby("src")["dst"].apply(set).to_dict()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        casc, rows1 = shuffled(spark, lambda: graph.cascades(e, top=5).toPandas())
        chain, rows2 = shuffled(spark, lambda: graph.chains(e, 20).toPandas())
        links, rows3 = shuffled(spark, lambda: graph.pattern_links(graph.pattern_store(link=(e, ["src", "dst"]))).count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    size = {a: len(set().union(*(after.get(b, set()) for b in s)) - {a}) * len(s) for a, s in after.items()}
    want = sorted(((-m, a) for a, m in size.items()))[:5]
    assert [(-r.magnitude, r.node) for r in casc.itertuples()] == want
    two = edges.merge(edges, left_on="dst", right_on="src").query("src_x != dst_y")
    two = two[[c not in after[a] for a, c in zip(two.src_x, two.dst_y)]]
    two["s"] = -(two.weight_x * two.weight_y).round(6)
    assert chain[["a", "b", "c"]].to_numpy().tolist() == two.sort_values(["s", "src_x", "dst_x", "dst_y"])[["src_x", "dst_x", "dst_y"]].head(20).to_numpy().tolist()
    assert links == 2 * len(edges)
    assert rows1 < 400_000 and rows2 < 400_000  # there are 600 * 60 * 60 paths
    assert rows3 < 1.5 * len(edges)


def test_top_chains_without_enough_or_with_negative_weights(spark):
    e = spark.createDataFrame([(1, 2, -3.0), (2, 3, -4.0), (2, 4, 1.0), (5, 2, 2.0), (7, 8, None), (8, 9, 1.0)], "src long, dst long, weight double")
    assert [tuple(r) for r in graph.chains(e, 100).collect()] == [tuple(r) for r in graph.chains(e).orderBy(F.desc("strength"), "a", "b", "c").collect()]
    assert [tuple(r) for r in graph.chains(e, 1).collect()] == [(1, 2, 3, 12.0)]


def test_aliases_spread_from_all_starts_together(spark):
    """100 names that match and are all aliases of each other: a node is reached once, not once from each."""
    pairs = spark.range(10_000).selectExpr("id div 100 as src", "id % 100 as dst").where("src < dst")
    ids = spark.range(100)
    mentions, claims, names = ids.selectExpr("id as doc", "id as entity"), ids.selectExpr("id as claim_id", "id as doc"), ids.selectExpr("id as entity", "'x' as name")
    got, rows = shuffled(spark, lambda: network.search_entity_alias(pairs, mentions, claims, names, "x").count())
    assert got == 100
    assert rows < 15_000  # the 9,900 ends of pairs once


def test_hubs_shuffle_counts_and_not_edges(spark):
    edges = spark.range(40_000).selectExpr("id % 200 as src", "case when id % 211 > 0 then 1000 + id % 211 end as dst")
    got, rows = shuffled(spark, lambda: [tuple(r) for r in graph.hubs(edges).collect()])
    each = edges.union(edges.select("dst", "src")).toPandas().groupby("src", dropna=False)["dst"]
    want = sorted(((-n, k) for k, n in each.size().items()), key=lambda x: (x[0], x[1] == x[1], x[1]))[:10]
    assert [(-d, k) for k, d, _ in got if k is not None] == [(d, k) for d, k in want if k == k]
    assert all(x == each.nunique().get(k, 200) for k, _, x in got if k is not None)
    assert rows < 25_000  # 40,000 edges are 80,000 distinct ends


def test_causal_pairs_shuffle_no_claims_that_name_their_entities(spark):
    c = spark.range(2000).selectExpr("id as claim_id", "concat('N', id % 9) as a", "concat('m', id % 4, 'x') as b", "id % 3 as k", "0.7D as trust")
    c = c.selectExpr("claim_id", "array(a, b, null, a) as entities", "case k when 0 then concat(a, ' causes ', b) when 1 then concat(b, ' due to ', a) else concat(a, ' and ', b) end as claim_text", "trust")
    named = c.selectExpr("claim_id", "explode(entities) as entity")
    got, rows = shuffled(spark, lambda: network.causal_pairs(c).collect())
    assert rows < 1000 and got == network.causal_pairs(c, named).collect()
    want = {(f"n{i % 9}", f"m{i % 4}x") for i in range(2000) if i % 3 < 2}
    assert {(r.cause, r.effect) for r in got} == want and sum(r.n_claims for r in got) == sum(i % 3 < 2 for i in range(2000))


def test_cooccurrence_shuffles_mentions_not_pairs(spark):
    # 300 documents of 40 entities of 3,000: 234,000 pairs, some of them often
    m = spark.range(300 * 40).selectExpr("id div 40 as doc", "if(id % 40 < 3, id % 40, pmod(xxhash64(id), 3000)) as entity")
    m = m.union(spark.createDataFrame([(1, None), (None, 2), (999, None)], "doc long, entity long"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, rows = shuffled(spark, lambda: graph.cooccurrence(m).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    docs, count, c = {}, {}, {}
    for doc, entity in {tuple(r) for r in m.collect()}:
        docs.setdefault(doc, set()).add(entity)
    for doc, es in docs.items():
        for x in es - {None}:
            if doc is not None:
                c[x] = c.get(x, 0) + 1
                for y in es - {None}:
                    if x < y:
                        count[x, y] = count.get((x, y), 0) + 1
    want = {(x, y): (k, round(k * 301 / (c[x] * c[y]), 6)) for (x, y), k in count.items() if k >= 3}
    assert {(r.e1, r.e2): (r.co, r.lift) for r in got} == want
    assert rows < 100_000


@pytest.fixture
def unbroadcast(spark):
    """Only what the code itself broadcasts after a count is."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _seeded(spark):
    """Edges among 300 nodes in two parts, one of them a star, and every 3rd node and one unlinked for seeds."""
    ring = spark.range(6_000).selectExpr("pmod(xxhash64(id), 150) as src", "pmod(xxhash64(id, 3), 150) as dst", "if(id % 3 = 0, null, 'CITES') as rel_type")
    star = spark.range(149).selectExpr("200 as src", "201 + id as dst", "'CITES' as rel_type")
    return ring.union(star).localCheckpoint(), spark.range(0, 360, 3).withColumnRenamed("id", "seed")


def test_subgraphs_of_seeds_are_shuffled_as_bits(spark, unbroadcast):
    e, seeds = _seeded(spark)
    edges = [tuple(r) for r in e.distinct().collect()]
    near = {}
    for a, b, _ in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = set()
    for r in seeds.collect():
        one = near.get(r.seed, set())
        ball = {r.seed} | one | {c for b in one for c in near[b]}
        want |= {(r.seed, *x) for x in edges if x[0] in ball and x[1] in ball}
    got, rows = shuffled(spark, lambda: [tuple(r) for r in network.citation_subgraph(e, seeds).collect()])
    assert len(got) == len(want) > 200_000 and set(got) == want
    assert rows < 60_000


def test_a_seed_with_enough_nodes_looks_no_farther(spark, unbroadcast):
    e, seeds = _seeded(spark)
    near = {}
    for a, b, _ in e.collect():
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for depth, most in ((2, 20), (2, 200), (3, 151), (1, 5)):
        want = set()
        for r in seeds.collect():
            far, last = {r.seed: 0}, {r.seed}
            for k in range(1, depth + 1):
                last = {c for b in last for c in near.get(b, ())} - far.keys()
                far |= dict.fromkeys(last, k)
            ranked = sorted((d, -len(near.get(v, ())), v) for v, d in far.items())[:most]
            want |= {(r.seed, v, d, -g) for d, g, v in ranked}
        got, rows = shuffled(spark, lambda: [tuple(r) for r in network.entity_graph(e, seeds, depth, most).collect()])
        assert len(got) == len(want) and set(got) == want
        if most == 20:
            assert rows < 40_000
