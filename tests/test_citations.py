"""Citations by shared entities, reach without pairs, figures."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from claimweave.operators import citations


def some(seed):
    rng = random.Random(seed)
    rows = [(c, rng.choice("abcdefghij")) for c in range(-70, 70) for _ in range(rng.randint(0, 6))]
    return rows + [(c, "hub") for c in range(-70, 70, 2)] + rows[:9] + [(None, "a"), (1, None)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_entity_citations_and_reach(spark, kind):
    as_id = int if kind == "long" else str
    rows = [(None if c is None else as_id(c), e) for c, e in some(1)]
    df = spark.createDataFrame(rows, f"claim_id {kind}, entity string").repartition(3)
    of = {}
    for c, e in rows:
        if c is not None and e is not None:
            of.setdefault(c, set()).add(e)
    shared = {(b, a): len(of[a] & of[b]) for a, b in combinations(sorted(of), 2)}
    for least, share in ((2, 0.5), (1, 0.2), (3, 1.0)):
        got = {(r.src, r.dst): r.n_shared for r in citations.entity_citations(df, least, share).collect()}
        small = lambda p: min(len(of[p[0]]), len(of[p[1]]))
        assert got == {p: n for p, n in shared.items() if n >= least and small(p) >= least and n >= share * small(p) - 1e-9}
    partners = Counter()
    for (a, b), n in shared.items():
        partners[a] += n > 0
        partners[b] += n > 0
    assert {r.claim_id: r.n_partners for r in citations.entity_reach(df).collect()} == {c: partners[c] for c in of}


def test_reach_of_a_hub(spark):
    hub = spark.range(50_000).selectExpr("id as claim_id", "'hub' as entity").union(spark.range(10).selectExpr("id", "'few'"))
    got = citations.entity_reach(hub).agg(F.min("n_partners"), F.max("n_partners"), F.count("*")).first()
    assert tuple(got) == (49_999, 49_999, 50_000)


def test_network_and_its_figures(spark):
    claims = spark.createDataFrame([(1, "d", 1), (2, "d", 2), (3, "d", 3), (4, "e", 1)], "claim_id long, doc string, seq int")
    mentions = spark.createDataFrame([(1, "x"), (1, "y"), (4, "x"), (4, "y"), (3, "x")], "claim_id long, entity string")
    edges = citations.citation_network(claims, mentions, "doc", "seq")
    assert sorted(map(tuple, edges.collect())) == [(2, 1, "in_document"), (3, 1, "in_document"), (3, 2, "in_document"), (4, 1, "shared_entities")]
    assert {r.kind: (r.total, r.avg_per_claim, r.max_per_claim) for r in citations.citation_stats(edges).collect()} == {"in_document": (3, 1.5, 2), "shared_entities": (1, 1.0, 1), None: (4, 1.333333, 2)}
    assert [tuple(r) for r in citations.citation_stats(edges.limit(0)).collect()] == [(None, 0, None, None)]
