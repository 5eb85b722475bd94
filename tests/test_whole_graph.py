"""The graph queries' inputs are the whole tables: brute force on a small fixture."""

import pytest

from claimweave.plans.bindings import ring_edges
from claimweave.plans.registry import QUERIES

LINES = [(1, 1, 1, 10, "A"), (1, 2, 2, 20, "N"), (1, 3, 5, 30, "R"), (2, 1, 1, 5, "R"), (2, 2, 2, 5, "N"), (2, 3, 2, 5, "N"), (3, 1, 4, 7, "A"), (3, 2, 3, 7, "A"), (3, 3, 1, 7, "A")]
KINDS = {"A": "CITES", "N": "SUPPORTS", "R": "CONTRADICTS"}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(LINES, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity long, l_returnflag string").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(i, i % 3, -1.0 * i) for i in range(1, 6)], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{at}/supplier.parquet")
    spark.createDataFrame([(1, 7), (2, 8)], "c_custkey long, c_nationkey long").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{at}/orders.parquet")
    events = [(i, ["click", "view"][i % 2], i % 7, None, "x", 60.0) for i in range(40)]
    spark.createDataFrame(events, "event_id long, event_type string, user_id long, ts timestamp, props string, value double").write.parquet(f"{at}/events.parquet")
    return at


def brute_ring():
    edges = {}
    at = {(o, n): (s, f) for o, n, s, _, f in LINES}
    for (o, n), (src, flag) in at.items():
        dst = at.get((o, n + 1), (src, None))[0]
        if src != dst:
            k, kind = edges.get((src, dst), (0, ""))
            edges[src, dst] = (k + 1, max(kind, KINDS[flag]))
    return edges


def test_ring_has_every_edge(spark, small):
    assert {(r.src, r.dst): (r.weight, r.rel_type) for r in ring_edges(spark, small).collect()} == brute_ring()


def test_quality_report_counts_every_source(spark, small):
    got = {r.topic: (r.n, r.n_sources) for r in QUERIES["a5_quality_report"](spark, small).collect()}
    assert got == {"click": (20, 7), "view": (20, 7)}


def test_claim_evidence_averages_every_trust(spark, small):
    trust = {r.node: r.trust for r in QUERIES["g2_trust_propagation"](spark, small).collect()}
    assert min(trust.values()) <= 0.2
    rows = QUERIES["r25_claim_evidence"](spark, small).collect()
    assert {r.node for r in rows} == {b for (_, b), (_, k) in brute_ring().items() if k != "CITES"}
    for r in rows:
        for kind, n, mean in (("SUPPORTS", r.n_supporting, r.supporting_trust), ("CONTRADICTS", r.n_contradicting, r.contradicting_trust)):
            of = [trust[a] for (a, b), (_, k) in brute_ring().items() if b == r.node and k == kind]
            assert n == len(of) and (mean is None if not of else abs(mean - sum(of) / len(of)) < 1e-5)


def test_cartel_has_every_group(spark, small):
    assert {r.grp for r in QUERIES["d23_internal_cartel"](spark, small).collect()} == {0, 1, 2}


def test_personalized_trust_starts_from_every_line(spark, small):
    got = {(r.user_id, r.node) for r in QUERIES["g3_personalized_trust"](spark, small).collect()}
    assert {(7, s) for o, _, s, *_ in LINES if o < 3} | {(8, s) for o, _, s, *_ in LINES if o == 3} <= got
