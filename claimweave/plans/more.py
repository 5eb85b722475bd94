"""Further queries and their SQL twins: topic traversal, evidence, result summaries and viewer data."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.operators import curate, detect, evidence, graph
from claimweave.plans.bindings import EDGES, EVENTS, RING, event_claims, part_edges, ring_edges, table
from claimweave.plans.registry import CASCADES, DOC_CLAIMS, TRUST, _any, _doc_claims, _trust, query

# Words that occur in the test tables.
DISMISSAL = ["purchase", "42"]
KINDS = ["META", "PRIMARY", "SECONDARY", "CONTEXTUAL"]
PROFILES = [("metal", ["bolt"]), ("jewel", ["ring"]), ("plain", ["small"])]
LEVELS = [(0.9, ["purchase"]), (0.6, ["click"]), (0.3, ["view"])]
NEGATIONS = [" not ", " no ", " der ", " the "]
ANTI, PRO = ["purchase", "7"], ["click", "view"]

ABOUT = "about as (select c_custkey as source, c_mktsegment as topic from customer)"


def _about(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as source", "c_mktsegment as topic")


@query("r2_search_any_word", f"with {DOC_CLAIMS} select claim_id, doc_id from claims where {_any('lower(claim_text)', ['licensed', 'worthless', 'stupid'])}")
def r2(spark, sf_dir):
    return evidence.search_any_word(_doc_claims(spark, sf_dir), ["a", "Licensed", "the", "worthless", "stupid"]).select("claim_id", "doc_id")


@query("r10_claims_via_topics", f"with {EVENTS}, {ABOUT} select claim_id, source, confidence from claims where source in (select source from about where topic in ('BUILDING', 'MACHINERY')) and ts is not null")
def r10(spark, sf_dir):
    return evidence.claims_via_topics(event_claims(spark, sf_dir), _about(spark, sf_dir), ["BUILDING", "MACHINERY"], True).select("claim_id", "source", "confidence")


@query("r11_claims_via_topics_hybrid", f"with {EVENTS}, {ABOUT} select claim_id, source from claims where source in (select source from about where topic = 'BUILDING') and regexp_matches(lower(claim_text), '\\b(click|purchase)\\b')")
def r11(spark, sf_dir):
    return evidence.claims_via_topics_hybrid(event_claims(spark, sf_dir), _about(spark, sf_dir), ["BUILDING"], "the purchase or click", ["the"]).select("claim_id", "source")


@query("r12_topics_all_words", "select p_partkey, p_name from part where contains(replace(lower(p_name), '-', ' '), 'ring') and contains(replace(lower(p_name), '-', ' '), 'small')")
def r12(spark, sf_dir):
    return evidence.topics_all_words(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "Small-of RING")


@query("r15_context_stats", f"""with {EVENTS}, b as (select topic, count(*) as n, round(avg(confidence), 6) as avg_trust, count(*) filter (source % 2 = 0) as n_mainstream, count(*) filter (source % 2 <> 0) as n_alternative,
 avg(case when claim_type = 'META' and {_any('lower(claim_text)', DISMISSAL)} then 1 else 0 end) as s from claims group by 1)
select topic, n, avg_trust, n_mainstream, n_alternative, round(s, 6) as dismissal_share, case when s > 0.3 then 'high' when s > 0.1 then 'moderate' else 'none' end as label from b""")
def r15(spark, sf_dir):
    return evidence.context_stats(event_claims(spark, sf_dir), ["topic"], DISMISSAL, F.expr("source % 2 = 0"))


@query("r16_search_confidence", f"with {EVENTS} select topic, source, round(0.3 * least(count(*) / cast(20 as double), 1.0) + 0.5 * (cast(sum(cast(confidence as decimal(20, 6))) as double) / count(confidence)) + 0.2 * least(count(distinct claim_type) / cast(5 as double), 1.0), 6) as search_confidence from claims group by 1, 2")
def r16(spark, sf_dir):
    return evidence.search_confidence(event_claims(spark, sf_dir), ["topic", "source"], "claim_type")


@query("r17_top_sources", f"with {EVENTS}, r as (select *, row_number() over (partition by source order by confidence desc, claim_id) as rk from claims) select source, claim_id, confidence, substr(claim_text, 1, 100) as excerpt from r where rk = 1 order by confidence desc, claim_id limit 5")
def r17(spark, sf_dir):
    return evidence.top_sources(event_claims(spark, sf_dir), "source")


@query("r20_claim_context", f"""with {RING}, c as (select distinct src, dst from ring where rel_type = 'CITES'), a as (select src as node, count(*) as k, string_agg(cast(dst as varchar), ',' order by dst) as l from c group by 1), b as (select dst as node, count(*) as k, string_agg(cast(src as varchar), ',' order by src) as l from c group by 1)
select s_suppkey as node, coalesce(a.l, '') as cites, coalesce(b.l, '') as cited_by, cast(coalesce(a.k, 0) as integer) as n_cites, cast(coalesce(b.k, 0) as integer) as n_cited_by from supplier left join a on a.node = s_suppkey left join b on b.node = s_suppkey""")
def r20(spark, sf_dir):
    got = evidence.claim_context(table(spark, sf_dir, "supplier").selectExpr("s_suppkey as node"), ring_edges(spark, sf_dir))
    return got.withColumn("cites", F.array_join("cites", ",")).withColumn("cited_by", F.array_join("cited_by", ","))


@query("r25_claim_evidence", f"""with {TRUST}, known as (select node, trust from trust)
select dst as node, count(*) filter (rel_type = 'SUPPORTS') as n_supporting, count(*) filter (rel_type = 'CONTRADICTS') as n_contradicting, round(avg(coalesce(k.trust, 0.5)) filter (rel_type = 'SUPPORTS'), 6) as supporting_trust, round(avg(coalesce(k.trust, 0.5)) filter (rel_type = 'CONTRADICTS'), 6) as contradicting_trust
from ring left join known k on k.node = src where rel_type in ('SUPPORTS', 'CONTRADICTS') group by 1""")
def r25(spark, sf_dir):
    return evidence.claim_evidence(ring_edges(spark, sf_dir), _trust(spark, sf_dir))


@query("a3_claim_type_counts", f"with {EVENTS} select topic, " + ", ".join(f"count(*) filter (claim_type = '{k}') as n_{k.lower()}" for k in KINDS) + " from claims group by 1")
def a3(spark, sf_dir):
    return evidence.claim_type_counts(event_claims(spark, sf_dir), KINDS)


@query("a4_system_status", f"with {EVENTS}, b as (select count(*) as n_claims, count(*) filter (n_citations > 0) as n_cited, count(ts) as n_dated, (select count(*) from embeddings) as n_vectors from claims) select *, n_claims >= 1 and n_cited >= 1 as suppression_ready, n_dated >= 1 and n_vectors >= 1 as coordination_ready from b")
def a4(spark, sf_dir):
    return evidence.system_status(event_claims(spark, sf_dir), table(spark, sf_dir, "embeddings"))


@query("a9_recommend_profile", "select p_partkey, case " + " ".join(f"when {_any('lower(p_name)', w)} then '{k}'" for k, w in PROFILES) + " else 'default' end as profile, cast(case when " + " or ".join(_any("lower(p_name)", w) for _, w in PROFILES) + " then 0.7 else 0.5 end as double) as profile_confidence from part")
def a9(spark, sf_dir):
    return evidence.recommend_profile(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", PROFILES).drop("p_name")


@query("a10_validate_profiles", """with w as (select l_orderkey as name, l_linenumber as k, max(cast(l_discount as double)) * 5 as x from lineitem group by 1, 2), s as (select name, sum(x) as t, max(x) as m from w group by 1)
select name, round(t, 6) as weight_sum, round(case when t <> 0 then m / t end, 6) as top_weight, case when abs(t - 1) > 0.013 then 'weight_sum' else '' end as errors from s""")
def a10(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("name"), "l_linenumber").agg((F.max(F.col("l_discount").cast("double")) * 5).alias("x"))
    profiles = w.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_linenumber", "x")))).alias("signal_weights"))
    return evidence.validate_profiles(profiles, 0.013)


@query("t25_synthesize_claims", f"""with {RING}, d as (select src, count(*) as degree from ring group by 1 having count(*) >= 3 order by degree desc, src limit 100), r as (select ring.*, cast(row_number() over (partition by src order by weight desc, dst) as integer) as rank from ring where weight > 1 and src in (select src from d))
select src, dst, rank, src || ' ' || lower(rel_type) || ' ' || dst as claim_text from r where rank <= 5""")
def t25(spark, sf_dir):
    return evidence.synthesize_claims(ring_edges(spark, sf_dir))


@query("t26_seed_sources", "select source, count(*) as n_documents, cast(0.5 as double) as initial_trust from documents where source is not null group by 1 having count(*) > 1 order by n_documents desc, source limit 20")
def t26(spark, sf_dir):
    return evidence.seed_sources(table(spark, sf_dir, "documents"), "source")


@query("t27_build_citations", "with c as (select o_orderkey as claim_id, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k from orders) select a.claim_id as src, b.claim_id as dst from c a join c b on a.o_custkey = b.o_custkey and b.k between a.k - 5 and a.k - 1")
def t27(spark, sf_dir):
    return evidence.build_citations(table(spark, sf_dir, "orders").selectExpr("o_orderkey as claim_id", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate")


@query("d3_negated", f"""with {DOC_CLAIMS}, p as (select claim_id, lower(claim_text) as t, strpos(lower(claim_text), 'licensed') as spot from claims), b as (select *, substr(t, greatest(spot - 50, 1), spot - greatest(spot - 50, 1)) as b from p where spot > 0)
select claim_id, {_any('b', NEGATIONS)} as negated from b""")
def d3(spark, sf_dir):
    c = _doc_claims(spark, sf_dir).withColumn("t", F.lower("claim_text")).where("contains(t, 'licensed')")
    return c.select("claim_id", detect.negated(F.col("t"), "licensed", NEGATIONS).alias("negated"))


@query("d4_topic_in_claim", f"with {EVENTS} select claim_id, contains(lower(claim_text), lower(topic)) or (length(topic) >= 4 and contains(lower(claim_text), lower(topic))) as on_topic from claims")
def d4(spark, sf_dir):
    return event_claims(spark, sf_dir).select("claim_id", detect.topic_in_claim(F.col("claim_text"), F.col("topic")).alias("on_topic"))


@query("d5_pattern_near_topic", f"""with {DOC_CLAIMS}, p as (select claim_id, lower(claim_text) as t, strpos(lower(claim_text), 'licensed') as a, strpos(lower(claim_text), 'the') as b from claims)
select claim_id, cast(len(string_split(substr(t, least(a, b), greatest(a, b) - least(a, b)), ' ')) - 1 as integer) as gap from p where a > 0 and b > 0""")
def d5(spark, sf_dir):
    c = _doc_claims(spark, sf_dir).select("claim_id", detect.words_between(F.lower("claim_text"), "licensed", "the").alias("gap"))
    return c.where("gap is not null")


@query("d14_service_score", f"""with {EVENTS}, b as (select topic, least(2 * cast(count(*) filter (claim_type = 'META') as double) / count(*), 1.0) as density, avg(case when n_citations = 0 then 1 else 0 end) as uncited,
 coalesce(cast(count(*) filter (claim_type = 'META' and n_citations = 0) as double) / nullif(count(*) filter (claim_type = 'META'), 0), 0) as avoidance, least(cast(count(*) filter (claim_type = 'PRIMARY' and {_any('lower(claim_text)', DISMISSAL)}) as double) / 5, 1.0) as indicator from claims group by 1),
s as (select *, round(cast(0.15 as double) * density + cast(0.2 as double) * uncited + cast(0.2 as double) * avoidance + cast(0.45 as double) * indicator, 6) as score from b)
select topic, round(density, 6) as density, round(uncited, 6) as uncited, round(avoidance, 6) as avoidance, round(indicator, 6) as indicator, score, case when score >= 0.75 then 'CRITICAL' when score >= 0.55 then 'HIGH' when score >= 0.35 then 'MODERATE' when score >= 0.15 then 'LOW' else 'MINIMAL' end as level from s""")
def d14(spark, sf_dir):
    return detect.service_score(event_claims(spark, sf_dir), DISMISSAL)


@query("d23_internal_cartel", f"""with {RING}, g as (select s_suppkey as node, s_nationkey % 3 as grp from supplier), p as (select a.grp, src, count(*) filter (a.grp = b.grp) as i, count(*) filter (b.grp is null or a.grp <> b.grp) as o from ring join g a on a.node = src left join g b on b.node = dst group by 1, 2),
v as (select grp, coalesce(avg(i) filter (i > 0), 0) as a, coalesce(avg(o) filter (o > 0), 0) as b from p group by 1), r as (select *, coalesce(a / nullif(a + b, 0), 0) as ratio, a >= 5 and coalesce(a / nullif(a + b, 0), 0) > 0.7 as detected from v)
select grp, round(a, 6) as avg_internal, round(b, 6) as avg_external, round(ratio, 6) as ratio, detected, round(case when detected then ratio else ratio * 0.5 end, 6) as score from r""")
def d23(spark, sf_dir):
    groups = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as node", "s_nationkey % 3 as grp")
    return detect.internal_cartel(ring_edges(spark, sf_dir), groups)


@query("d35_pattern_complexity", f"with {EVENTS} select topic, source, cast(max(case " + " ".join(f"when {_any('lower(claim_text)', w)} then {x}" for x, w in LEVELS) + " else 0 end) as double) as complexity from claims group by 1, 2")
def d35(spark, sf_dir):
    return detect.pattern_complexity(event_claims(spark, sf_dir), ["topic", "source"], LEVELS)


@query("g3_personalized_trust", f"""with {TRUST}, u as (select c_nationkey as user_id, l_suppkey as node, cast(max(l_quantity) as double) / 50 as score from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey group by 1, 2),
z as (select user_id, s_suppkey as node, coalesce(score, (s_suppkey % 10) / 10.0) as t0 from (select distinct user_id from u) cross join supplier left join u using (user_id) where u.node = s_suppkey union all select user_id, s_suppkey, (s_suppkey % 10) / 10.0 from (select distinct user_id from u) x cross join supplier where not exists (select 1 from u where u.user_id = x.user_id and u.node = s_suppkey)),
z1 as (select z.user_id, z.node, z.t0, (1 - 0.85) * z.t0 + 0.85 * coalesce(i.f, 0) as t from z left join (select user_id, dst, sum(p * t0) as f from p join z on src = node group by 1, 2) i on i.dst = z.node and i.user_id = z.user_id),
z2 as (select z.user_id, z.node, (1 - 0.85) * z.t0 + 0.85 * coalesce(i.f, 0) as t from z left join (select user_id, dst, sum(p * t) as f from p join z1 on src = node group by 1, 2) i on i.dst = z.node and i.user_id = z.user_id),
h1 as (select user_id, node from u union select user_id, dst from u join p on src = node), h2 as (select user_id, node from h1 union select user_id, dst from h1 join p on src = node)
select user_id, node, round(t, 6) as trust from z2 join h2 using (user_id, node)""")
def g3(spark, sf_dir):
    c, o, x = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    got = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(x, F.col("l_orderkey") == F.col("o_orderkey"))
    users = got.groupBy(F.col("c_nationkey").alias("user_id"), F.col("l_suppkey").alias("node")).agg((F.max("l_quantity").cast("double") / 50).alias("score"))
    nodes = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as node", "(s_suppkey % 10) / 10.0D as t0")
    return graph.personalized_trust(users, nodes, graph.trust_edges(ring_edges(spark, sf_dir)))


@query("g6_network_size", f"with {EDGES} select 'node' as what, cast(s_nationkey as varchar) as name, count(*) as n from supplier group by 2 union all select 'edge', rel_type, count(*) from edges group by 2")
def g6(spark, sf_dir):
    return graph.network_size(table(spark, sf_dir, "supplier"), "s_nationkey", part_edges(spark, sf_dir))


NODES = "nodes as (select s.s_suppkey as node, s.s_nationkey as kind, s.s_suppkey % 3 as community, trust from supplier s join trust on node = s_suppkey)"


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey as node", "s_nationkey as kind", "s_suppkey % 3 as community").join(_trust(spark, sf_dir), "node")


@query("g15_unexpected_links", f"with {TRUST}, {NODES} select src, dst, rel_type, round(a.trust * b.trust, 6) as strength from ring join nodes a on a.node = src join nodes b on b.node = dst where rel_type in ('SUPPORTS', 'CONTRADICTS') and a.trust > 0.3 and b.trust > 0.3 and a.kind <> b.kind and a.community <> b.community order by strength desc, src, dst limit 30")
def g15(spark, sf_dir):
    return graph.unexpected_links(ring_edges(spark, sf_dir), _nodes(spark, sf_dir), 0.3)


@query("g16_pattern_links", f"""with {RING}, {CASCADES},
k as (select 'cascade' as kind, [cast(node as varchar)] as nodes from (select node from casc order by magnitude desc, node limit 20) union all select 'link', [cast(src as varchar), cast(dst as varchar)] from ring)
select distinct kind, md5(kind || '|' || array_to_string(nodes, '|')) as pattern_id, unnest(nodes) as node from k""")
def g16(spark, sf_dir):
    ring = ring_edges(spark, sf_dir)
    return graph.pattern_links(graph.pattern_store(cascade=(graph.cascades(ring), ["node"]), link=(ring, ["src", "dst"])))


@query("v1_filter_graph", f"with {TRUST}, b as (select node from trust where trust >= 0.2 order by node % 7 = 0 desc, trust desc, node limit 40) select src, dst, rel_type from ring where src in (select node from b) and dst in (select node from b)")
def v1(spark, sf_dir):
    nodes = _trust(spark, sf_dir).withColumn("detected", F.expr("node % 7 = 0"))
    return graph.filter_graph(nodes, ring_edges(spark, sf_dir), 0.2, 40).select("src", "dst", "rel_type")


@query("v3_timeline_scale", "with d as (select o_custkey, count(*) as n, date_diff('day', cast(min(o_orderdate) as date), cast(max(o_orderdate) as date)) as r from orders group by 1) select o_custkey, case when n < 2 then 'year' when r < 30 then 'day' when r < 180 then 'week' when r < 730 then 'month' when r < 3650 then 'year' when r < 36500 then 'decade' else 'century' end as unit from d")
def v3(spark, sf_dir):
    return graph.timeline_scale(table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderdate as ts"), ["o_custkey"])


@query("v5_stance", f"""with {EVENTS}, {RING}, c as (select claim_id, claim_id * 2 as node, lower(claim_text) as t from claims), f as (select src, bool_or(rel_type = 'CONTRADICTS') as a, bool_or(rel_type = 'SUPPORTS') as p from ring group by 1),
k as (select c.node, f.a, f.p, len([w for w in ['purchase', '7'] if contains(t, w)]) as na, len([w for w in ['click', 'view'] if contains(t, w)]) as np from c left join f on src = c.node)
select node, case when a then 'anti' when p then 'pro' when na > np then 'anti' when np > na then 'pro' else 'neutral' end as stance from k""")
def v5(spark, sf_dir):
    claims = event_claims(spark, sf_dir).selectExpr("claim_id * 2 as node", "claim_text")
    return graph.stance(claims, ring_edges(spark, sf_dir), ANTI, PRO)


@query("v6_related_timeline", f"with {RING}, e as (select src, dst from ring union select dst, src from ring), d as (select l_suppkey as node, cast(min(year(l_shipdate)) as integer) as year from lineitem group by 1) select src as node, dst as neighbour, coalesce(year, 0) as year, cast(row_number() over (partition by src order by coalesce(year, 0), dst) as integer) as place from e join d on d.node = dst")
def v6(spark, sf_dir):
    dated = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.year(F.min("l_shipdate")).alias("year"))
    return graph.related_timeline(ring_edges(spark, sf_dir), dated)


@query("r14_merge_results", f"""with {EVENTS}, a as (select claim_id, confidence as s1 from claims where contains(lower(claim_text), 'click')), b as (select vec_id as claim_id, cast(label as double) / 20 as s2 from embeddings)
select claim_id, greatest(s1, s2) as similarity, case when s1 is null then 'semantic' when s2 is null then 'graph' else 'both' end as found_by from a full join b using (claim_id)""")
def r14(spark, sf_dir):
    found = event_claims(spark, sf_dir).where("contains(lower(claim_text), 'click')").selectExpr("claim_id", "confidence as similarity")
    near = table(spark, sf_dir, "embeddings").selectExpr("vec_id as claim_id", "cast(label as double) / 20 as similarity")
    return curate.merge_results(found, near)


@query("t12_validate_claims", f"""with {EVENTS}, r as (select claim_id, claim_text, case when claim_id % 3 = 0 then null when claim_id % 3 = 1 then lower(claim_type) else 'other' end as claim_type, case when claim_id % 7 > 0 then confidence end as confidence from claims)
select claim_id, case when upper(claim_type) in ('META', 'PRIMARY', 'SECONDARY', 'CONTEXTUAL') then upper(claim_type) else 'PRIMARY' end as claim_type, coalesce(confidence, 0.5) as confidence from r where length(trim(claim_text)) >= 15 and coalesce(confidence, 0.5) >= 0.5""")
def t12(spark, sf_dir):
    raw = event_claims(spark, sf_dir).selectExpr("claim_id", "claim_text", "case when claim_id % 3 = 0 then null when claim_id % 3 = 1 then lower(claim_type) else 'other' end as claim_type", "case when claim_id % 7 > 0 then confidence end as confidence")
    return evidence.validate_claims(raw, KINDS, 15).drop("claim_text")
