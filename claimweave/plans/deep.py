"""Queries of what goes on in rounds until it settles, of pruned pairs and of counted sequences, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions.vector_index import near_pairs
from claimweave.operators import anomaly, centrality, citations, components, graph, manage, mining, modularity, network, suppression, trust
from claimweave.operators.detect import CONTACTS, CULTURES
from claimweave.plans.bindings import EVENTS, PLACES, RING, event_claims, places, ring_edges, table
from claimweave.plans.registry import _ECAT, EVENT_LEXICON, MISMATCH, _any, query

ROUNDS = 20


def _settled_sql(starts: str) -> str:
    """20 unrolled rounds from starts(run, node, t0): the first of each run that moved by less than 1e-6, else the last, scaled to its own range."""
    rounds = ",\n".join(
        f"r{k + 1} as materialized (select s.run, s.node, (1 - 0.85) * s.t0 + 0.85 * coalesce(i.f, 0) as t from starts s left join (select run, dst, sum(p * t) as f from p join r{k} on src = node group by 1, 2) i on i.run = s.run and i.dst = s.node)"
        for k in range(ROUNDS)
    )
    changes = " union all ".join(f"select {k} as k, a.run, sqrt(sum((a.t - b.t) * (a.t - b.t))) as change from r{k} a join r{k - 1} b on a.run = b.run and a.node = b.node group by 2" for k in range(1, ROUNDS + 1))
    all_ = " union all ".join(f"select {k} as k, * from r{k}" for k in range(1, ROUNDS + 1))
    return f"""with {RING}, te as (select src, dst, sum(case rel_type when 'CONTRADICTS' then -0.5 * weight when 'SUPPORTS' then weight else 0.5 * weight end) as w from ring group by 1, 2),
p as materialized (select src, dst, w / case when sum(w) over (partition by dst) = 0 then 1 else sum(w) over (partition by dst) end as p from te),
starts as materialized ({starts}),
r0 as materialized (select run, node, t0 as t from starts),
{rounds},
stop as (select run, coalesce(min(k) filter (change < 1e-6), {ROUNDS}) as k from ({changes}) group by 1),
ended as (select a.run, a.node, a.t, min(a.t) over (partition by a.run) as lo, max(a.t) over (partition by a.run) as hi from ({all_}) a join stop using (run, k))"""


NODES = "select s_suppkey as node, cast(s_suppkey % 10 as double) / 10 as t0, s_nationkey from supplier"


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey as node", "cast(s_suppkey % 10 as double) / 10 as t0")


@query("g2_trust_settled", _settled_sql(f"select 0 as run, node, case when node % 7 = 0 then 0.95 else t0 end as t0 from ({NODES})") + " select node, round(case when hi > lo then (t - lo) / (hi - lo) else 0 end, 6) as trust from ended")
def g2(spark, sf_dir):
    seeds = table(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0").selectExpr("s_suppkey as node", "0.95D as score")
    return trust.settled_trust(_nodes(spark, sf_dir), graph.trust_edges(ring_edges(spark, sf_dir)), seeds)


@query("g3_trust_by_user", _settled_sql(f"select r_regionkey as run, node, coalesce(case when n_regionkey = r_regionkey then 1 - t0 end, t0) as t0 from ({NODES}) join nation on n_nationkey = s_nationkey, region") + " select run as user_id, node, round(case when hi > lo then (t - lo) / (hi - lo) else 0 end, 6) as trust from ended")
def g3(spark, sf_dir):
    users = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).selectExpr("n_regionkey as user_id", "s_suppkey as node", "1 - cast(s_suppkey % 10 as double) / 10 as score")
    return trust.personal_trust(users, _nodes(spark, sf_dir), graph.trust_edges(ring_edges(spark, sf_dir)))


@query("g4_modularity_levels")
def g4(spark, sf_dir):
    return modularity.communities(ring_edges(spark, sf_dir))


@query("g10_influence_in_full")
def g10(spark, sf_dir):
    return centrality.influence(ring_edges(spark, sf_dir))


@query("r8_vector_index", "select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 5) as similarity from embeddings a join embeddings b on a.vec_id < b.vec_id where list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) >= 0.35")
def r8(spark, sf_dir):
    return near_pairs(table(spark, sf_dir, "embeddings"), "vec_id", 0.35, exact=True).withColumn("similarity", F.round("similarity", 5))


def _placed_claims(spark, sf_dir):
    """Claims of customers at their nation, and every third of them at another one, too; topic = region."""
    spots = places(spark, sf_dir).select("topic", "location", "lat", "lon")
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as claim_id", "c_nationkey", "concat(c_mktsegment, case when c_custkey % 11 = 0 then ' pyramid' when c_custkey % 7 = 0 then ' calendar' else ' fire' end, case when c_custkey % 5 = 0 then ' of Egypt' else '' end) as claim_text")
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_regionkey", "n_name")
    at = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("claim_id", "claim_text", "n_regionkey as topic", "n_name as location")
    at = at.union(at.where("claim_id % 3 = 0").join(n.selectExpr("n_regionkey as topic", "n_name"), "topic").where("n_name > location").groupBy("claim_id", "claim_text", "topic").agg(F.min("n_name").alias("location")))
    dates = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("claim_id")).agg(F.min("o_orderdate").alias("ts"))
    each = at.join(spots, ["topic", "location"]).groupBy("claim_id", "topic", "claim_text").agg(F.collect_list(F.struct(F.col("location").alias("name"), "lat", "lon")).alias("locations"))
    return each.join(dates, "claim_id", "left")


_CULTURE = lambda c: "case " + " ".join("when " + " or ".join(f"contains(lower({c}), '{w}')" for w in words) + f" then '{name}'" for name, words in CULTURES.items()) + " end"
_CONTACT = "case " + " ".join(f"when (x.culture = '{a}' and y.culture = '{b}') or (x.culture = '{b}' and y.culture = '{a}') then {v}" for (a, b), v in CONTACTS.items()) + " else 0.3 end"

ANOMALY = f"""{PLACES}, c as (select c_custkey as claim_id, c_nationkey, c_mktsegment || case when c_custkey % 11 = 0 then ' pyramid' when c_custkey % 7 = 0 then ' calendar' else ' fire' end || case when c_custkey % 5 = 0 then ' of Egypt' else '' end as claim_text, ts from customer left join (select o_custkey, min(o_orderdate) as ts from orders group by 1) on o_custkey = c_custkey),
at1 as (select claim_id, claim_text, ts, n_regionkey as topic, n_name as location from c join nation on n_nationkey = c_nationkey),
at2 as (select * from at1 union all select claim_id, claim_text, ts, topic, min(n_name) from at1 join nation on n_regionkey = topic and n_name > location where claim_id % 3 = 0 group by all),
said as (select *, {_CULTURE('claim_text')} as told, case when contains(claim_text, 'pyramid') then 0.8 when contains(claim_text, 'calendar') then 0.5 when contains(claim_text, 'fire') then 0.2 else 0 end as cx, row_number() over (partition by topic, location order by claim_id) as rk from at2),
unit as (select vec_id, list_transform(cast(embedding as double[]), lambda x: x / sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[])))) as e from embeddings),
spread as (select topic, location, unnest(range(1, len(e) + 1)) as i, unnest(e) as x from said join unit on vec_id = claim_id),
means as (select topic, location, i, avg(x) as m from spread group by 1, 2, 3),
spots as (select topic, location, count(*) as n, any_value(p.lat) as lat, any_value(p.lon) as lon, min(ts) as first_at, max(ts) as last_at, max(cx) as cx, coalesce({_CULTURE('location')}, arg_min(told, rk) filter (rk <= 3 and told is not null), 'unknown') as culture from said join places p using (topic, location) group by 1, 2),
signals as (select x.topic, x.location as location1, y.location as location2, 2 * 6371.0 * asin(sqrt(least(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2), 1.0))) * 0.621371 as miles,
 case when x.first_at is null or y.first_at is null then 0.5 when x.first_at <= y.last_at and y.first_at <= x.last_at then 0.8 else 0.3 end as temporal, 1 - {_CONTACT} as cultural, greatest(x.cx, y.cx) as complexity, (select sum(a.m * b.m) from means a join means b on a.i = b.i where a.topic = x.topic and b.topic = x.topic and a.location = x.location and b.location = y.location) as s
 from spots x join spots y on x.topic = y.topic and x.location < y.location),
rated as (select *, case when miles >= 5000 then least(0.7 + (miles - 5000) / 10000, 1.0) else miles / 5000 * 0.5 end as geographic, case when s is null then 0.5 when s >= 0.85 then 0.95 when s >= 0.75 then 0.8 when s >= 0.65 then 0.6 else s * 0.5 end as similarity from signals),
anomalies as (select topic, location1, location2, round(geographic, 6) as geographic, cast(temporal as double) as temporal, cast(cultural as double) as cultural, cast(complexity as double) as complexity, round(similarity, 6) as similarity, round(0.25 * geographic + 0.15 * temporal + 0.25 * cultural + 0.2 * complexity + 0.15 * similarity, 6) as pair_score from rated where 0.25 * geographic + 0.15 * temporal + 0.25 * cultural + 0.2 * complexity + 0.15 * similarity > 0.3)"""


@query("d37_five_signals", f"with {ANOMALY} select * from anomalies")
def d37(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "claim_id")
    return anomaly.anomalous_pairs(anomaly.place_summaries(_placed_claims(spark, sf_dir), vectors))


@query("d38_anomaly_report", f"""with {ANOMALY}, r as (select *, row_number() over (partition by topic order by pair_score desc, location1, location2) as rank from anomalies),
g as (select topic, count(*) as n_pairs, max(pair_score) filter (rank = 1) as top_score, max(pair_score) filter (rank = 2) as s2, sum(cast(pair_score as decimal(20, 6))) filter (rank > 2) as rest, max(location1) filter (rank = 1) as top_location1, max(location2) filter (rank = 1) as top_location2 from r group by 1),
h as (select *, round(case n_pairs when 1 then top_score when 2 then 0.6 * top_score + 0.4 * s2 else 0.5 * top_score + 0.3 * s2 + 0.2 * cast(rest as double) / (n_pairs - 2) end, 6) as score from g),
w as (select topic, location, min(rank * 2 + side) as spot from (select topic, location1 as location, 0 as side, rank from r union all select topic, location2, 1, rank from r) where rank <= 20 group by 1, 2),
f as (select said.topic, claim_id, min(spot * 1000 + rk) as at_ from said join w on w.topic = said.topic and w.location = said.location where rk <= 5 group by 1, 2),
k as (select *, row_number() over (partition by topic order by at_, claim_id) as n from f)
select h.topic, n_pairs, score, case when n_pairs >= 5 then 0.95 when n_pairs >= 3 then 0.85 when n_pairs = 2 then 0.75 else 0.6 end as confidence, case when score >= 0.8 then 'CRITICAL' when score >= 0.6 then 'HIGH' when score >= 0.4 then 'MODERATE' when score >= 0.2 then 'LOW' else 'MINIMAL' end as severity,
 top_location1, top_location2, top_score, (select string_agg(claim_id, ',' order by n) from k where k.topic = h.topic and n <= 100) as sample_claims from h""")
def d38(spark, sf_dir):
    claims = _placed_claims(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "claim_id")
    out = anomaly.anomaly_report(anomaly.anomalous_pairs(anomaly.place_summaries(claims, vectors)), claims)
    return out.withColumn("sample_claims", F.array_join(F.col("sample_claims").cast("array<string>"), ","))


# Entities are nations of customers and of suppliers, and days of orders: one document is one order.
_SEEN = "seen as (select distinct l_orderkey as doc, l_suppkey % 40 as entity from lineitem union select o_orderkey, 100 + o_custkey % 15 from orders)"


@query("g7_correlations", f"""with {_SEEN}, c as (select entity, count(*) as c from seen group by 1 having count(*) >= 3),
p as (select a.entity as e1, b.entity as e2, count(*) as co from seen a join seen b on a.doc = b.doc and a.entity < b.entity group by 1, 2),
f as (select e1, e2, co, a.c as c1, b.c as c2, (select count(distinct doc) from seen) as n from p join c a on a.entity = e1 join c b on b.entity = e2 where co >= 3 and co >= 0.08 * least(a.c, b.c)),
g as (select *, c1 * c2 / n as expected from f), h as (select *, case when expected < 5 then 0.1 else least(1.0, power(co - expected, 2) / expected / 20) end as sure from g)
select e1, e2, co, c1, c2, round(co / c1, 6) as conf12, round(co / c2, 6) as conf21, round(co * n / (c1 * c2), 6) as lift, round(sure, 6) as significance from h where sure > 0.05 order by lift desc, co desc, e1, e2 limit 500""")
def g7(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "l_suppkey % 40 as entity").union(table(spark, sf_dir, "orders").selectExpr("o_orderkey", "100 + o_custkey % 15"))
    return mining.correlations(seen, min_conf=0.08, over=0.05)


@query("g9_sequences", """with d as (select distinct o_custkey as entity, o_orderkey as doc, cast(o_orderdate as date) as day from orders),
c as (select entity, count(*) as c from d group by 1),
one as (select x.entity as e1, y.entity as e2, count(distinct x.doc) as count1, count(distinct y.doc) as count2 from d x join d y on x.entity <> y.entity and y.day - x.day between 1 and 90 group by 1, 2)
select e1, e2, count1, count2, c as c1, round(count1 / c, 6) as share from one join c on entity = e1 where count1 >= 3 and count2 >= 3 and c >= 3 and (select c from c k where k.entity = e2) >= 3 and count1 >= 0.6 * c order by share desc, count1 desc, e1, e2 limit 50""")
def g9(spark, sf_dir):
    return mining.sequences(table(spark, sf_dir, "orders").selectExpr("o_custkey as entity", "o_orderkey as doc", "cast(o_orderdate as date) as day"))


@query("a5_assessments", f"""with {EVENTS}, asked as (select topic from claims union select 'absent topic'),
b as (select asked.topic, count(claim_id) as total_claims, count(*) filter (claim_type = 'PRIMARY') as primary_claims, count(*) filter (claim_type = 'META') as meta_claims, count(*) filter (claim_type = 'SECONDARY') as secondary_claims, count(*) filter (claim_type = 'CONTEXTUAL') as contextual_claims, count(distinct source) as n_sources, count(*) filter (intense) as n_dated, count(*) filter (claim_id % 97 = 0) as n_located from asked left join claims using (topic) group by 1),
s as (select *, total_claims >= 10 and (primary_claims >= 5 or total_claims >= 20) as suppression_sufficient, n_sources >= 3 and total_claims >= 10 as coordination_sufficient, n_located >= 2 and total_claims >= 10 as anomaly_sufficient from b)
select *, case when total_claims = 0 then 'no_claims' else concat_ws(',', case when total_claims < 10 then 'few_claims' end, case when primary_claims < 10 then 'few_primary' end, case when meta_claims = 0 then 'no_meta' when meta_claims < 5 then 'few_meta' end, case when n_sources = 1 then 'one_source' when n_sources < 3 then 'few_sources' end) end as suppression_warnings,
 case when total_claims = 0 then 'no_claims' else concat_ws(',', case when n_sources < 3 then 'few_sources' end, case when n_dated < total_claims * 0.3 then 'few_dated' end) end as coordination_warnings,
 case when total_claims = 0 then 'no_claims' else concat_ws(',', case when n_located < 2 then 'few_located' end) end as anomaly_warnings, suppression_sufficient and coordination_sufficient and anomaly_sufficient as sufficient from s""")
def a5(spark, sf_dir):
    claims = event_claims(spark, sf_dir).selectExpr("topic", "claim_type", "source", "intense as dated", "claim_id % 97 = 0 as located")
    out = manage.assess(claims, spark.sql("select 'absent topic' as topic"))
    return out.withColumns({f"{k}_warnings": F.array_join(f"{k}_warnings", ",") for k in ("suppression", "coordination", "anomaly")})


@query("a6_exclude_restore", f"""with {EVENTS} select claim_id, (excluded or claim_id in (select vec_id from embeddings)) and claim_id not in (select item_id from benchmark) as excluded, case when claim_id in (select vec_id from embeddings) then timestamp '2020-01-01' end as excluded_at, case when claim_id in (select item_id from benchmark) then timestamp '2020-01-02' end as restored_at from claims""")
def a6(spark, sf_dir):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    out = manage.exclude(event_claims(spark, sf_dir).withColumns({"excluded_at": at(None), "restored_at": at(None)}), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("claim_id")), at("2020-01-01"))
    return manage.restore(out, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id")), at("2020-01-02")).select("claim_id", "excluded", "excluded_at", "restored_at")


@query("a7_delete_cascade", """with cl as (select doc_id as claim_id, source as source_file from documents), ch as (select doc_id // 3 as chunk_id, max(source) as source_file from documents group by 1), cc as (select doc_id // 3 as chunk_id, doc_id as claim_id from documents),
ab as (select distinct source as doc, lang as topic from documents), tp as (select distinct lang as topic from documents union select 'x'), g as (select claim_id from cl where contains(source_file, 'src1')),
lc as (select * from cc where claim_id not in (select claim_id from g)), la as (select * from ab where not contains(doc, 'src1')), dead as (select topic from tp where topic not in (select topic from la where topic is not null))
select 'claims' as what, (select count(*) from g) as n union all select 'chunks', (select count(*) from ch where contains(source_file, 'src1') and chunk_id not in (select chunk_id from lc)) union all select 'embeddings', (select count(*) from embeddings where vec_id in (select claim_id from g))
union all select 'topic_relationships', (select count(*) from ab where contains(doc, 'src1')) union all select 'orphaned_topics', (select count(*) from dead) union all select 'topic_embeddings', (select count(*) from dead)""")
def a7(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    topics = d.selectExpr("lang as topic").union(spark.sql("select 'x' as topic")).distinct()
    return manage.delete_source({
        "claims": d.selectExpr("doc_id as claim_id", "source as source_file"), "chunks": d.groupBy(F.expr("doc_id div 3").alias("chunk_id")).agg(F.max("source").alias("source_file")), "contains_claim": d.selectExpr("doc_id div 3 as chunk_id", "doc_id as claim_id"),
        "documents": d.selectExpr("source as doc", "source as source_file").distinct(), "about": d.selectExpr("source as doc", "lang as topic").distinct(), "topics": topics, "claim_vectors": table(spark, sf_dir, "embeddings").selectExpr("vec_id as claim_id"), "topic_vectors": topics,
    }, "src1")[1]


def _order_parts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as claim_id", "l_partkey as entity")


@query("t27_entity_reach", "with m as (select distinct l_orderkey as claim_id, l_partkey as entity from lineitem) select a.claim_id, count(distinct b.claim_id) - 1 as n_partners from m a join m b using (entity) group by 1")
def t27r(spark, sf_dir):
    return citations.entity_reach(_order_parts(spark, sf_dir))


@query("t27_citation_stats", """with c as (select o_orderkey as claim_id, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k from orders),
m as (select distinct l_orderkey as claim_id, l_partkey as entity from lineitem), n as (select claim_id, count(*) as c from m group by 1),
p as (select b.claim_id as src, a.claim_id as dst, count(*) as co from m a join m b using (entity) where a.claim_id < b.claim_id group by 1, 2),
e as (select a.claim_id as src, b.claim_id as dst, 'in_document' as kind from c a join c b on a.o_custkey = b.o_custkey and b.k between a.k - 5 and a.k - 1
 union all select src, dst, 'shared_entities' from p join n x on x.claim_id = src join n y on y.claim_id = dst where co >= 2 and co >= 0.3 * least(x.c, y.c) and least(x.c, y.c) >= 2),
g as (select kind, src, count(*) as n from e group by 1, 2), h as (select src, sum(n) as n from g group by 1)
select kind, cast(sum(n) as bigint) as total, round(avg(n), 6) as avg_per_claim, max(n) as max_per_claim from g group by 1 union all select null, cast(sum(n) as bigint), round(avg(n), 6), cast(max(n) as bigint) from h""")
def t27s(spark, sf_dir):
    claims = table(spark, sf_dir, "orders").selectExpr("o_orderkey as claim_id", "o_custkey", "o_orderdate")
    return citations.citation_stats(citations.citation_network(claims, _order_parts(spark, sf_dir), "o_custkey", "o_orderdate", share=0.3))


_STEPS = 16  #: rounds in SQL: more than any two nodes of the test tables lie apart


@query("g12_components", "with u as materialized (select distinct l_orderkey as a, -1 - l_partkey as b from lineitem), e as materialized (select a, b from u union all select b, a from u), r0 as (select distinct a as node, a as root from e), " + ", ".join(f"r{k + 1} as materialized (select r.node, least(r.root, min(s.root)) as root from r{k} r join e on e.a = r.node join r{k} s on s.node = e.b group by r.node, r.root)" for k in range(_STEPS)) + f" select node, root as component from r{_STEPS}")
def g12(spark, sf_dir):
    return components.components(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as u", "-1 - l_partkey as v"))


@query("r6_alias_two_hops", "with s as (select distinct a.l_suppkey as src, b.l_suppkey as dst from lineitem a join lineitem b on a.l_partkey = b.l_partkey and a.l_suppkey < b.l_suppkey where a.l_orderkey < b.l_orderkey), u as (select src, dst from s union select dst, src from s), h0 as (select s_suppkey as n from supplier where contains(lower(s_name), '00001')), h1 as (select n from h0 union select dst from u join h0 on n = src), h2 as (select n from h1 union select dst from u join h1 on n = src) select l_orderkey as claim_id, count(distinct l_suppkey) as n_entities from lineitem join h2 on n = l_suppkey group by 1")
def r6(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    x, y = l.select("l_partkey", "l_orderkey", F.col("l_suppkey").alias("src")), l.select("l_partkey", F.col("l_orderkey").alias("later"), F.col("l_suppkey").alias("dst"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number, as few bytes give many pairs
    same = x.repartition(n, "l_partkey").join(y.repartition(n, "l_partkey"), "l_partkey").where("src < dst and l_orderkey < later").select("src", "dst").distinct()
    mentions = l.selectExpr("l_orderkey as doc", "l_suppkey as entity")
    return network.search_entity_alias(same, mentions, l.selectExpr("l_orderkey as claim_id", "l_orderkey as doc").distinct(), table(spark, sf_dir, "supplier").selectExpr("s_suppkey as entity", "s_name as name"), "00001", hops=2)


_PROFILE = {"signal_weights": {"narrative": 4, "meta_density": 2, "isolation": 1, "avoidance": 2, "mismatch": 1}, "score_levels": {"critical": 0.7, "high": 0.5}, "scoring": {"mode": "linear"}}


@query("d12_suppression_report", f"""with {EVENTS.replace('from events)', 'from events where event_id % 10 <> 7)')},
b as (select topic, count(*) as n, coalesce(least(1.5 * count(*) filter (claim_type = 'META') / nullif(count(*) filter (claim_type in ('META', 'PRIMARY')), 0), 0.8), 0.0) as meta_density,
 0.5 * (1 - avg(cast(n_citations > 0 as int))) as isolation, coalesce(count(*) filter (claim_type = 'META' and n_citations = 0) / nullif(count(*) filter (claim_type = 'META'), 0), 0.0) as avoidance,
 least(2 * avg(cast({_any("lower(claim_text)", MISMATCH)} as int)), 0.8) as mismatch, count(*) filter ({_ECAT} is not null) as k from claims group by 1),
g as (select topic, n, k, round(meta_density, 6) as meta_density, round(isolation, 6) as isolation, round(avoidance, 6) as avoidance, round(mismatch, 6) as mismatch, round(cast(least(k * 0.1, 0.95) as double), 6) as narrative from b),
u as (select *, round((0.4 * narrative + 0.2 * meta_density + 0.1 * isolation + 0.2 * avoidance + case when mismatch > 0 then 0.1 * mismatch else 0 end) / case when mismatch > 0 then 1.0 else 0.9 end, 6) as score from g),
i as (select topic, claim_id, {_ECAT} as category from claims where {_ECAT} is not null),
s as (select topic, string_agg(claim_id || ' ' || category, ',' order by claim_id) as sample from (select *, row_number() over (partition by topic order by claim_id) as rk from i) where rk <= 20 group by 1),
c as (select topic, string_agg(category || ' ' || n, ',' order by category) as cats from (select topic, category, count(*) as n from i group by 1, 2) group by 1),
p as (select topic, string_agg(signal || ' ' || x, ',' order by x desc, signal) as parts from (select *, row_number() over (partition by topic order by x desc, signal) as rk from (
 select topic, 'narrative' as signal, cast(round(400000 * narrative) as bigint) as x from u union all select topic, 'meta_density', cast(round(200000 * meta_density) as bigint) from u union all select topic, 'isolation', cast(round(100000 * isolation) as bigint) from u union all select topic, 'avoidance', cast(round(200000 * avoidance) as bigint) from u union all select topic, 'mismatch', cast(round(100000 * mismatch) as bigint) from u) where x > 0) where rk <= 2 group by 1)
select u.topic, n, k as n_indicators, narrative, meta_density, isolation, avoidance, mismatch, score,
 case when score >= 0.7 then 'CRITICAL' when score >= 0.5 then 'HIGH' when score >= 0.35 then 'MODERATE' when score >= 0.15 then 'LOW' else 'MINIMAL' end as level, cats as categories, parts as contributions, sample as sample_claims from u left join s using (topic) left join c using (topic) left join p using (topic)""")
def d12(spark, sf_dir):
    out = suppression.report(event_claims(spark, sf_dir), EVENT_LEXICON, MISMATCH, _PROFILE).drop("confidence")
    text = lambda of: F.array_join(F.expr(of), ",")
    return out.withColumns({
        "categories": F.when(F.col("categories").isNotNull(), text("transform(map_entries(categories), x -> concat(x.key, ' ', x.value))")), "contributions": text("transform(contributions, x -> concat(x.signal, ' ', cast(round(x.contribution * 1000000) as bigint)))"),
        "sample_claims": F.when(F.col("sample_claims").isNotNull(), text("transform(sample_claims, x -> concat(x.claim_id, ' ', x.category))")),
    })
