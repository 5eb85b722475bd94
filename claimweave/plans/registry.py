"""Registered queries and their SQL twins; ids follow the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.vectors import vector_join
from claimweave.operators import curate, detect, graph, text
from claimweave.plans.bindings import CITES, EDGES, EVENTS, PLACES, RING, VECTORS, cites, claim_vectors, event_claims, part_edges, places, ring_edges, table
from claimweave.streaming.jobs import burst_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


# Lexicons of words that occur in the test tables.
LEXICON = [("dismissal", ["stupid", "worthless"], ["license"]), ("ridicule", ["idiot", "clown"], []), ("function", ["the ", " und "], ["scum"])]
EVENT_LEXICON = [("narrow", ["purchase"], ["1"]), ("wide", ["click", "view"], ["9", "77"])]
MISMATCH = ["5", "42"]
QUERY_WORDS = ["the", "licensed", "worthless"]


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any(col: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")" if words else "false"


def _doc_claims(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kinds = table(spark, sf_dir, "labels").selectExpr("doc_id", "case when toxic = 1 then 'META' when quality = 1 then 'PRIMARY' else 'SECONDARY' end as claim_type")
    s = text.sentences(docs.select("doc_id", "text", "source").join(kinds, "doc_id", "left"), keep=("source", "claim_type"))
    return s.select(text.hashed_id("claim_", F.col("doc_id").cast("string"), F.col("seq").cast("string")).alias("claim_id"), "doc_id", "seq", F.col("sentence").alias("claim_text"), F.col("source").alias("topic"), F.coalesce("claim_type", F.lit("CONTEXTUAL")).alias("claim_type"), ((F.length("sentence") % 100) / 100.0).alias("confidence"))


SENTENCES = """sentences as (select doc_id, cast(generate_subscripts(p, 1) - 1 as integer) as seq, trim(unnest(p)) as sentence from (select doc_id, regexp_split_to_array(text, '[.!?]+') as p from documents)),
s as (select * from sentences where length(sentence) >= 20)"""
DOC_CLAIMS = SENTENCES + """,
claims as (select 'claim_' || substr(md5(s.doc_id || '_' || seq), 1, 12) as claim_id, s.doc_id, seq, sentence as claim_text, source as topic,
  case when toxic = 1 then 'META' when quality = 1 then 'PRIMARY' when l.doc_id is not null then 'SECONDARY' else 'CONTEXTUAL' end as claim_type, cast(length(sentence) % 100 as double) / 100 as confidence
  from s join documents d on s.doc_id = d.doc_id left join labels l on s.doc_id = l.doc_id)"""


@query("t1_chunk_words", """
with w as (select doc_id, [x for x in regexp_split_to_array(text, '\\s+') if x <> ''] as ws from documents),
c as (select doc_id, ws, unnest(range(0, greatest(len(ws) - 50, 0) + 1, 800)) as i from w)
select doc_id, cast(i // 800 as integer) as seq, md5(array_to_string(ws[i + 1 : i + 1000], ' ')) as chunk_md5, least(len(ws) - i, 1000) as n_words from c where len(ws) - i >= 50""")
def t1(spark, sf_dir):
    return text.chunk_words(table(spark, sf_dir, "documents")).select("doc_id", "seq", F.md5("chunk").alias("chunk_md5"), F.size(F.split("chunk", " ")).cast("long").alias("n_words"))


@query("t3_sentence_ids", f"with {SENTENCES} select doc_id, count(*) as n, min('claim_' || substr(md5(doc_id || '_' || substr(sentence, 1, 100)), 1, 12)) as first_id from s group by 1")
def t3(spark, sf_dir):
    s = text.sentences(table(spark, sf_dir, "documents"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(text.hashed_id("claim_", F.col("doc_id").cast("string"), F.substring("sentence", 1, 100))).alias("first_id"))


@query("t8_indicator_claims", f"""with {SENTENCES}, f as (select *, row_number() over (partition by doc_id order by seq) as rn from s where length(sentence) <= 500 and {_any("lower(sentence)", QUERY_WORDS)})
select 'claim_' || substr(md5(doc_id || '_' || substr(sentence, 1, 100)), 1, 12) as claim_id, doc_id, seq, md5(sentence) as text_md5, cast(0.6 as double) as confidence from f where rn <= 30""")
def t8(spark, sf_dir):
    return text.indicator_claims(table(spark, sf_dir, "documents"), QUERY_WORDS).select("claim_id", "doc_id", "seq", F.md5("claim_text").alias("text_md5"), "confidence")


@query("t11_caps_entities", """
with r as (select doc_id, list_distinct_ordered as e from (select doc_id, list_filter(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g'), '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)\\b', 1), lambda x: x not in ('The', 'This', 'That', 'These', 'Those', 'They', 'It', 'He', 'She', 'We', 'You', 'I', 'A', 'An')) as l from documents) t,
  lateral (select list(x order by p) as list_distinct_ordered from (select x, min(p) as p from (select unnest(l) as x, generate_subscripts(l, 1) as p) group by x)) u)
select doc_id, cast(i - 1 as integer) as rank, k[i] as entity from (select doc_id, list_filter(e, lambda x: length(x) > 3)[1:20] as k from r), lateral (select unnest(range(1, len(k) + 1)) as i)""")
def t11(spark, sf_dir):
    plain = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^\\x00-\\x7F]", " ").alias("text"))
    return text.caps_entities(plain)


@query("t14_needs_coref", f"select doc_id, list_has_any(regexp_split_to_array(lower(text), '\\s+'), {_sql_list(text.PRONOUNS)}) as needs_coref from documents")
def t14(spark, sf_dir):
    return text.needs_coref(table(spark, sf_dir, "documents"))


@query("t5_section_date", "select o_orderkey, cast(o_orderdate as date) as filed from orders")
def t5(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Filed "), F.date_format("o_orderdate", "MMMM d, yyyy")).alias("note"))
    return o.select("o_orderkey", text.section_date("note").alias("filed"))


FEAR, ANGER, URGENCY = ["worthless", "scum"], ["stupid", "idiot", "the"], ["license", "der"]


@query("t16_emotion_scan", f"""
with h as (select doc_id, len([w for w in {_sql_list(FEAR)} if contains(lower(text), w)]) as n_fear, len([w for w in {_sql_list(ANGER)} if contains(lower(text), w)]) as n_anger, len([w for w in {_sql_list(URGENCY)} if contains(lower(text), w)]) as n_urgency from documents)
select doc_id, cast(n_fear as integer) as n_fear, cast(n_anger as integer) as n_anger, cast(n_urgency as integer) as n_urgency,
 case when n_fear > n_anger then 'fear' when n_anger > 0 then 'anger' else 'neutral' end as sentiment, n_fear + n_anger + n_urgency > 2 as loaded_language,
 round(least(1.0, (n_fear + n_anger + n_urgency) * cast(0.2 as double)), 6) as intensity from h""")
def t16(spark, sf_dir):
    return text.emotion_scan(table(spark, sf_dir, "documents"), "text", FEAR, ANGER, URGENCY).select("doc_id", "n_fear", "n_anger", "n_urgency", "sentiment", "loaded_language", "intensity")


@query("r1_search_text", f"with {DOC_CLAIMS} select claim_id, doc_id, confidence from claims where contains(lower(claim_text), 'licensed')")
def r1(spark, sf_dir):
    return curate.search_text(_doc_claims(spark, sf_dir), "licensed").select("claim_id", "doc_id", "confidence")


@query("r3_search_relevance", f"""with {DOC_CLAIMS}, r as (select claim_id, doc_id, seq, case when contains(lower(claim_text), 'the') then 1 else 0 end + case when contains(lower(claim_text), 'licensed') then 2 else 0 end + case when contains(lower(claim_text), 'worthless') then 2 else 0 end as relevance from claims where confidence >= 0.3)
select claim_id, doc_id, seq, relevance from r where relevance > 0""")
def r3(spark, sf_dir):
    return curate.search_relevance(_doc_claims(spark, sf_dir), QUERY_WORDS, 0.3).select("claim_id", "doc_id", "seq", "relevance")


@query("r5_claims_by_id", f"with {EVENTS} select claim_id, topic from claims where claim_id in (select conv_id from conversations)")
def r5(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("claim_id"))
    return curate.claims_by_id(event_claims(spark, sf_dir), ids).select("claim_id", "topic")


@query("r7_search_vector", """
with q as (select embedding as e from embeddings order by vec_id limit 1),
s as (select vec_id, list_cosine_similarity(cast(embedding as double[]), cast(e as double[])) as similarity from embeddings, q)
select vec_id, round(similarity, 5) as similarity from s where similarity >= 0.05 order by s.similarity desc, vec_id limit 20""")
def r7(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    probe = vecs.orderBy("vec_id").limit(1).collect()[0]["embedding"]  # the query: one vector
    return curate.search_vector(vecs, probe, 20, 0.05).select("vec_id", F.round("similarity", 5).alias("similarity"))


@query("r13_prioritized_sample", f"""with {EVENTS}, p as (select claim_id, topic, case when claim_type = 'META' then 2 else 0 end + case when contains(lower(claim_text), 'purchase') or contains(lower(claim_text), '42') then 3 else 0 end as priority from claims),
r as (select *, cast(row_number() over (partition by topic order by priority desc, md5(cast(claim_id as varchar))) as integer) as rank from p) select * from r where rank <= 50""")
def r13(spark, sf_dir):
    return curate.prioritized_sample(event_claims(spark, sf_dir), "topic", ["purchase", "42"], 50).select("claim_id", "topic", "priority", "rank")


@query("r18_list_claims", f"with {EVENTS} select claim_id, topic, total, total > 60 as has_more from (select claim_id, topic, count(*) over () as total from claims where claim_type = 'META' and not excluded) order by claim_id limit 40 offset 20")
def r18(spark, sf_dir):
    return curate.list_claims(event_claims(spark, sf_dir), F.expr("claim_type = 'META' and not excluded"), 40, 20).select("claim_id", "topic", "total", "has_more")


@query("a1_source_rollup", f"with {EVENTS} select source, count(*) as n, count(*) filter (excluded) as n_excluded, count(*) filter (not excluded) as n_active, min(ts) as first_ts, array_to_string(list_sort(list(distinct claim_type)), ',') as claim_types from claims group by 1")
def a1(spark, sf_dir):
    return curate.source_rollup(event_claims(spark, sf_dir))


@query("a2_corpus_stats", f"with {EVENTS} select coalesce(claim_type, 'all') as claim_type, count(*) as n, count(distinct source) as n_sources, count(distinct topic) as n_topics from claims group by rollup (claim_type)")
def a2(spark, sf_dir):
    return curate.corpus_stats(event_claims(spark, sf_dir))


@query("a5_quality_report", f"""with {EVENTS}, b as (select topic, count(*) as n, count(distinct source) as n_sources, count(*) filter (claim_type = 'META') as n_meta, count(*) filter (claim_type = 'PRIMARY') as n_primary, count(ts) as n_dated from claims group by 1)
select *, n >= 5 and n_sources >= 2 as sufficient, concat_ws(',', case when n < 5 then 'few_claims' end, case when n_sources < 2 then 'few_sources' end, case when n_meta = 0 then 'no_meta' end, case when n_dated < n then 'undated' end) as warnings from b""")
def a5(spark, sf_dir):
    return curate.quality_report(event_claims(spark, sf_dir))


@query("a6_exclude", f"with {EVENTS} select claim_id, excluded or claim_id in (select item_id from benchmark) as excluded from claims")
def a6(spark, sf_dir):
    return curate.exclude(event_claims(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"))).select("claim_id", "excluded")


@query("a7_delete_source", f"with {EVENTS} select vec_id as claim_id, label from embeddings where vec_id not in (select claim_id from claims where source = 3)")
def a7(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("claim_id"), "label")
    return curate.delete_source(event_claims(spark, sf_dir), vecs, 3)[1]


@query("s7_upsert_latest", "with b as (select o_custkey, o_orderkey, o_totalprice, 0 as fresh from orders where o_orderkey % 2 = 0 union all select o_custkey, o_orderkey, o_totalprice, 1 from orders where o_orderkey % 2 = 1) select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, fresh desc) as rn from b) where rn = 1")
def s7(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return curate.upsert_latest(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", "o_totalprice")


@query("s8_pending", f"with {EVENTS} select claim_id from claims where claim_id not in (select vec_id from embeddings)")
def s8(spark, sf_dir):
    return event_claims(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("claim_id")), "claim_id", "left_anti").select("claim_id")


@query("t22_merge_nodes", "select l_suppkey as node, max(l_quantity) as top_quantity, sum(l_linenumber) as lines from lineitem group by 1")
def t22(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as node", "l_quantity as top_quantity", "cast(l_linenumber as bigint) as lines", "l_orderkey")
    return curate.merge_nodes(x.where("l_orderkey % 2 = 0"), x.where("l_orderkey % 2 = 1"), "node", ["top_quantity"], ["lines"])


def _indicator_sql(lexicon) -> tuple[str, str]:
    cat, term = "case", "case"
    for name, include, veto in lexicon:
        for w in include:
            when = f" when not {_any('lower(claim_text)', veto)} and contains(lower(claim_text), '{w}') then "
            cat, term = cat + when + f"'{name}'", term + when + f"'{w}'"
    return cat + " end", term + " end"


_CAT, _TERM = _indicator_sql(LEXICON)


@query("d1_indicators", f"with {DOC_CLAIMS}, h as (select claim_id, doc_id, seq, topic, {_CAT} as category, {_TERM} as term from claims) select * from h where category is not null")
def d1(spark, sf_dir):
    return detect.indicators(_doc_claims(spark, sf_dir), LEXICON).select("claim_id", "doc_id", "seq", "topic", "category", "term")


_ECAT = _indicator_sql(EVENT_LEXICON)[0]
_GOLD = "case when k <= 0 then 0.0 when k <= 1 then k * cast(0.1 as double) when k <= 2 then 0.2 else least(cast(0.5 as double) + ln(k - 2 + 1) * cast(0.2 as double), cast(0.95 as double)) end"


@query("d11_suppression_score", f"""with {EVENTS},
b as (select topic, count(*) as n, coalesce(least(1.5 * count(*) filter (claim_type = 'META') / nullif(count(*) filter (claim_type in ('META', 'PRIMARY')), 0), 0.8), 0.0) as meta_density,
 0.5 * (1 - avg(cast(n_citations > 0 as int))) as isolation, coalesce(count(*) filter (claim_type = 'META' and n_citations = 0) / nullif(count(*) filter (claim_type = 'META'), 0), 0.0) as avoidance,
 least(2 * avg(cast({_any("lower(claim_text)", MISMATCH)} as int)), 0.8) as mismatch, count(*) filter ({_ECAT} is not null) as k from claims group by 1),
g as (select *, {_GOLD} as narrative from b),
t as (select *, 0.40 * narrative + 0.20 * meta_density + 0.15 * isolation + 0.15 * avoidance + case when mismatch > 0 then 0.10 * mismatch else 0 end as total, case when mismatch > 0 then 1.0 else 0.9 end as used from g)
, u as (select *, round(total / used, 6) as score from t)
select topic, n, k as n_indicators, round(narrative, 6) as narrative, round(meta_density, 6) as meta_density, round(isolation, 6) as isolation, round(avoidance, 6) as avoidance, round(mismatch, 6) as mismatch, score,
 round(0.3 * least(n / 20.0, 1.0) + 0.3 * (cast(narrative > 0 as int) + cast(meta_density > 0 as int) + cast(isolation > 0 as int) + cast(avoidance > 0 as int) + cast(mismatch > 0 as int)) / 5 + 0.4 * least(k / 5.0, 1.0), 6) as confidence,
 case when score >= 0.75 then 'CRITICAL' when score >= 0.55 then 'HIGH' when score >= 0.35 then 'MODERATE' when score >= 0.15 then 'LOW' else 'MINIMAL' end as level from u""")
def d11(spark, sf_dir):
    return detect.suppression_score(event_claims(spark, sf_dir), EVENT_LEXICON, MISMATCH)


BURST = """w as (select topic, ts, count(*) over (partition by topic order by ts range between current row and interval 14 days following) as n from claims where ts is not null),
burst as (select topic, max(n) as cluster, arg_min(ts, (-n, ts)) as window_start, count(*) as n_dated from w group by 1),
burst1 as (select *, cluster / n_dated as r from burst),
burst2 as (select topic, cluster, window_start, n_dated, round(cast(case when n_dated < 3 then null
 when r >= 0.8 then case when cluster >= 20 then 0.9 when cluster >= 10 then 0.8 when cluster >= 5 then 0.7 else 0.5 end
 when r >= 0.6 then case when cluster >= 30 then 0.8 when cluster >= 15 then 0.6 when cluster >= 5 then 0.5 else 0.3 end
 when cluster >= 50 and r > 0.3 then 0.9 when cluster >= 25 and r > 0.3 then 0.8 when cluster >= 15 and r > 0.25 then 0.7 when cluster >= 10 and r > 0.2 then 0.6 when cluster >= 5 then 0.4 + r * 0.5 else 0.2 * r end as double), 6) as burst_score,
 round(r, 6) as burst_ratio from burst1)"""


@query("d20_temporal_burst", f"with {EVENTS}, {BURST} select topic, cluster, window_start, n_dated, burst_score, burst_ratio, burst_score >= 0.5 as burst from burst2")
def d20(spark, sf_dir):
    return detect.temporal_burst(event_claims(spark, sf_dir))


@query("d28_burst_members", f"with {EVENTS}, {BURST} select c.topic, claim_id, ts, lag(claim_id) over (partition by c.topic order by ts, claim_id) as previous_id from claims c join burst2 b on c.topic = b.topic where ts >= window_start and ts <= window_start + interval 14 days")
def d28(spark, sf_dir):
    return detect.burst_members(event_claims(spark, sf_dir))


CENTRAL = """per as (select topic, source, count(*) as k from claims where source is not null group by 1, 2),
top as (select topic, arg_max(source, (k, -source)) as top_source, cast(sum(k) as bigint) as n, count(*) as n_sources, max(k) as top from per group by 1),
central as (select topic, top_source, n, n_sources, round(top / n, 6) as top_share, round(n_sources / n, 6) as diversity, round(cast(case when top / n > 0.5 then 0.8 when top / n > 0.3 then 0.6 when n_sources / n < 0.2 then 0.5 else top / n * 0.5 end as double), 6) as central_score, top / n > 0.4 or n_sources / n < 0.25 as centralized from top)"""


@query("d25_source_centralization", f"with {EVENTS}, {CENTRAL} select * from central")
def d25(spark, sf_dir):
    return detect.source_centralization(event_claims(spark, sf_dir))


EMOTION = """sh as (select topic, avg(coalesce(fear, false)::int) as fear, avg(coalesce(anger, false)::int) as anger, avg(coalesce(urgency, false)::int) as urgency, avg(coalesce(intense, false)::int) as intense from claims group by 1),
emotion as (select *, least(1.0, greatest(greatest(fear, urgency) + least(fear, urgency) / 2, 1.2 * fear, 1.3 * anger, 0.35 * fear + 0.35 * anger + 0.2 * urgency + 0.1 * intense) * case when (fear > 0.2)::int + (anger > 0.2)::int + (urgency > 0.2)::int >= 2 then 1.5 else 1.0 end * case when intense > 0.5 then 1.2 else 1.0 end) as e from sh)"""


@query("d24_synchronized_emotion", f"with {EVENTS}, {EMOTION} select topic, round(fear, 6) as fear, round(anger, 6) as anger, round(urgency, 6) as urgency, round(intense, 6) as intense, round(e, 6) as emotion_score, e > 0.4 as synchronized from emotion")
def d24(spark, sf_dir):
    return detect.synchronized_emotion(event_claims(spark, sf_dir))


CARTEL = """cited as (select cites.topic, c.source, count(*) as k from cites join claims c on c.claim_id = dst group by 1, 2),
cartel1 as (select topic, max(k) as top, cast(sum(k) as bigint) as n, arg_max(source, (k, -source)) as top_source from cited group by 1),
cartel as (select topic, n as n_citations, top_source as top_cited, round(top / n, 6) as share, cast(case when n >= 3 then case when top / n > 0.6 then 0.9 when top / n > 0.4 then 0.6 when top / n > 0.2 then 0.3 else 0.1 end end as double) as cartel_score, top / n > 0.4 as cartel from cartel1)"""


def _cartel(spark, sf_dir):
    return detect.citation_cartel(cites(spark, sf_dir), event_claims(spark, sf_dir).selectExpr("claim_id as node", "source"))


@query("d22_citation_cartel", f"with {EVENTS}, {CITES}, {CARTEL} select * from cartel")
def d22(spark, sf_dir):
    return _cartel(spark, sf_dir)


LANGUAGE = """cross_pairs as (select a.topic, list_cosine_similarity(a.embedding, b.embedding) as s from vectors a join vectors b on a.topic = b.topic and a.claim_id < b.claim_id and a.source <> b.source),
language1 as (select topic, count(*) as pairs, count(*) filter (s > 0.85) as high_pairs, count(*) filter (s > 0.7) as medium_pairs, avg(s) as m, max(s) as x from cross_pairs group by 1),
language as (select topic, pairs, high_pairs, medium_pairs, round(m, 6) as mean_similarity, round(x, 6) as max_similarity,
 round(least(case when x > 0.95 then 0.1 else 0 end + case when high_pairs >= 50 then 0.9 when high_pairs >= 20 then 0.7 when high_pairs >= 10 then 0.5 when high_pairs >= 5 then 0.3 when medium_pairs >= 50 then 0.5 when medium_pairs >= 20 then 0.3 else least(m, 0.2) end, 1.0), 6) as language_score from language1)"""


@query("d21_language_similarity", f"with {EVENTS}, {VECTORS}, {LANGUAGE} select * from language")
def d21_pairs(spark, sf_dir):
    return detect.language_similarity(claim_vectors(spark, sf_dir))


@query("r8_vector_join", "select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 5) as similarity from embeddings a join embeddings b on a.vec_id < b.vec_id where list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) >= 0.4")
def r8(spark, sf_dir):
    return vector_join(table(spark, sf_dir, "embeddings"), "vec_id", 0.4).withColumn("similarity", F.round("similarity", 5))


@query("d21_language_average", """
select 'all' as topic, count(*) as pairs, round(avg(list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[]))), 6) as mean_similarity from embeddings a join embeddings b on a.vec_id < b.vec_id and a.label <> b.label""")
def d21(spark, sf_dir):
    return detect.language_average(table(spark, sf_dir, "embeddings").selectExpr("'all' as topic", "label as source", "embedding"))


SIGNALS = f"""{BURST}, {CENTRAL}, {EMOTION}, {CITES}, {CARTEL}, {VECTORS}, {LANGUAGE},
signals as (select topic, burst_score, language_score, cartel_score, round(e, 6) as emotion_score, central_score from emotion left join burst2 using (topic) left join central using (topic) left join cartel using (topic) left join language using (topic))"""


def _signals(spark, sf_dir):
    """D20-D22, D24, D25 of each topic; a signal without data is null."""
    claims = event_claims(spark, sf_dir)
    out = detect.synchronized_emotion(claims).select("topic", "emotion_score")
    for part, score in ((detect.temporal_burst(claims), "burst_score"), (detect.language_similarity(claim_vectors(spark, sf_dir)), "language_score"), (_cartel(spark, sf_dir), "cartel_score"), (detect.source_centralization(claims), "central_score")):
        out = out.join(part.select("topic", score), "topic", "left")
    return out


@query("d26_coordination_score", f"""with {EVENTS}, {SIGNALS},
t as (select *, 0.25 * coalesce(burst_score, 0) + 0.25 * coalesce(language_score, 0) + 0.2 * coalesce(cartel_score, 0) + 0.15 * coalesce(emotion_score, 0) + 0.15 * coalesce(central_score, 0) as total,
 0.25 * (burst_score is not null)::int + 0.25 * (language_score is not null)::int + 0.2 * (cartel_score is not null)::int + 0.15 * (emotion_score is not null)::int + 0.15 * (central_score is not null)::int as used,
 (coalesce(burst_score > 0, false)::int + coalesce(language_score > 0, false)::int + coalesce(cartel_score > 0, false)::int + coalesce(emotion_score > 0, false)::int + coalesce(central_score > 0, false)::int) / 5 as c from signals),
u as (select *, round(cast(case when used > 0 and used < 1 then total / used else total end as double), 6) as score from t)
select topic, burst_score, language_score, cartel_score, emotion_score, central_score, score, round(cast(case when c > 0 then c else 0.5 end as double), 6) as confidence, case when score >= 0.8 then 'CRITICAL' when score >= 0.6 then 'HIGH' when score >= 0.4 then 'MODERATE' when score >= 0.2 then 'LOW' else 'MINIMAL' end as severity from u""")
def d26(spark, sf_dir):
    return detect.coordination_score(_signals(spark, sf_dir), detect.COORDINATION)


@query("d27_coordination_v1", f"""with {EVENTS}, {SIGNALS}, v as (select topic, round(cast(case when cluster >= 50 and r > 0.5 then 0.9 when cluster >= 30 and r > 0.4 then 0.7 when cluster >= 20 and r > 0.3 then 0.5 when cluster >= 10 and r > 0.2 then 0.3 else r * 0.5 end as double), 6) as burst_v1 from burst1)
select topic, burst_v1, round(cast(0.25 * coalesce(burst_v1, 0) + 0.25 * coalesce(language_score, 0) + 0.2 * coalesce(cartel_score, 0) + 0.15 * coalesce(emotion_score, 0) + 0.15 * coalesce(central_score, 0) as double), 6) as score,
 round(cast((coalesce(burst_v1 > 0, false)::int + coalesce(language_score > 0, false)::int + coalesce(cartel_score > 0, false)::int + coalesce(emotion_score > 0, false)::int + coalesce(central_score > 0, false)::int) / 5 as double), 6) as confidence from signals left join v using (topic)""")
def d27(spark, sf_dir):
    v1 = detect.temporal_burst(event_claims(spark, sf_dir)).select("topic", detect.burst_score_v1("cluster", "n_dated").alias("burst_v1"))
    weights = {("burst_v1" if k == "burst_score" else k): w for k, w in detect.COORDINATION.items()}
    return detect.coordination_v1(_signals(spark, sf_dir).join(v1, "topic", "left"), weights).select("topic", "burst_v1", "score", "confidence")


PAIRS = f"""{PLACES},
d as (select a.topic, a.location as location1, b.location as location2, 2 * 6371.0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0))) as km,
 case when a.first_ts is null or b.first_ts is null then 0.5 when a.first_ts <= b.last_ts and b.first_ts <= a.last_ts then 0.8 else 0.3 end as overlap from places a join places b on a.topic = b.topic and a.location < b.location),
i as (select *, case when km * 0.621371 >= 5000 then least(0.7 + (km * 0.621371 - 5000) / 10000, 1.0) else km * 0.621371 / 5000 * 0.5 end as iso from d),
pairs as (select topic, location1, location2, round(km, 3) as km, round(iso, 6) as isolation, cast(overlap as double) as overlap, round((0.25 * iso + 0.15 * overlap) / 0.40, 6) as pair_score from i)"""


@query("d31_location_pairs", f"with {PAIRS} select * from pairs")
def d31(spark, sf_dir):
    return detect.location_pairs(places(spark, sf_dir))


@query("d38_anomaly_score", f"""with {PAIRS}, r as (select *, row_number() over (partition by topic order by pair_score desc, location1, location2) as rk from pairs where pair_score > 0.3),
g as (select topic, count(*) as n_pairs, max(pair_score) filter (rk = 1) as s1, max(pair_score) filter (rk = 2) as s2, avg(pair_score) filter (rk > 2) as rest from r group by 1)
select topic, n_pairs, round(case when n_pairs = 1 then s1 when n_pairs = 2 then 0.6 * s1 + 0.4 * s2 else 0.5 * s1 + 0.3 * s2 + 0.2 * rest end, 6) as score, cast(case when n_pairs >= 5 then 0.95 when n_pairs >= 3 then 0.85 when n_pairs = 2 then 0.75 else 0.6 end as double) as confidence from g""")
def d38(spark, sf_dir):
    return detect.anomaly_score(detect.location_pairs(places(spark, sf_dir)))


TRUST = f"""{RING}, te as (select src, dst, sum(case rel_type when 'CONTRADICTS' then -0.5 * weight when 'SUPPORTS' then weight else 0.5 * weight end) as w from ring group by 1, 2),
p as (select src, dst, w / nullif(sum(abs(w)) over (partition by src), 0) as p from te),
n0 as (select s_suppkey as node, (s_suppkey % 10) / 10.0 as t0, (s_suppkey % 10) / 10.0 as t from supplier),
n1 as (select n.node, n.t0, (1 - 0.85) * n.t0 + 0.85 * coalesce(i.f, 0) as t from n0 n left join (select dst, sum(p * t) as f from p join n0 on src = node group by 1) i on i.dst = n.node),
n2 as (select n.node, n.t0, (1 - 0.85) * n.t0 + 0.85 * coalesce(i.f, 0) as t from n0 n left join (select dst, sum(p * t) as f from p join n1 on src = node group by 1) i on i.dst = n.node),
n3 as (select n.node, n.t0, (1 - 0.85) * n.t0 + 0.85 * coalesce(i.f, 0) as t from n0 n left join (select dst, sum(p * t) as f from p join n2 on src = node group by 1) i on i.dst = n.node),
trust as (select node, round((t - min(t) over ()) / (max(t) over () - min(t) over ()), 6) as trust from n3)"""


def _trust(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as node", "(s_suppkey % 10) / 10.0D as t0")
    return graph.trust_propagation(nodes, graph.trust_edges(ring_edges(spark, sf_dir)))


@query("g2_trust_propagation", f"with {TRUST} select node, trust from trust")
def g2(spark, sf_dir):
    return _trust(spark, sf_dir)


@query("g14_contested", f"with {TRUST}, c as (select src, dst from ring where rel_type = 'CONTRADICTS' union select dst, src from ring where rel_type = 'CONTRADICTS') select a.node, count(*) as n, round(max(a.trust) * count(*), 6) as score from c join trust a on a.node = src join trust b on b.node = dst where a.trust > 0.4 and b.trust > 0.3 group by 1")
def g14(spark, sf_dir):
    return graph.contested(ring_edges(spark, sf_dir), _trust(spark, sf_dir), 0.4, 0.3)


@query("g7_cooccurrence", """with m as (select distinct l_orderkey as doc, l_suppkey as entity from lineitem), s as (select entity, count(*) as c from m group by 1 having count(*) >= 3),
k as (select m.* from m semi join s using (entity)), p as (select a.entity as e1, b.entity as e2, count(*) as co from k a join k b on a.doc = b.doc and a.entity < b.entity group by 1, 2 having count(*) >= 3)
select e1, e2, co, round(co / a.c, 6) as conf12, round(co / b.c, 6) as conf21, round(co * (select count(distinct doc) from m) / (a.c * b.c), 6) as lift from p join s a on a.entity = e1 join s b on b.entity = e2""")
def g7(spark, sf_dir):
    return graph.cooccurrence(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "l_suppkey as entity"))


@query("g9_temporal_sequences", """with d as (select o_custkey as grp, o_orderpriority as entity, cast(o_orderdate as date) as day from orders)
select x.entity as e1, y.entity as e2, count(*) as n, round(avg(y.day - x.day), 6) as mean_days from d x join d y on x.grp = y.grp and x.entity <> y.entity and y.day - x.day > 0 and y.day - x.day <= 90 group by 1, 2 having count(*) >= 3""")
def g9(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("o_custkey as grp", "o_orderpriority as entity", "cast(o_orderdate as date) as day")
    return graph.temporal_sequences(d)


@query("g11_chains", f"with {RING} select x.src as a, x.dst as b, y.dst as c, round(x.weight * y.weight, 6) as strength from ring x join ring y on x.dst = y.src and x.src <> y.dst where not exists (select 1 from ring z where z.src = x.src and z.dst = y.dst) order by strength desc, a, b, c limit 100")
def g11(spark, sf_dir):
    return graph.chains(ring_edges(spark, sf_dir), 100)


CASCADES = "e as (select distinct src, dst from ring), one as (select src, count(*) as n1 from e group by 1), two as (select x.src, count(distinct y.dst) as n2 from e x join e y on x.dst = y.src and x.src <> y.dst group by 1), casc as (select src as node, n1, n2, n1 * n2 as magnitude from one join two using (src) where n1 >= 3 and n2 >= 5)"


@query("g13_cascades", f"with {RING}, {CASCADES} select * from casc order by magnitude desc, node limit 20")
def g13(spark, sf_dir):
    return graph.cascades(ring_edges(spark, sf_dir))


@query("g18_degree_stats", f"with {EDGES}, p as (select rel_type, src, count(*) as d from edges group by 1, 2) select rel_type, cast(sum(d) as bigint) as n_edges, round(avg(d), 6) as mean_degree, max(d) as max_degree from p group by 1")
def g18(spark, sf_dir):
    return graph.degree_stats(part_edges(spark, sf_dir))


@query("r24_hubs", f"with {EDGES}, b as (select src, dst from edges union all select dst, src from edges) select src as node, count(*) as degree, count(distinct dst) as neighbours from b group by 1 having count(*) >= 3 order by degree desc, node limit 10")
def r24(spark, sf_dir):
    return graph.hubs(part_edges(spark, sf_dir))


@query("v2_timeline_groups", f"with {EVENTS}, n as (select source, count(*) as n from claims group by 1), r as (select *, row_number() over (order by n desc, source) as rk from n) select case when rk <= 20 then cast(source as varchar) else '_other' end as grp, cast(sum(n) as bigint) as n from r group by 1")
def v2(spark, sf_dir):
    return graph.timeline_groups(event_claims(spark, sf_dir), "source")


@query("v4_timeline_histogram", f"with {EVENTS} select cast(date_trunc('week', ts) as date) as bucket, count(*) as n from claims where ts is not null group by 1")
def v4(spark, sf_dir):
    return graph.timeline_histogram(event_claims(spark, sf_dir))


@query("x3_burst_counts", f"with {EVENTS} select topic, cast(s as timestamp) as window_start, count(*) as n from claims, lateral (select unnest(generate_series(date_trunc('day', ts) - interval 13 days, date_trunc('day', ts), interval 1 day)) as s) where ts is not null group by 1, 2")
def x3(spark, sf_dir):
    return burst_counts(event_claims(spark, sf_dir)).select("topic", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


from claimweave.plans import deep, more, wide  # noqa: E402, F401  add their queries to the tables above
