"""Answers assembled from claims, evidence, communities and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimweave.operators import curate


def search_key_terms(q: str, stop: list[str], names: DataFrame, mentions: DataFrame, claims: DataFrame, shown: int = 5) -> DataFrame:
    """claim_id, n_entities, entities: claims of the docs that mention an entity whose name has a word of q that is over 2 letters and no stop word.

    names: entity, name; mentions: doc, entity; claims: claim_id, doc. entities are the first `shown` of them by name.
    """
    import re

    terms = sorted({w for w in re.findall(r"\w+", q.lower()) if len(w) > 2} - set(stop))
    hit = names.where(F.exists(F.array(*map(F.lit, terms)), lambda w: F.contains(F.lower("name"), w))) if terms else names.limit(0)
    docs = mentions.select("doc", "entity").distinct().join(hit, "entity").groupBy("doc").agg(F.count("*").alias("n_entities"), F.array_sort(F.collect_set("name")).alias("names"))
    return claims.join(docs, "doc").select("claim_id", "n_entities", F.slice("names", 1, shown).alias("entities"))


def expand_topics(topics: DataFrame, query: list[float], threshold: float = 0.40, limit: int = 20) -> DataFrame:
    """Topic, similarity: the topics nearest to a query vector, none below the threshold, ties by topic. topics: topic, embedding."""
    near = curate.search_vector(topics.withColumnRenamed("topic", "vec_id"), query, limit, threshold)
    return near.select(F.col("vec_id").alias("topic"), F.round("similarity", 5).alias("similarity"))


def claim_detail(claims: DataFrame, chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """Every claim with its chunk's text and the sorted set of its entities, nulls left out. claims: claim_id, chunk_id, ...; chunks: chunk_id, text; mentions: claim_id, entity."""
    sets = mentions.where("entity is not null").groupBy("claim_id").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    none = F.array().cast(sets.schema["entities"].dataType)
    return claims.join(chunks.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id", "left").join(sets, "claim_id", "left").withColumn("entities", F.coalesce("entities", none))


def query_graph(claims: DataFrame, mentions: DataFrame, relevant: DataFrame, shared: int = 2) -> DataFrame:
    """Src, dst, kind, weight over the relevant claims: claim to entity (mentions, 0.7) and entity to entity in one chunk (co-occurs, 0.4).

    Only entities in at least `shared` chunks of relevant claims count. claims: claim_id, chunk; mentions: chunk, entity; relevant: claim_id.
    """
    c = claims.join(relevant.select("claim_id").distinct(), "claim_id", "left_semi").select("claim_id", "chunk")
    m = mentions.join(c.select("chunk").distinct(), "chunk", "left_semi").select("chunk", "entity").distinct()
    m = m.join(m.groupBy("entity").agg(F.count("*").alias("k")).where(F.col("k") >= shared).select("entity"), "entity", "left_semi")
    told = c.join(m, "chunk").select(F.concat(F.lit("c"), F.col("claim_id")).alias("src"), F.concat(F.lit("e"), F.col("entity")).alias("dst"), F.lit("mentions").alias("kind"), F.lit(0.7).alias("weight")).distinct()
    near = m.withColumnRenamed("entity", "a").join(m.withColumnRenamed("entity", "b"), "chunk").where("a < b").select("a", "b").distinct()
    return told.union(near.select(F.concat(F.lit("e"), F.col("a")), F.concat(F.lit("e"), F.col("b")), F.lit("co-occurs"), F.lit(0.4)))


def patterns_for_entities(links: DataFrame, entities: DataFrame, k: int = 5) -> DataFrame:
    """pattern_id, n_entities: the k patterns with most of the entities, ties by id. links: pattern_id, node; entities: node."""
    hit = links.select("pattern_id", "node").distinct().join(entities.select("node").distinct(), "node", "left_semi")
    return hit.groupBy("pattern_id").agg(F.count("*").alias("n_entities")).orderBy(F.desc("n_entities"), "pattern_id").limit(k)


def community_perspectives(place: DataFrame, trust: DataFrame, entities: DataFrame, k: int = 3, least: int = 10, top: int = 10, floor: float = 0.5) -> DataFrame:
    """Community, n_matched, size, members: the k communities of more than `least` nodes with most of the entities and, of each, its `top` members of trust over the floor."""
    size = place.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") > least)
    hit = place.join(entities.select("node").distinct(), "node", "left_semi").groupBy("community").agg(F.count("*").alias("n_matched"))
    best = size.join(hit, "community").orderBy(F.desc("n_matched"), "community").limit(k)
    r = place.join(best, "community", "left_semi").join(trust, "node").where(F.col("trust") > floor).withColumn("rank", F.row_number().over(W.partitionBy("community").orderBy(F.desc("trust"), "node"))).where(F.col("rank") <= top)
    members = r.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("rank", "node"))).alias("m"))
    return best.join(members, "community", "left").select("community", "n_matched", "size", F.expr("transform(m, x -> x.node)").alias("members"))


def consensus(edges: DataFrame, trust: DataFrame, own: float = 0.7, other: float = 0.7) -> DataFrame:
    """Node, strength: nodes of trust over `own` with more support than contradiction and a supporter of trust over `other`; strength is support over all evidence."""
    e = edges.where("rel_type in ('SUPPORTS', 'CONTRADICTS')").join(trust.select(F.col("node").alias("src"), F.col("trust").alias("t")), "src", "left")
    got = e.groupBy(F.col("dst").alias("node")).agg(F.count_if(F.col("rel_type") == "SUPPORTS").alias("pro"), F.count_if(F.col("rel_type") == "CONTRADICTS").alias("anti"), F.coalesce(F.max((F.col("rel_type") == "SUPPORTS") & (F.coalesce("t", F.lit(0.5)) > other)), F.lit(False)).alias("sure"))
    return got.join(trust, "node").where((F.col("trust") > own) & (F.col("pro") > F.col("anti")) & F.col("sure")).select("node", F.round(F.expr("pro / (pro + anti)"), 6).alias("strength"))


def answer_confidence(claims: DataFrame, by: list[str]) -> DataFrame:
    """Per answer min(1, mean trust * (0.5 + 0.5 min(1, ratio / 5))), ratio = support over contradictions (at least 1). claims: by, trust, n_pro, n_anti."""
    mean = F.sum(F.col("trust").cast("decimal(20,6)")).cast("double") / F.count("trust")
    ratio = F.sum("n_pro") / F.greatest(F.sum("n_anti"), F.lit(1))
    return claims.groupBy(*by).agg(F.round(F.least(F.lit(1.0), mean * (0.5 + 0.5 * F.least(F.lit(1.0), ratio / 5))), 6).alias("answer_confidence"))


def assess_source(claims: DataFrame, cites: DataFrame) -> DataFrame:
    """Per source its claims, the distinct other sources it cites and is cited by, isolated if fewer than 2 cite it. claims: claim_id, source; cites: src, dst."""
    of = claims.select("claim_id", "source")
    met = cites.join(of.withColumnsRenamed({"claim_id": "src", "source": "a"}), "src").join(of.withColumnsRenamed({"claim_id": "dst", "source": "b"}), "dst").where("a <> b").select("a", "b").distinct()
    out = met.groupBy(F.col("a").alias("source")).agg(F.count("*").alias("n_cites"))
    back = met.groupBy(F.col("b").alias("source")).agg(F.count("*").alias("n_cited_by"))
    n = claims.groupBy("source").agg(F.count("*").alias("n_claims"))
    full = n.join(out, "source", "left").join(back, "source", "left").select("source", "n_claims", F.coalesce("n_cites", F.lit(0)).alias("n_cites"), F.coalesce("n_cited_by", F.lit(0)).alias("n_cited_by"))
    return full.withColumn("isolated", F.col("n_cited_by") < 2)


def perspectives_by_type(claims: DataFrame, clusters: int = 4, per_cluster: int = 3) -> DataFrame:
    """Per topic its `clusters` largest claim types with their size and the per_cluster best claims by confidence, ties by id."""
    n = claims.groupBy("topic", "claim_type").agg(F.count("*").alias("n"))
    n = n.withColumn("o", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("n"), "claim_type"))).where(F.col("o") <= clusters).drop("o")
    r = claims.withColumn("rank", F.row_number().over(W.partitionBy("topic", "claim_type").orderBy(F.desc("confidence"), "claim_id"))).where(F.col("rank") <= per_cluster)
    best = r.groupBy("topic", "claim_type").agg(F.array_sort(F.collect_list(F.struct("rank", "claim_id"))).alias("m"))
    return n.join(best, ["topic", "claim_type"]).select("topic", "claim_type", "n", F.expr("array_join(transform(m, x -> cast(x.claim_id as string)), ',')").alias("best"))


def list_domains(claims: DataFrame, domain: str) -> DataFrame:
    """Domains with their claims, null ones left out."""
    return claims.where(F.col(domain).isNotNull()).groupBy(domain).agg(F.count("*").alias("n"))


def trust_sources(sources: DataFrame, min_trust: float, limit: int, offset: int = 0) -> DataFrame:
    """A page of the sources of at least min_trust, the most trusted first, ties by node."""
    return sources.where(F.col("trust") >= min_trust).orderBy(F.desc("trust"), "node").offset(offset).limit(limit)


def trust_networks(users: DataFrame, prefs: DataFrame) -> DataFrame:
    """Every user with the number of sources that they rate, 0 for none. prefs: user_id, source, score."""
    n = prefs.select("user_id", "source").distinct().groupBy("user_id").agg(F.count("*").alias("n"))
    return users.select("user_id").distinct().join(n, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("n_sources"))


def set_preferences(prefs: DataFrame, incoming: DataFrame, nodes: DataFrame) -> DataFrame:
    """Preferences after an upsert by (user_id, source): the incoming score wins, limited to -1..1; sources that are no node go.

    incoming: user_id, name, score; nodes: node, name. Of repeated incoming ones the highest score counts.
    """
    new = incoming.join(nodes, "name").groupBy("user_id", F.col("node").alias("source")).agg(F.max(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "score"))).alias("_new"))
    old = prefs.groupBy("user_id", "source").agg(F.max("score").alias("_old"))
    return old.join(new, ["user_id", "source"], "full").select("user_id", "source", F.coalesce("_new", "_old").alias("score"))


def analyze_topic(suppression: DataFrame, coordination: DataFrame, anomaly: DataFrame, claims: DataFrame, samples: int = 5) -> DataFrame:
    """Per topic the three scores (null without data), flags over 0.5, 0.5 and 0.6, and its best claims' ids. Each score table has topic, score; claims topic, claim_id, confidence."""
    one = lambda df, name: df.select("topic", F.col("score").alias(name))
    r = claims.withColumn("rank", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("confidence"), "claim_id"))).where(F.col("rank") <= samples)
    best = r.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "claim_id"))), lambda x: x["claim_id"].cast("string")), ",").alias("samples"))
    out = best.join(one(suppression, "suppression"), "topic", "left").join(one(coordination, "coordination"), "topic", "left").join(one(anomaly, "anomaly"), "topic", "left")
    flag = lambda c, x: F.coalesce(F.col(c) > x, F.lit(False))
    return out.withColumn("suppressed", flag("suppression", 0.5)).withColumn("coordinated", flag("coordination", 0.5)).withColumn("anomalous", flag("anomaly", 0.6))
