"""Retrieval, roll-ups and curation over claims, edges and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimweave.functions.scoring import cosine


def search_text(claims: DataFrame, q: str, limit: int | None = None) -> DataFrame:
    """Claims whose text contains q in any case, best confidence first."""
    hit = claims.where(F.contains(F.lower("claim_text"), F.lit(q.lower())))
    return hit.orderBy(F.desc("confidence"), "claim_id").limit(limit) if limit else hit


def search_relevance(claims: DataFrame, terms: list[str], min_conf: float = 0.0) -> DataFrame:
    """Relevance is 2 for each matched term over 5 letters and 1 for each other; claims that match none go."""
    score = sum((F.when(F.contains(F.lower("claim_text"), F.lit(t.lower())), 2 if len(t) > 5 else 1).otherwise(0) for t in terms), F.lit(0))
    return claims.where(F.col("confidence") >= min_conf).withColumn("relevance", score).where("relevance > 0")


def claims_by_id(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """The claims whose claim_id is in ids."""
    return claims.join(ids.select("claim_id"), "claim_id", "left_semi")


def prioritized_sample(claims: DataFrame, topic: str, terms: list[str], limit: int = 500) -> DataFrame:
    """Per topic the first `limit` claims by 2 for META plus 3 for a high-precision term, then by the md5 of the id."""
    precise = F.exists(F.array(*map(F.lit, terms)), lambda w: F.contains(F.lower("claim_text"), w))
    rated = claims.withColumn("priority", F.when(F.col("claim_type") == "META", 2).otherwise(0) + F.when(precise, 3).otherwise(0))
    order = W.partitionBy(topic).orderBy(F.desc("priority"), F.md5(F.col("claim_id").cast("string")))
    return rated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def list_claims(claims: DataFrame, where: Column, limit: int, offset: int = 0) -> DataFrame:
    """One page of the claims that match, with the total and whether more follow."""
    hit = claims.where(where)
    total = hit.agg(F.count("*").alias("total"))  # one row
    page = hit.orderBy("claim_id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def source_rollup(claims: DataFrame) -> DataFrame:
    """A1: per source its claims, how many are excluded and active, the first date and the claim types."""
    return claims.groupBy("source").agg(F.count("*").alias("n"), F.count_if("excluded").alias("n_excluded"), F.count_if(~F.col("excluded")).alias("n_active"), F.min("ts").alias("first_ts"), F.array_join(F.array_sort(F.collect_set("claim_type")), ",").alias("claim_types"))


def corpus_stats(claims: DataFrame) -> DataFrame:
    """A2: totals, with a row per claim type and one for all."""
    return claims.rollup("claim_type").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), F.count_distinct("topic").alias("n_topics")).withColumn("claim_type", F.coalesce("claim_type", F.lit("all")))


def quality_report(claims: DataFrame, min_claims: int = 5, min_sources: int = 2) -> DataFrame:
    """A5: per topic the counts that detectors need, whether they suffice, and warning codes."""
    base = claims.groupBy("topic").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), F.count_if(F.col("claim_type") == "META").alias("n_meta"), F.count_if(F.col("claim_type") == "PRIMARY").alias("n_primary"), F.count_if(F.col("ts").isNotNull()).alias("n_dated"))
    warn = F.array_compact(F.array(F.when(F.col("n") < min_claims, F.lit("few_claims")), F.when(F.col("n_sources") < min_sources, F.lit("few_sources")), F.when(F.col("n_meta") == 0, F.lit("no_meta")), F.when(F.col("n_dated") < F.col("n"), F.lit("undated"))))
    return base.withColumn("sufficient", (F.col("n") >= min_claims) & (F.col("n_sources") >= min_sources)).withColumn("warnings", F.array_join(warn, ","))


def exclude(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """Claims in ids become excluded; the others keep their flag."""
    flag = ids.select("claim_id").distinct().withColumn("_hit", F.lit(True))
    return claims.join(flag, "claim_id", "left").withColumn("excluded", F.coalesce("_hit", "excluded")).drop("_hit")


def delete_source(claims: DataFrame, vectors: DataFrame, source) -> tuple[DataFrame, DataFrame]:
    """Claims and vectors without those of a source."""
    gone = claims.where(F.col("source") == source).select("claim_id")
    return claims.join(gone, "claim_id", "left_anti"), vectors.join(gone, "claim_id", "left_anti")


def upsert_latest(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Of rows with one key, the one with the highest version; incoming wins ties."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    best = W.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank", "_new")


def merge_nodes(existing: DataFrame, incoming: DataFrame, key: str, most: list[str], add: list[str]) -> DataFrame:
    """Upsert by key: the larger of the columns in most, the sum of those in add."""
    both = existing.select(key, *most, *add).unionByName(incoming.select(key, *most, *add))
    return both.groupBy(key).agg(*(F.max(c).alias(c) for c in most), *(F.sum(c).alias(c) for c in add))


def search_vector(vecs: DataFrame, query: list[float], k: int, floor: float = 0.3) -> DataFrame:
    """The k vectors of highest cosine to a query, none below the floor."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vecs.withColumn("_q", q).withColumn("similarity", cosine("embedding", "_q")).where(F.col("similarity") >= floor).orderBy(F.desc("similarity"), "vec_id").limit(k).drop("_q")


def merge_results(text: DataFrame, vector: DataFrame) -> DataFrame:
    """Union by claim_id: the higher similarity, tagged graph, semantic or both."""
    a, b = text.select("claim_id", F.col("similarity").alias("s1")), vector.select("claim_id", F.col("similarity").alias("s2"))
    tag = F.when(F.col("s1").isNull(), "semantic").when(F.col("s2").isNull(), "graph").otherwise("both")
    return a.join(b, "claim_id", "full").select("claim_id", F.greatest("s1", "s2").alias("similarity"), tag.alias("found_by"))
