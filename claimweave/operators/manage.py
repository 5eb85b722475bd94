"""A5, A6, A7 in full: what each detector needs, soft exclusion with its times, deletion with all that hangs on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assess(claims: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """A5: per topic the counts, and for each detector whether they suffice and warning codes.

    claims: topic, claim_type, source, dated and located (booleans). Suppression: 10 claims, and 5 PRIMARY ones or 20 in all; coordination: 3 sources
    and 10 claims; anomaly: 2 located claims and 10 in all; `sufficient` is all three. topics (topic) adds those without
    claims, with no_claims alone. Null topics go; null types count in all only.
    """
    kind = lambda k: F.count_if(F.col("claim_type") == k)
    n = claims.where("topic is not null").groupBy("topic").agg(
        F.count("*").alias("total_claims"), kind("PRIMARY").alias("primary_claims"), kind("META").alias("meta_claims"), kind("SECONDARY").alias("secondary_claims"), kind("CONTEXTUAL").alias("contextual_claims"),
        F.count_distinct("source").alias("n_sources"), F.count_if("dated").alias("n_dated"), F.count_if("located").alias("n_located"),
    )
    if topics is not None:
        n = topics.where("topic is not null").select("topic").union(n.select("topic")).distinct().join(n, "topic", "left").fillna(0)
    total, primary, meta, sources = (F.col(c) for c in ("total_claims", "primary_claims", "meta_claims", "n_sources"))
    code = lambda *cases: F.when(total == 0, F.array(F.lit("no_claims"))).otherwise(F.array_compact(F.array(*cases)))
    warn = {
        "suppression": code(
            F.when(total < 10, "few_claims"), F.when(primary < 10, "few_primary"), F.when(meta == 0, "no_meta").when(meta < 5, "few_meta"), F.when(sources == 1, "one_source").when(sources < 3, "few_sources"),
        ),
        "coordination": code(F.when(sources < 3, "few_sources"), F.when(F.col("n_dated") < total * 0.3, "few_dated")),
        "anomaly": code(F.when(F.col("n_located") < 2, "few_located")),
    }
    fit = {"suppression": (total >= 10) & ((primary >= 5) | (total >= 20)), "coordination": (sources >= 3) & (total >= 10), "anomaly": (F.col("n_located") >= 2) & (total >= 10)}
    out = n.withColumns({f"{k}_sufficient": v for k, v in fit.items()}).withColumns({f"{k}_warnings": v for k, v in warn.items()})
    return out.withColumn("sufficient", F.expr("suppression_sufficient and coordination_sufficient and anomaly_sufficient"))


def _flagged(claims: DataFrame, ids: DataFrame, at: Column, excluded: bool) -> DataFrame:
    stamp, other = ("excluded_at", "restored_at") if excluded else ("restored_at", "excluded_at")
    for c in (stamp, other):
        claims = claims if c in claims.columns else claims.withColumn(c, F.lit(None).cast("timestamp"))
    hit = ids.select(F.col("claim_id").alias("flagged_id")).where("flagged_id is not null").distinct()
    met = claims.join(hit, F.col("claim_id") == F.col("flagged_id"), "left")
    found = F.col("flagged_id").isNotNull()
    return met.withColumns({"excluded": F.when(found, F.lit(excluded)).otherwise(F.coalesce("excluded", F.lit(False))), stamp: F.when(found, at).otherwise(F.col(stamp))}).drop("flagged_id")


def exclude(claims: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Claims (claim_id, excluded, ...) whose claim_id is among ids become excluded, excluded_at = at; other rows keep what they have, a null flag is false."""
    return _flagged(claims, ids, at, True)


def restore(claims: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """The reverse of exclude(): no longer excluded, restored_at = at."""
    return _flagged(claims, ids, at, False)


def active(claims: DataFrame) -> DataFrame:
    """The claims that detectors look at: those not excluded. Hand these to the operators of detect."""
    return claims.where("not coalesce(excluded, false)")


def delete_claims(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Tables without the claims in gone (claim_id), their edges and vectors, and what each lost.

    tables: claims (claim_id), contains_claim (chunk_id, claim_id), claim_vectors (claim_id), each if given.
    """
    ids = gone.where("claim_id is not null").select("claim_id").distinct()
    own = [t for t in ("claims", "contains_claim", "claim_vectors") if t in tables]
    left = {**tables, **{t: tables[t].join(ids, "claim_id", "left_anti").select(*tables[t].columns) for t in own}}
    return left, {t: tables[t].join(ids, "claim_id", "left_semi") for t in own}


def delete_source(tables: dict[str, DataFrame], part: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the claims whose source_file contains part, and all that hangs on them alone; and the counts: what, n.

    tables: claims (claim_id, source_file), chunks (chunk_id, source_file), contains_claim (chunk_id, claim_id), documents (doc, source_file), about
    (doc, topic), topics (topic), claim_vectors (claim_id), topic_vectors (topic). Chunks of the source go if no claim is left in
    them, so shared ones stay; its documents lose their topics; topics without any document left go, with their vectors. Rows with null
    source_file stay, and so do claims with a null claim_id but of the source, which go without edges or vectors.
    """
    of = lambda t: F.contains(F.col("source_file"), F.lit(part))
    claims, chunks = tables["claims"], tables["chunks"]
    left, lost = delete_claims({k: tables[k] for k in ("contains_claim", "claim_vectors")}, claims.where(of("claims")).select("claim_id"))
    used = left["contains_claim"].select("chunk_id").distinct()
    orphan = chunks.where(of("chunks")).join(used, "chunk_id", "left_anti")
    docs = tables["documents"].where(of("documents")).select("doc").distinct()
    about = tables["about"].join(docs, "doc", "left_anti").select(*tables["about"].columns)
    held = about.where("topic is not null").select("topic").distinct()
    topics = tables["topics"].join(held, "topic", "left_semi").select(*tables["topics"].columns)
    dead = tables["topics"].join(held, "topic", "left_anti").select("topic").distinct()
    out = {
        **tables, **left, "claims": claims.where(~F.coalesce(of("claims"), F.lit(False))), "chunks": chunks.join(orphan.select("chunk_id"), "chunk_id", "left_anti").select(*chunks.columns),
        "about": about, "topics": topics, "topic_vectors": tables["topic_vectors"].join(dead, "topic", "left_anti").select(*tables["topic_vectors"].columns),
    }
    gone = {
        "claims": claims.where(of("claims")), "chunks": orphan, "embeddings": lost["claim_vectors"], "topic_relationships": tables["about"].join(docs, "doc", "left_semi"),
        "orphaned_topics": tables["topics"].join(held, "topic", "left_anti"), "topic_embeddings": tables["topic_vectors"].join(dead, "topic", "left_semi"),
    }
    counts = None
    for what, df in gone.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        counts = one if counts is None else counts.union(one)
    return out, counts
