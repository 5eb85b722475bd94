"""Topic traversal, evidence around claims and summaries of result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _any_of(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if words else F.lit(False)


def search_any_word(claims: DataFrame, words: list[str], most: int = 5, longer: int = 3) -> DataFrame:
    """Claims that contain one of the first `most` query words of more than `longer` letters, in any case."""
    chosen = [w.lower() for w in words if len(w) > longer][:most]
    return claims.where(_any_of(F.lower("claim_text"), chosen))


def topics_all_words(names: DataFrame, name: str, q: str) -> DataFrame:
    """Names that contain every query word of more than two letters; hyphens count as spaces."""
    words = [w for w in q.lower().replace("-", " ").split() if len(w) > 2]
    hit = F.lit(bool(words))
    for w in words:
        hit = hit & F.contains(F.replace(F.lower(name), F.lit("-"), F.lit(" ")), F.lit(w))
    return names.where(hit)


def claims_via_topics(claims: DataFrame, about: DataFrame, topics: list[str], dated: bool = False) -> DataFrame:
    """Each claim once whose source is about one of the topics; dated: only claims with a date."""
    sources = about.where(F.col("topic").isin(topics)).select("source").distinct()
    return (claims.where("ts is not null") if dated else claims).join(sources, "source", "left_semi")


def claims_via_topics_hybrid(claims: DataFrame, about: DataFrame, topics: list[str], q: str, stop: list[str]) -> DataFrame:
    """R10 for claims that also hold a whole query word of three letters or more that is no stop word."""
    words = sorted({w for w in q.lower().split() if len(w) >= 3 and w.isalnum()} - set(stop))
    found = claims_via_topics(claims, about, topics)
    return found.where(F.rlike(F.lower("claim_text"), F.lit(rf"\b({'|'.join(words)})\b"))) if words else found


def context_stats(results: DataFrame, by: list[str], words: list[str], mainstream: Column) -> DataFrame:
    """Per result set the mean trust, rows of either perspective, the share of META rows with a dismissal word and its label."""
    hit = (F.col("claim_type") == "META") & _any_of(F.lower("claim_text"), words)
    share = F.avg(F.coalesce(hit, F.lit(False)).cast("int"))
    label = F.when(share > 0.3, "high").when(share > 0.1, "moderate").otherwise("none")
    return results.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_trust"), F.count_if(mainstream).alias("n_mainstream"), F.count_if(~mainstream).alias("n_alternative"), F.round(share, 6).alias("dismissal_share"), label.alias("label"))


def search_confidence(results: DataFrame, by: list[str], entity: str) -> DataFrame:
    """Per result set 0.3 min(n / 20, 1) + 0.5 mean trust + 0.2 min(distinct entities / 5, 1)."""
    mean = F.sum(F.col("confidence").cast("decimal(20,6)")).cast("double") / F.count("confidence")  # an exact sum, in any order
    score = 0.3 * F.least(F.count("*") / 20, F.lit(1.0)) + 0.5 * mean + 0.2 * F.least(F.count_distinct(entity) / 5, F.lit(1.0))
    return results.groupBy(*by).agg(F.round(score, 6).alias("search_confidence"))


def top_sources(results: DataFrame, entity: str, top: int = 5, cut: int = 100) -> DataFrame:
    """The best claim of each entity, of these the `top` best, texts cut at `cut` characters. Ties: smallest claim_id."""
    best = results.groupBy(entity).agg(F.max(F.struct("confidence", (-F.col("claim_id")).alias("_o"), "claim_text")).alias("b"))
    rows = best.select(entity, (-F.col("b._o")).alias("claim_id"), F.col("b.confidence").alias("confidence"), F.substring("b.claim_text", 1, cut).alias("excerpt"))
    return rows.orderBy(F.desc("confidence"), "claim_id").limit(top)


def claim_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node the sorted sets it cites and is cited by, with their sizes. Nodes without citations have empty sets."""
    cites = edges.where("rel_type = 'CITES'").select("src", "dst").distinct()
    out = cites.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("cites"))
    back = cites.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_list("src")).alias("cited_by"))
    none = F.array().cast(out.schema["cites"].dataType)
    both = nodes.select("node").join(out, "node", "left").join(back, "node", "left")
    full = both.select("node", F.coalesce("cites", none).alias("cites"), F.coalesce("cited_by", none).alias("cited_by"))
    return full.withColumn("n_cites", F.size("cites")).withColumn("n_cited_by", F.size("cited_by"))


def _mean(which) -> F.Column:
    return F.round(F.try_divide(F.sum(F.when(which, F.col("trust").cast("decimal(20,6)"))).cast("double"), F.count_if(which)), 6)


def claim_evidence(edges: DataFrame, trust: DataFrame) -> DataFrame:
    """Per node how many support and contradict it and their mean trust; unknown trust counts as 0.5, no evidence as null.

    Trusts are summed as decimals of 6 digits, so a mean hangs on no order of adding.
    """
    e = edges.where("rel_type in ('SUPPORTS', 'CONTRADICTS')").join(trust.select(F.col("node").alias("src"), "trust"), "src", "left").withColumn("trust", F.coalesce("trust", F.lit(0.5)))
    pro, anti = F.col("rel_type") == "SUPPORTS", F.col("rel_type") == "CONTRADICTS"
    return e.groupBy(F.col("dst").alias("node")).agg(F.count_if(pro).alias("n_supporting"), F.count_if(anti).alias("n_contradicting"), _mean(pro).alias("supporting_trust"), _mean(anti).alias("contradicting_trust"))


def claim_type_counts(claims: DataFrame, kinds: list[str]) -> DataFrame:
    """A3: per topic one count for each claim type named."""
    return claims.groupBy("topic").agg(*(F.count_if(F.col("claim_type") == k).alias(f"n_{k.lower()}") for k in kinds))


def system_status(claims: DataFrame, vectors: DataFrame, least: int = 1) -> DataFrame:
    """A4: one row with what the detectors need and whether each can run."""
    a = claims.agg(F.count("*").alias("n_claims"), F.count_if(F.col("n_citations") > 0).alias("n_cited"), F.count("ts").alias("n_dated"))
    both = a.crossJoin(F.broadcast(vectors.agg(F.count("*").alias("n_vectors"))))  # one row each
    return both.withColumn("suppression_ready", (F.col("n_claims") >= least) & (F.col("n_cited") >= least)).withColumn("coordination_ready", (F.col("n_dated") >= least) & (F.col("n_vectors") >= least))


def recommend_profile(topics: DataFrame, text: str, keywords: list[tuple[str, list[str]]], otherwise: str = "default") -> DataFrame:
    """The first profile in order with a keyword in the topic, at confidence 0.7; the default at 0.5."""
    name, low = F.lit(None).cast("string"), F.lower(text)
    for profile, words in reversed(keywords):
        name = F.when(_any_of(low, words), profile).otherwise(name)
    return topics.withColumn("profile", F.coalesce(name, F.lit(otherwise))).withColumn("profile_confidence", F.when(name.isNotNull(), 0.7).otherwise(0.5))


def validate_profiles(profiles: DataFrame, slack: float = 0.01) -> DataFrame:
    """A10: name, signal_weights map -> the sum, the largest weight after normalisation, error codes. An empty map has sum 0."""
    values = F.map_values("signal_weights")
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    errors = F.array_compact(F.array(F.when(F.abs(total - 1) > slack, F.lit("weight_sum")), F.when(F.exists(values, lambda x: x < 0), F.lit("negative_weight")), F.when(F.size(values) == 0, F.lit("no_weights"))))
    return profiles.select("name", F.round(total, 6).alias("weight_sum"), F.round(F.try_divide(F.array_max(values), total), 6).alias("top_weight"), F.array_join(errors, ",").alias("errors"))


def synthesize_claims(edges: DataFrame, min_degree: int = 3, top_entities: int = 100, top_edges: int = 5) -> DataFrame:
    """T25: "A verb B" for the strongest edges of the best-connected nodes."""
    degree = edges.groupBy("src").agg(F.count("*").alias("degree")).where(F.col("degree") >= min_degree).orderBy(F.desc("degree"), "src").limit(top_entities)
    best = W.partitionBy("src").orderBy(F.desc("weight"), "dst")
    kept = edges.where("weight > 1").join(F.broadcast(degree), "src").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_edges)
    return kept.select("src", "dst", "rank", F.concat_ws(" ", F.col("src").cast("string"), F.lower("rel_type"), F.col("dst").cast("string")).alias("claim_text"))


def seed_sources(documents: DataFrame, author: str, top: int = 20) -> DataFrame:
    """Authors of more than one document, the `top` most productive, with initial trust 0.5."""
    n = documents.where(F.col(author).isNotNull()).groupBy(author).agg(F.count("*").alias("n_documents")).where("n_documents > 1")
    return n.orderBy(F.desc("n_documents"), author).limit(top).withColumn("initial_trust", F.lit(0.5))


def build_citations(claims: DataFrame, doc: str, seq: str, most: int = 5) -> DataFrame:
    """T27, first phase: each claim refers to the `most` claims before it in its document: no pairs of a whole document are made."""
    order = W.partitionBy(doc).orderBy(seq, "claim_id").rowsBetween(-most, -1)
    near = claims.select("claim_id", F.collect_list("claim_id").over(order).alias("before"))
    return near.select(F.col("claim_id").alias("src"), F.explode("before").alias("dst"))


def validate_claims(raw: DataFrame, kinds: list[str], least: int = 20, floor: float = 0.5, otherwise: str = "PRIMARY") -> DataFrame:
    """Claims of `least` characters or more and enough confidence; types in upper case, unknown or missing ones take the default.

    Missing confidence counts as the floor; null texts go.
    """
    kind = F.upper(F.trim("claim_type"))
    good = raw.where((F.length(F.trim("claim_text")) >= least) & (F.coalesce("confidence", F.lit(floor)) >= floor))
    return good.withColumn("claim_type", F.when(kind.isin(kinds), kind).otherwise(otherwise)).withColumn("confidence", F.coalesce("confidence", F.lit(floor)))
