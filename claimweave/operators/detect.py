"""Detectors: suppression, coordination and anomaly scores, one row per topic over the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimweave.functions.scoring import cosine, goldfinger, haversine_km, ladder, weighted_mean
from claimweave.functions.vectors import pair_stats

DAY_US = 86_400_000_000


def indicators(claims: DataFrame, lexicon: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """Claims (claim_id, topic, claim_text) that match a category: the first category in order whose
    include terms match and whose exclude terms do not, with its first matching term."""
    text = F.lower("claim_text")
    term = category = None
    for name, include, veto in lexicon:
        first = F.try_element_at(F.filter(F.array(*map(F.lit, include)), lambda w: F.contains(text, w)), F.lit(1))
        out = F.exists(F.array(*map(F.lit, veto)), lambda w: F.contains(text, w)) if veto else F.lit(False)
        hit = F.when(~out, first)
        term = hit if term is None else F.coalesce(term, hit)
        category = F.when(hit.isNotNull(), F.lit(name)) if category is None else F.coalesce(category, F.when(hit.isNotNull(), F.lit(name)))
    return claims.withColumn("category", category).withColumn("term", term).where("category is not null")


SUPPRESSION = {"narrative": 0.40, "meta_density": 0.20, "isolation": 0.15, "avoidance": 0.15, "mismatch": 0.10}


def suppression_score(claims: DataFrame, lexicon, mismatch_words: list[str], weights: dict[str, float] | None = None, min_claims: int = 5) -> DataFrame:
    """Per topic the five signals, the weighted score over those usable, level and confidence.

    claims has claim_id, topic, claim_text, claim_type, n_citations. narrative is D6 over the indicators
    found; mismatch is left out of the mean where it is zero.
    """
    weights = weights or SUPPRESSION
    hits = indicators(claims, lexicon).groupBy("topic").agg(F.count("*").alias("n_indicators"))
    wrong = F.exists(F.array(*map(F.lit, mismatch_words)), lambda w: F.contains(F.lower("claim_text"), w))
    meta, primary = F.count_if(F.col("claim_type") == "META"), F.count_if(F.col("claim_type") == "PRIMARY")
    capped = lambda x: F.when(x.isNotNull(), F.least(x, F.lit(0.8))).otherwise(0.0)  # noqa: E731  least() would skip a null
    base = claims.groupBy("topic").agg(
        F.count("*").alias("n"),
        capped(F.try_divide(1.5 * meta, meta + primary)).alias("meta_density"),
        (0.5 * (1 - F.avg((F.col("n_citations") > 0).cast("int")))).alias("isolation"),
        F.coalesce(F.try_divide(F.count_if((F.col("claim_type") == "META") & (F.col("n_citations") == 0)), meta), F.lit(0.0)).alias("avoidance"),
        capped(2 * F.avg(wrong.cast("int"))).alias("mismatch"),
    )
    rows = base.join(hits, "topic", "left").withColumn("n_indicators", F.coalesce("n_indicators", F.lit(0))).withColumn("narrative", goldfinger(F.col("n_indicators")))
    score = weighted_mean(weights, F.col, lambda k: F.col("mismatch") > 0 if k == "mismatch" else F.lit(True))
    sure = 0.3 * F.least(F.col("n") / (4 * min_claims), F.lit(1.0)) + 0.3 * sum(((F.col(k) > 0).cast("int") for k in weights), F.lit(0)) / len(weights) + 0.4 * F.least(F.col("n_indicators") / 5, F.lit(1.0))
    rounded = [F.round(F.col(k), 6).alias(k) for k in weights]
    level = F.when(F.col("score") >= 0.75, "CRITICAL").when(F.col("score") >= 0.55, "HIGH").when(F.col("score") >= 0.35, "MODERATE").when(F.col("score") >= 0.15, "LOW").otherwise("MINIMAL")
    return rows.select("topic", "n", "n_indicators", *rounded, F.round(score, 6).alias("score"), F.round(sure, 6).alias("confidence")).withColumn("level", level)


def temporal_burst(claims: DataFrame, days: int = 14) -> DataFrame:
    """Per topic the largest number of dates within `days` days of a date, the earliest such window, and its score.

    Counts in a window are differences of running counts, taken by (topic, day) with prefix sums over the days, so
    work grows with the dates and a topic is many tasks' work. Fewer than 3 dates are no data (null score).
    Null dates are left out; a topic without dates, or an empty table, gives no row.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    dates = claims.where("ts is not null").select("topic", "ts", at.alias("us")).groupBy("topic", "us").agg(F.min("ts").alias("ts"), F.count("*").alias("k"))
    ends = dates.select("topic", "us", "ts", "k", F.explode(F.expr(f"array(struct(us as at, k as add, 0 as last), struct(us + {days * DAY_US}L as at, 0L as add, 1 as last))")).alias("m"))
    marks = ends.select("topic", "us", "ts", "k", "m.*").withColumn("day", F.expr(f"at div {DAY_US}"))
    totals = marks.groupBy("topic", "day").agg(F.sum("add").alias("part"))
    base = totals.select("topic", "day", F.coalesce(F.sum("part").over(W.partitionBy("topic").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.sum("add").over(W.partitionBy("topic", "day").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow))
    run = marks.withColumn("within", within).join(base, ["topic", "day"]).withColumn("upto", F.col("base") + F.col("within"))
    counted = run.groupBy("topic", "us").agg(F.first("ts").alias("ts"), F.first("k").alias("k"), (F.max(F.when(F.col("last") == 1, F.col("upto"))) - F.max(F.when(F.col("last") == 0, F.col("upto"))) + F.first("k")).alias("n"))
    best = counted.groupBy("topic").agg(F.max("n").alias("cluster"), F.min_by("ts", F.struct(-F.col("n"), F.col("ts"))).alias("window_start"), F.sum("k").alias("n_dated"))
    scored = best.withColumn("burst_score", F.when(F.col("n_dated") >= 3, burst_score("cluster", "n_dated")))
    return scored.withColumn("burst_ratio", F.round(F.col("cluster") / F.col("n_dated"), 6)).withColumn("burst", F.col("burst_score") >= 0.5)


def burst_score(cluster: str, total: str) -> Column:
    """D20's ladder: by the share of dates in the cluster where it is 0.6 or more, else by size and share."""
    c, r = F.col(cluster), F.col(cluster) / F.col(total)
    most = ladder(c, [(20, 0.9), (10, 0.8), (5, 0.7)], 0.5)
    much = ladder(c, [(30, 0.8), (15, 0.6), (5, 0.5)], 0.3)
    rest = F.when((c >= 50) & (r > 0.3), 0.9).when((c >= 25) & (r > 0.3), 0.8).when((c >= 15) & (r > 0.25), 0.7).when((c >= 10) & (r > 0.2), 0.6).when(c >= 5, 0.4 + r * 0.5).otherwise(0.2 * r)
    return F.round(F.when(r >= 0.8, most).when(r >= 0.6, much).otherwise(rest), 6)


def burst_score_v1(cluster: str, total: str) -> Column:
    """The first version's five steps: by size and share together, else half the share."""
    c, r = F.col(cluster), F.col(cluster) / F.col(total)
    return F.round(F.when((c >= 50) & (r > 0.5), 0.9).when((c >= 30) & (r > 0.4), 0.7).when((c >= 20) & (r > 0.3), 0.5).when((c >= 10) & (r > 0.2), 0.3).otherwise(r * 0.5), 6)


def coordination_v1(signals: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The weighted mean over all signals, null ones as zero; confidence is the share of signals above zero."""
    score = sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    sure = sum((F.coalesce((F.col(k) > 0).cast("int"), F.lit(0)) for k in weights), F.lit(0)) / len(weights)
    return signals.withColumn("score", F.round(score, 6)).withColumn("confidence", F.round(sure, 6))


def burst_members(claims: DataFrame, days: int = 14) -> DataFrame:
    """The claims in each topic's winning window, with the days since the one before."""
    win = temporal_burst(claims, days).select("topic", "window_start")
    inside = claims.join(win, "topic").where((F.col("ts") >= F.col("window_start")) & (F.unix_micros(F.col("ts").cast("timestamp")) <= F.unix_micros(F.col("window_start").cast("timestamp")) + days * DAY_US))
    before = F.lag("claim_id").over(W.partitionBy("topic").orderBy("ts", "claim_id"))
    return inside.select("topic", "claim_id", "ts", before.alias("previous_id"))


def source_centralization(claims: DataFrame) -> DataFrame:
    """Per topic the share of its largest source, distinct sources over claims, the score and whether it is centralized.

    Claims without a source are left out; of equal sources the smallest is the top one.
    """
    per = claims.where("source is not null").groupBy("topic", "source").agg(F.count("*").alias("k"))
    top = per.groupBy("topic").agg(F.max_by("source", F.struct("k", -F.col("source"))).alias("top_source"), F.max("k").alias("top"), F.sum("k").alias("n"), F.count("*").alias("n_sources"))
    share, diversity = F.col("top") / F.col("n"), F.col("n_sources") / F.col("n")
    score = F.when(share > 0.5, 0.8).when(share > 0.3, 0.6).when(diversity < 0.2, 0.5).otherwise(share * 0.5)
    return top.select("topic", "top_source", "n", "n_sources", F.round(share, 6).alias("top_share"), F.round(diversity, 6).alias("diversity"), F.round(score, 6).alias("central_score"), ((share > 0.4) | (diversity < 0.25)).alias("centralized"))


def citation_cartel(edges: DataFrame, source_of: DataFrame) -> DataFrame:
    """Per topic the share of citations that go to the most cited source; under 3 citations no data (null score).

    edges has topic, dst; source_of node, source. Citations of unknown nodes are left out; of equal sources the smallest counts.
    """
    cited = edges.join(source_of.withColumnRenamed("node", "dst"), "dst")
    per = cited.groupBy("topic", "source").agg(F.count("*").alias("k"))
    top = per.groupBy("topic").agg(F.max("k").alias("top"), F.sum("k").alias("n"), F.max_by("source", F.struct("k", -F.col("source"))).alias("top_source"))
    share = F.col("top") / F.col("n")
    score = ladder(share, [(0.6, 0.9), (0.4, 0.6), (0.2, 0.3)], 0.1, strict=True)
    return top.select("topic", F.col("n").alias("n_citations"), F.col("top_source").alias("top_cited"), F.round(share, 6).alias("share"), F.when(F.col("n") >= 3, score).alias("cartel_score"), (share > 0.4).alias("cartel"))


def synchronized_emotion(claims: DataFrame) -> DataFrame:
    """Per topic shares of fear, anger, urgency and intensity, from flags on the claims, and the score.

    The score is the largest of fear with urgency (half the smaller added to the larger), 1.2 fear, 1.3 anger and a
    weighted sum; times 1.5 with two kinds over 0.2, times 1.2 with intensity over 0.5; at most 1. Null flags are false.
    """
    shares = claims.groupBy("topic").agg(*(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(c) for c in ("fear", "anger", "urgency", "intense")))
    blend = F.expr("greatest(greatest(fear, urgency) + 0.5D * least(fear, urgency), 1.2D * fear, 1.3D * anger, 0.35D * fear + 0.35D * anger + 0.2D * urgency + 0.1D * intense)")
    several = F.expr("cast(fear > 0.2 as int) + cast(anger > 0.2 as int) + cast(urgency > 0.2 as int) >= 2")
    score = F.least(F.lit(1.0), blend * F.when(several, 1.5).otherwise(1.0) * F.when(F.col("intense") > 0.5, 1.2).otherwise(1.0))
    return shares.select("topic", *(F.round(c, 6).alias(c) for c in ("fear", "anger", "urgency", "intense")), F.round(score, 6).alias("emotion_score"), (score > 0.4).alias("synchronized"))


COORDINATION = {"burst_score": 0.25, "cartel_score": 0.20, "emotion_score": 0.15, "central_score": 0.15, "language_score": 0.25}


def coordination_score(signals: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The weighted mean of the signals that have data (not null), the share above zero as confidence, severity."""
    score = weighted_mean(weights, lambda k: F.coalesce(F.col(k), F.lit(0.0)), lambda k: F.col(k).isNotNull())
    sure = sum((F.coalesce((F.col(k) > 0).cast("int"), F.lit(0)) for k in weights), F.lit(0)) / 5
    out = signals.withColumn("score", F.round(score, 6)).withColumn("confidence", F.round(F.when(sure > 0, sure).otherwise(0.5), 6))
    return out.withColumn("severity", F.when(F.col("score") >= 0.8, "CRITICAL").when(F.col("score") >= 0.6, "HIGH").when(F.col("score") >= 0.4, "MODERATE").when(F.col("score") >= 0.2, "LOW").otherwise("MINIMAL"))


def language_similarity(vectors: DataFrame) -> DataFrame:
    """Per topic the pairs of vectors from different sources: how many, over 0.85 and over 0.70, mean, largest, and the score.

    vectors has topic, source, embedding. Pairs are counted block by block and never made rows. Rows with a null
    source or vector are left out; a topic without such pairs gives no row (no data).
    """
    got = pair_stats(vectors, [0.85, 0.70])
    high, medium = F.col("over1"), F.col("over2")
    score = F.when(high >= 50, 0.9).when(high >= 20, 0.7).when(high >= 10, 0.5).when(high >= 5, 0.3).when(medium >= 50, 0.5).when(medium >= 20, 0.3).otherwise(F.least("mean", F.lit(0.2)))
    score = F.when(F.col("most") > 0.95, F.least(score + 0.1, F.lit(1.0))).otherwise(score)
    return got.select("topic", "pairs", high.alias("high_pairs"), medium.alias("medium_pairs"), F.round("mean", 6).alias("mean_similarity"), F.round("most", 6).alias("max_similarity"), F.round(score, 6).alias("language_score"))


def language_average(vectors: DataFrame) -> DataFrame:
    """Per topic the mean cosine over pairs from different sources, by sums of unit vectors: no pairs are made.

    vectors has topic, source, embedding of unit length. Sum over cross-source pairs = (|sum|^2 - sum of |source sums|^2) / 2.
    """
    each = vectors.select("topic", "source", F.posexplode("embedding").alias("i", "x"))
    per = each.groupBy("topic", "source", "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    own = per.groupBy("topic").agg(F.sum(F.col("s") * F.col("s")).alias("own"))
    whole = per.groupBy("topic", "i").agg(F.sum("s").alias("s")).groupBy("topic").agg(F.sum(F.col("s") * F.col("s")).alias("whole"))
    n = vectors.groupBy("topic", "source").agg(F.count("*").alias("k")).groupBy("topic").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).cast("long").alias("pairs"))
    return own.join(whole, "topic").join(n, "topic").select("topic", "pairs", F.round(F.try_divide(F.expr("(whole - own) / 2"), F.col("pairs")), 6).alias("mean_similarity"))


def location_pairs(places: DataFrame) -> DataFrame:
    """Pairs of a topic's places with distance, isolation, overlap of their date ranges and the weighted score.

    places has topic, location, lat, lon, first_ts, last_ts, one row per place.
    """
    a, b = places.alias("a"), places.alias("b")
    pairs = a.join(b, (F.col("a.topic") == F.col("b.topic")) & (F.col("a.location") < F.col("b.location")))
    km = haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    miles = km * 0.621371
    isolation = F.coalesce(F.when(miles >= 5000, F.least(0.7 + (miles - 5000) / 10000, F.lit(1.0))).otherwise(miles / 5000 * 0.5), F.lit(0.0))
    overlap = F.when(F.col("a.first_ts").isNull() | F.col("b.first_ts").isNull(), 0.5).when((F.col("a.first_ts") <= F.col("b.last_ts")) & (F.col("b.first_ts") <= F.col("a.last_ts")), 0.8).otherwise(0.3)
    return pairs.select(F.col("a.topic").alias("topic"), F.col("a.location").alias("location1"), F.col("b.location").alias("location2"), F.round(km, 3).alias("km"), F.round(isolation, 6).alias("isolation"), overlap.alias("overlap"), F.round((0.25 * isolation + 0.15 * overlap) / 0.40, 6).alias("pair_score"))


def anomaly_score(pairs: DataFrame, floor: float = 0.3) -> DataFrame:
    """Per topic the best pairs' blend: one alone; 0.6/0.4; or 0.5/0.3/0.2 with the mean of the rest."""
    order = W.partitionBy("topic").orderBy(F.desc("pair_score"), "location1", "location2")
    ranked = pairs.where(F.col("pair_score") > floor).withColumn("rank", F.row_number().over(order))
    got = ranked.groupBy("topic").agg(F.count("*").alias("n_pairs"), F.max(F.when(F.col("rank") == 1, F.col("pair_score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("pair_score"))).alias("s2"), F.avg(F.when(F.col("rank") > 2, F.col("pair_score"))).alias("rest"))
    score = F.when(F.col("n_pairs") == 1, F.col("s1")).when(F.col("n_pairs") == 2, F.expr("0.6 * s1 + 0.4 * s2")).otherwise(F.expr("0.5 * s1 + 0.3 * s2 + 0.2 * rest"))
    return got.select("topic", "n_pairs", F.round(score, 6).alias("score"), F.when(F.col("n_pairs") >= 5, 0.95).when(F.col("n_pairs") >= 3, 0.85).when(F.col("n_pairs") == 2, 0.75).otherwise(0.6).alias("confidence"))


def negated(text: Column, term: str, negations: list[str], reach: int = 50) -> Column:
    """D3: whether a negation stands in the `reach` characters before the term's first place; false without the term."""
    at = F.instr(text, term)
    before = F.substring(text, F.greatest(at - reach, F.lit(1)), at - F.greatest(at - reach, F.lit(1)))
    return F.coalesce((at > 0) & F.exists(F.array(*map(F.lit, negations)), lambda w: F.contains(before, w)), F.lit(False))


def topic_in_claim(text: Column, topic: Column, least: int = 4) -> Column:
    """Whether the text has the whole topic or one of its words of `least` letters or more, in any case."""
    low = F.lower(text)
    words = F.filter(F.split(F.lower(topic), r"[^a-z0-9]+"), lambda w: F.length(w) >= least)
    return F.coalesce(F.contains(low, F.lower(topic)) | F.exists(words, lambda w: F.contains(low, w)), F.lit(False))


def words_between(text: Column, term: str, other: str) -> Column:
    """Number of words from the term's first place to the other's; null unless both occur."""
    a, b = F.instr(text, term), F.instr(text, other)
    lo, hi = F.least(a, b), F.greatest(a, b)
    gap = F.size(F.split(F.substring(text, lo, hi - lo), " ")) - 1
    return F.when((a > 0) & (b > 0), gap)


def service_score(claims: DataFrame, words: list[str]) -> DataFrame:
    """Per topic META density, uncited share, avoidance and indicators among PRIMARY claims, weighted .15 .20 .20 .45, with the level."""
    meta = F.count_if(F.col("claim_type") == "META")
    hit = (F.col("claim_type") == "PRIMARY") & F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("claim_text"), w))
    s = claims.groupBy("topic").agg(
        F.least(2 * meta / F.count("*"), F.lit(1.0)).alias("density"),
        F.avg((F.col("n_citations") == 0).cast("int")).alias("uncited"),
        F.coalesce(F.try_divide(F.count_if((F.col("claim_type") == "META") & (F.col("n_citations") == 0)), meta), F.lit(0.0)).alias("avoidance"),
        F.least(F.count_if(hit) / 5, F.lit(1.0)).alias("indicator"),
    )
    score = F.round(F.expr("0.15D * density + 0.2D * uncited + 0.2D * avoidance + 0.45D * indicator"), 6)
    level = F.when(F.col("score") >= 0.75, "CRITICAL").when(F.col("score") >= 0.55, "HIGH").when(F.col("score") >= 0.35, "MODERATE").when(F.col("score") >= 0.15, "LOW").otherwise("MINIMAL")
    return s.select("topic", *(F.round(c, 6).alias(c) for c in ("density", "uncited", "avoidance", "indicator")), score.alias("score")).withColumn("level", level)


def internal_cartel(edges: DataFrame, group_of: DataFrame) -> DataFrame:
    """Per group mean citations inside and outside over the nodes that make such; a cartel has 5 inside on average and over 70 %.

    edges src, dst; group_of node, grp. Citations of nodes without a group are left out, those to such nodes are outside.
    """
    g = edges.join(group_of.withColumnsRenamed({"node": "src", "grp": "grp"}), "src").join(group_of.withColumnsRenamed({"node": "dst", "grp": "_to"}), "dst", "left")
    inside = F.coalesce(F.col("grp") == F.col("_to"), F.lit(False))
    per = g.groupBy("grp", "src").agg(F.count_if(inside).alias("i"), F.count_if(~inside).alias("o"))
    avg = per.groupBy("grp").agg(F.coalesce(F.avg(F.when(F.col("i") > 0, F.col("i"))), F.lit(0.0)).alias("a"), F.coalesce(F.avg(F.when(F.col("o") > 0, F.col("o"))), F.lit(0.0)).alias("b"))
    ratio = F.coalesce(F.try_divide("a", F.expr("a + b")), F.lit(0.0))
    found = (F.col("a") >= 5) & (ratio > 0.7)
    return avg.select("grp", F.round("a", 6).alias("avg_internal"), F.round("b", 6).alias("avg_external"), F.round(ratio, 6).alias("ratio"), found.alias("detected"), F.round(F.when(found, ratio).otherwise(ratio * 0.5), 6).alias("score"))


def pattern_complexity(claims: DataFrame, by: list[str], levels: list[tuple[float, list[str]]]) -> DataFrame:
    """Per group the score of the highest level with a keyword in any text; levels go from high to low, 0 without a match."""
    low, score = F.lower("claim_text"), F.lit(0.0)
    for value, words in reversed(levels):
        score = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(float(value))).otherwise(score)
    return claims.groupBy(*by).agg(F.max(score).alias("complexity"))


def semantic_indicators(claims: DataFrame, patterns: DataFrame, threshold: float = 0.70) -> DataFrame:
    """claim_id, category, similarity: the category with the include pattern nearest to a claim's vector, at least the threshold; a claim as near to an exclude pattern of it is vetoed.

    claims: claim_id, embedding; patterns: category, kind (include, exclude), embedding, a lexicon of bounded size (refused over 10,000 rows).
    """
    if patterns.limit(10_001).count() > 10_000:
        raise ValueError("the pattern lexicon has over 10,000 rows")
    met = claims.select("claim_id", "embedding").crossJoin(F.broadcast(patterns.select("category", "kind", F.col("embedding").alias("_p")))).withColumn("s", cosine("embedding", "_p"))
    per = met.groupBy("claim_id", "category").agg(F.max(F.when(F.col("kind") == "include", F.col("s"))).alias("yes"), F.max(F.when(F.col("kind") == "exclude", F.col("s"))).alias("no"))
    good = per.where((F.col("yes") >= threshold) & (F.coalesce("no", F.lit(-1.0)) < threshold))
    return good.groupBy("claim_id").agg(F.min_by("category", F.struct(-F.col("yes"), F.col("category"))).alias("category"), F.round(F.max("yes"), 5).alias("similarity"))


def suppression_v1(claims: DataFrame, cites: DataFrame, dismissal: list[str], emotional: list[str], mismatch: list[str]) -> DataFrame:
    """Per topic the first version's five signals and their score, weighted .15 .15 .10 .30 .30.

    meta: 0.6 of the META share plus 0.4 of META claims with a dismissal word; isolation: citations that leave the topic over
    all; avoidance: META claims without citation over META; shares of claims with an emotional or a mismatch word. Nothing
    to divide by gives 0. claims: claim_id, topic, claim_text, claim_type, n_citations; cites: topic, src, dst.
    """
    low = F.lower("claim_text")
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    is_meta = F.col("claim_type") == "META"
    meta, n = F.count_if(is_meta), F.count("*")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base = claims.groupBy("topic").agg(
        (0.6 * meta / n + 0.4 * zero(F.try_divide(F.count_if(is_meta & has(dismissal)), meta))).alias("meta"), zero(F.try_divide(F.count_if(is_meta & (F.col("n_citations") == 0)), meta)).alias("avoidance"),
        (F.count_if(has(emotional)) / n).alias("emotional"), (F.count_if(has(mismatch)) / n).alias("mismatch"),
    )
    out = cites.join(claims.select(F.col("claim_id").alias("dst"), F.col("topic").alias("_to")), "dst").groupBy("topic").agg((F.count_if(F.col("topic") != F.col("_to")) / F.count("*")).alias("isolation"))
    full = base.join(out, "topic", "left").withColumn("isolation", zero(F.col("isolation")))
    score = F.expr("0.15D * meta + 0.15D * isolation + 0.1D * avoidance + 0.3D * emotional + 0.3D * mismatch")
    return full.select("topic", *(F.round(c, 6).alias(c) for c in ("meta", "isolation", "avoidance", "emotional", "mismatch")), F.round(score, 6).alias("score"))


def location_groups(claims: DataFrame, locations: str = "locations") -> DataFrame:
    """Per topic and place its claims, mean latitude and longitude, first and last date. locations: array<struct<name, lat, lon>>; places without a name go."""
    each = claims.select("topic", "claim_id", "ts", F.explode(locations).alias("l")).where("l.name is not null")
    return each.groupBy("topic", F.col("l.name").alias("location")).agg(F.count("*").alias("n_claims"), F.round(F.avg("l.lat"), 6).alias("lat"), F.round(F.avg("l.lon"), 6).alias("lon"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# The words of each culture, in order, and the contact of pairs of cultures.
CULTURES = {"egyptian": ["egypt", "cairo", "nile", "pharaoh"], "greek": ["greece", "athens", "sparta", "delphi"], "roman": ["rome", "italy", "roman"], "mesopotamian": ["mesopotamia", "babylon", "sumerian", "iraq"], "chinese": ["china", "chinese", "beijing", "yellow river"], "indian": ["india", "indian", "indus", "ganges"], "mesoamerican": ["mexico", "maya", "aztec", "olmec", "teotihuacan"], "andean": ["peru", "inca", "bolivia", "andes", "titicaca"], "polynesian": ["hawaii", "tahiti", "samoa", "easter island"], "persian": ["persia", "iran", "persian"]}
CONTACTS = {("greek", "roman"): 0.9, ("egyptian", "greek"): 0.7, ("mesopotamian", "egyptian"): 0.6, ("chinese", "mongolian"): 0.8, ("indian", "chinese"): 0.5, ("persian", "greek"): 0.6, ("roman", "egyptian"): 0.7, ("mesoamerican", "egyptian"): 0.0, ("andean", "egyptian"): 0.0, ("mesoamerican", "mesopotamian"): 0.0, ("andean", "mesopotamian"): 0.0, ("polynesian", "andean"): 0.1}


def culture(*texts: Column, cultures: dict[str, list[str]] | None = None) -> Column:
    """The first culture in order with a word in the first text that has any; unknown otherwise."""
    def first(text):
        out = F.lit(None).cast("string")
        for name, words in reversed((cultures or CULTURES).items()):
            out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w)), name).otherwise(out)
        return out

    return F.coalesce(*map(first, texts), F.lit("unknown"))


def cultural_isolation(one: Column, other: Column, contacts: dict[tuple[str, str], float] | None = None) -> Column:
    """1 less the contact of two cultures, in either order; pairs not listed have 0.3."""
    level = F.lit(0.3)
    for (a, b), x in (contacts or CONTACTS).items():
        level = F.when(((one == a) & (other == b)) | ((one == b) & (other == a)), x).otherwise(level)
    return F.round(1 - level, 6)


def place_similarity(vectors: DataFrame) -> DataFrame:
    """Topic, location1, location2, mean_similarity, similarity_score of each pair of a topic's places.

    The mean cosine of cross pairs is the product of the places' mean unit vectors, so a place is one vector. Score: 0.95 over
    0.85, 0.8 over 0.75, 0.6 over 0.65, else half the mean. vectors: topic, location, embedding of unit length.
    """
    n = vectors.groupBy("topic", "location").agg(F.count("*").alias("k"))
    sums = vectors.select("topic", "location", F.posexplode("embedding").alias("i", "x")).groupBy("topic", "location", "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    mean = sums.join(n, ["topic", "location"]).select("topic", "location", "i", (F.col("s") / F.col("k")).alias("s"))
    a, b = mean.withColumnsRenamed({"location": "location1", "s": "s1"}), mean.withColumnsRenamed({"location": "location2", "s": "s2"})
    got = a.join(b, ["topic", "i"]).where("location1 < location2").groupBy("topic", "location1", "location2").agg(F.sum(F.expr("s1 * s2")).alias("m"))
    score = F.when(F.col("m") > 0.85, 0.95).when(F.col("m") > 0.75, 0.8).when(F.col("m") > 0.65, 0.6).otherwise(F.col("m") * 0.5)
    return got.select("topic", "location1", "location2", F.round("m", 6).alias("mean_similarity"), F.round(score, 6).alias("similarity_score"))
