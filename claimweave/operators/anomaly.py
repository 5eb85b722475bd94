"""D35, D37, D38 in full: five signals for every pair of a topic's places, from one summary a place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimweave.functions.scoring import dot, haversine_km
from claimweave.functions.tables import discard, written
from claimweave.operators.detect import CULTURES, cultural_isolation

# The weights of the signals, the score and the words of each level of complexity, the steps of severity.
WEIGHTS = {"geographic": 0.25, "temporal": 0.15, "cultural": 0.25, "complexity": 0.20, "similarity": 0.15}
COMPLEXITY = {
    0.2: ["fire", "tool", "shelter", "clothing", "pottery", "agriculture", "domestication", "hunting", "gathering"],
    0.5: ["metallurgy", "writing", "astronomy", "navigation", "architecture", "irrigation", "calendar", "mathematics"],
    0.8: ["pyramid", "megalith", "precision", "astronomical alignment", "advanced metallurgy", "complex calendar", "sophisticated mathematics", "precision engineering", "acoustic properties", "magnetic alignment"],
    0.95: ["seven-element narrative", "identical ritual", "advanced astronomy", "precision stone cutting", "anti-seismic", "acoustic resonance", "megalithic precision", "astronomical alignment precision"],
}
SEVERITY = [(0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MODERATE"), (0.2, "LOW")]
MOST_SIMILAR = 0.95  #: the highest similarity score there is


def complexity(text: F.Column, levels: dict[float, list[str]] | None = None) -> F.Column:
    """The score of the highest level with a word in the text, in any case; 0 without one."""
    out, low = F.lit(0.0), F.lower(text)
    for value, words in sorted((levels or COMPLEXITY).items()):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(value)).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def _culture_of(text: F.Column, cultures: dict[str, list[str]]) -> F.Column:
    out, low = F.lit(None).cast("string"), F.lower(text)
    for name, words in reversed(cultures.items()):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(name)).otherwise(out)
    return out


def place_summaries(claims: DataFrame, vectors: DataFrame, cultures: dict[str, list[str]] | None = None, levels: dict[float, list[str]] | None = None) -> DataFrame:
    """topic, location, n_claims, lat, lon, first_ts, last_ts, culture, complexity, n_vectors, mean: one row for each place of a topic.

    claims: claim_id, topic, claim_text, ts, locations (array<struct<name, lat, lon>>); vectors: claim_id, embedding. The place's
    culture is that of its name, else of the first of its first 3 claims, by claim_id, that has one, else unknown. mean is the mean of its
    claims' vectors at length 1. A claim that names a place twice counts once there; places without a name and null topics go.
    """
    cultures = cultures or CULTURES
    each = claims.select("claim_id", "topic", "claim_text", "ts", F.explode("locations").alias("l")).where("l.name is not null and l.name <> '' and topic is not null")
    each = each.groupBy("topic", F.col("l.name").alias("location"), "claim_id").agg(F.first("claim_text").alias("claim_text"), F.min("ts").alias("ts"), F.avg("l.lat").alias("lat"), F.avg("l.lon").alias("lon"))
    each = written(each.select("topic", "location", "claim_id", "ts", "lat", "lon", _culture_of(F.col("claim_text"), cultures).alias("told"), complexity(F.col("claim_text"), levels).alias("complexity")), "claims")
    base = each.groupBy("topic", "location").agg(
        F.count("*").alias("n_claims"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("complexity").alias("complexity"),
    )
    early = each.withColumn("rank", F.row_number().over(W.partitionBy("topic", "location").orderBy("claim_id"))).where("rank <= 3 and told is not null")
    told = early.groupBy("topic", "location").agg(F.min_by("told", "rank").alias("told"))
    v = vectors.where("embedding is not null").dropDuplicates(["claim_id"]).select("claim_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("size", F.sqrt(dot("e", "e"))).where("size > 0")
    parts = each.select("topic", "location", "claim_id").join(v, "claim_id").select("topic", "location", F.posexplode(F.expr("transform(e, x -> x / size)")).alias("i", "x"))
    sums = parts.groupBy("topic", "location", "i").agg(F.sum("x").alias("s"), F.count("*").alias("k"))
    mean = sums.groupBy("topic", "location").agg(F.max("k").alias("n_vectors"), F.array_sort(F.collect_list(F.struct("i", "s", "k"))).alias("m")).select("topic", "location", "n_vectors", F.expr("transform(m, x -> x.s / x.k)").alias("mean"))
    full = base.join(told, ["topic", "location"], "left").join(mean, ["topic", "location"], "left")
    culture = F.coalesce(_culture_of(F.col("location"), cultures), "told", F.lit("unknown"))
    return full.select("topic", "location", "n_claims", "lat", "lon", "first_ts", "last_ts", culture.alias("culture"), "complexity", F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"), "mean")


def anomalous_pairs(places: DataFrame, floor: float = 0.3) -> DataFrame:
    """Topic, location1, location2, the five signals and pair_score of the pairs of a topic's places that score over the floor.

    Distance, dates, cultures and complexity are numbers of both places; with the highest similarity there is they bound the score, and only
    pairs whose bound is over the floor are joined with vectors. places as place_summaries() gives them. Places without
    coordinates have no distance (0), without dates 0.5, and pairs without vectors on either side a similarity of 0.5.
    """
    places = written(places, "places")
    side = places.drop("mean")
    a, b = side.alias("a"), side.alias("b")
    pairs = a.join(b, (F.col("a.topic") == F.col("b.topic")) & (F.col("a.location") < F.col("b.location")))
    miles = haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) * 0.621371
    far = F.coalesce(F.when(miles >= 5000, F.least(0.7 + (miles - 5000) / 10000, F.lit(1.0))).otherwise(miles / 5000 * 0.5), F.lit(0.0))
    dated = F.col("a.first_ts").isNotNull() & F.col("b.first_ts").isNotNull()
    at_once = (F.col("a.first_ts") <= F.col("b.last_ts")) & (F.col("b.first_ts") <= F.col("a.last_ts"))
    temporal = F.when(~dated, 0.5).when(at_once, 0.8).otherwise(0.3)
    known = (F.col("a.n_vectors") > 0) & (F.col("b.n_vectors") > 0)
    scored = pairs.select(
        F.col("a.topic").alias("topic"), F.col("a.location").alias("location1"), F.col("b.location").alias("location2"), far.alias("geographic"), temporal.alias("temporal"),
        cultural_isolation(F.col("a.culture"), F.col("b.culture")).alias("cultural"), F.greatest("a.complexity", "b.complexity").alias("complexity"), known.alias("known"),
    )
    cheap = "0.25D * geographic + 0.15D * temporal + 0.25D * cultural + 0.2D * complexity"
    scored = written(scored.where(F.expr(f"{cheap} + 0.15D * if(known, {MOST_SIMILAR}D, 0.5D)") > floor), "pairs")
    mean = lambda end, m: places.select("topic", F.col("location").alias(end), F.col("mean").alias(m))
    near = scored.where("known").join(mean("location1", "m1"), ["topic", "location1"]).join(mean("location2", "m2"), ["topic", "location2"]).withColumn("s", dot("m1", "m2"))
    ladder = F.expr("case when s >= 0.85 then 0.95D when s >= 0.75 then 0.8D when s >= 0.65 then 0.6D else s * 0.5D end")
    cut = ["topic", "location1", "location2", "geographic", "temporal", "cultural", "complexity"]
    both = near.select(*cut, ladder.alias("similarity")).union(scored.where("not known").select(*cut, F.lit(0.5)))
    out = both.withColumn("pair_score", F.expr(f"{cheap} + 0.15D * similarity")).where(F.col("pair_score") > floor)
    six = lambda c: F.round(c, 6).alias(c)
    done = written(out.select("topic", "location1", "location2", *(six(c) for c in [*cut[3:], "similarity", "pair_score"])), "scored")
    discard(places, scored)
    return done


def anomaly_report(pairs: DataFrame, claims: DataFrame, limit: int = 100) -> DataFrame:
    """Topic, n_pairs, score, confidence, severity, top_location1, top_location2, top_score, sample_claims.

    The score blends the best pairs: one alone, 0.6 and 0.4 of two, or 0.5, 0.3 and 0.2 of the mean of the rest. sample_claims are
    the first claims, by claim_id, of the places of the best pairs, from the best on, each once: limit / 20 of a place (3 at least), of limit / 5 pairs
    (10 at least), limit in all. Ties go by places. claims as in place_summaries().
    """
    order = W.partitionBy("topic").orderBy(F.desc("pair_score"), "location1", "location2")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    of = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    got = ranked.groupBy("topic").agg(F.count("*").alias("n_pairs"), of(1, "pair_score").alias("top_score"), of(2, "pair_score").alias("s2"), F.sum(F.when(F.col("rank") > 2, F.col("pair_score").cast("decimal(20,6)"))).alias("rest"), of(1, "location1").alias("top_location1"), of(1, "location2").alias("top_location2"))
    score = F.round(F.when(F.col("n_pairs") == 1, F.col("top_score")).when(F.col("n_pairs") == 2, F.expr("0.6D * top_score + 0.4D * s2")).otherwise(F.expr("0.5D * top_score + 0.3D * s2 + 0.2D * cast(rest as double) / (n_pairs - 2)")), 6)
    confidence = F.when(F.col("n_pairs") >= 5, 0.95).when(F.col("n_pairs") >= 3, 0.85).when(F.col("n_pairs") == 2, 0.75).otherwise(0.6)
    severity = F.lit("MINIMAL")
    for bound, name in reversed(SEVERITY):
        severity = F.when(F.col("score") >= bound, name).otherwise(severity)
    spots = ranked.where(F.col("rank") <= max(10, limit // 5)).select("topic", F.posexplode(F.array("location1", "location2")).alias("side", "location"), "rank").groupBy("topic", "location").agg(F.min(F.struct("rank", "side")).alias("spot"))
    each = claims.where("claim_id is not null").select("claim_id", "topic", F.explode("locations").alias("l")).select("topic", F.col("l.name").alias("location"), "claim_id").distinct()
    first = each.join(spots, ["topic", "location"]).withColumn("place", F.row_number().over(W.partitionBy("topic", "location").orderBy("claim_id"))).where(F.col("place") <= max(3, limit // 20))
    once = first.groupBy("topic", "claim_id").agg(F.min(F.struct("spot", "place")).alias("at"))
    kept = once.withColumn("n", F.row_number().over(W.partitionBy("topic").orderBy("at", "claim_id"))).where(F.col("n") <= limit)
    samples = kept.groupBy("topic").agg(F.expr("transform(array_sort(collect_list(struct(n, claim_id))), x -> x.claim_id)").alias("sample_claims"))
    full = got.withColumn("score", score).withColumn("confidence", confidence).withColumn("severity", severity).join(samples, "topic", "left")
    return full.select("topic", "n_pairs", "score", "confidence", "severity", "top_location1", "top_location2", "top_score", "sample_claims")
