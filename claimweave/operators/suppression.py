"""D6, D11, D12 by profile: suppression of each topic's active claims, with what the score is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimweave.functions.scoring import goldfinger, weighted_mean
from claimweave.operators.detect import SUPPRESSION, indicators, suppression_score
from claimweave.operators.manage import active

# The levels of a score where a profile names none, and the linear mode of D6.
LEVELS = {"critical": 0.75, "high": 0.55, "moderate": 0.35, "low": 0.15}
LINEAR_STEP, LINEAR_MOST = 0.1, 0.95
SCORING = {"happenstance_max": "happenstance", "coincidence_max": "coincidence", "enemy_action_base": "base", "logarithmic_factor": "factor", "max_score": "most"}


def narrative(n: F.Column, scoring: dict | None = None) -> F.Column:
    """The score of n indicators by a profile's scoring: goldfinger with its bounds, or linear."""
    scoring = scoring or {}
    if scoring.get("mode") == "linear":
        return F.least(n * LINEAR_STEP, F.lit(LINEAR_MOST))
    return goldfinger(n, **{own: scoring[name] for name, own in SCORING.items() if scoring.get(name) is not None})


def normalised(weights: dict[str, float], slack: float = 0.01) -> dict[str, float]:
    """Weights that sum to 1, divided by their sum if that is further off than slack; a sum of 0 is refused."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must sum to more than 0")
    return {k: v / total for k, v in weights.items()} if abs(total - 1) > slack else dict(weights)


def report(claims: DataFrame, lexicon: list[tuple[str, list[str], list[str]]], mismatch_words: list[str], profile: dict | None = None, samples: int = 20) -> DataFrame:
    """Topic, n, n_indicators, the five signals, score, confidence, level, categories, contributions, sample_claims.

    profile may have signal_weights, score_levels, scoring and min_claims. Excluded claims are left out, where claims have
    `excluded`. Signals are rounded to 6 digits before they are weighed. categories maps each category to its indicators;
    contributions are the two signals that add most to the score, ties by name; sample_claims are the first `samples` claims with
    indicators, by claim_id. Topics whose claims are all excluded are absent; null texts have no
    words, and a signal without any claim to tell it is 0; no claims, no rows.
    """
    profile = profile or {}
    weights, least = normalised(profile.get("signal_weights") or SUPPRESSION), profile.get("min_claims") or 5
    if extra := set(weights) - set(SUPPRESSION):
        raise ValueError(f"unknown signals: {sorted(extra)}")
    weights = {k: weights.get(k, 0.0) for k in SUPPRESSION}
    own = active(claims) if "excluded" in claims.columns else claims
    base = suppression_score(own, lexicon, mismatch_words, weights, least).drop("level", "score").fillna(0.0)
    base = base.withColumn("narrative", F.round(narrative(F.col("n_indicators"), profile.get("scoring")), 6))
    usable = lambda k: F.col("mismatch") > 0 if k == "mismatch" else F.lit(True)
    base = base.withColumn("score", F.round(weighted_mean(weights, F.col, usable), 6))
    level = F.lit("MINIMAL")
    for name in ("low", "moderate", "high", "critical"):
        level = F.when(F.col("score") >= {**LEVELS, **(profile.get("score_levels") or {})}[name], name.upper()).otherwise(level)
    parts = F.array(*(F.struct((-F.round(F.lit(w) * F.col(k), 6)).alias("o"), F.lit(k).alias("signal")) for k, w in weights.items()))
    best = F.transform(F.slice(F.array_sort(F.filter(parts, lambda x: x.o < 0)), 1, 2), lambda x: F.struct(x.signal.alias("signal"), (-x.o).alias("contribution")))
    found = indicators(own, lexicon)
    kinds = found.groupBy("topic", "category").agg(F.count("*").alias("k")).groupBy("topic").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "k")))).alias("categories"))
    first = found.where("claim_id is not null").withColumn("rank", F.row_number().over(W.partitionBy("topic").orderBy("claim_id", "category", "term"))).where(F.col("rank") <= samples)
    first = first.groupBy("topic").agg(F.expr("transform(array_sort(collect_list(struct(rank, claim_id, category, term))), x -> struct(x.claim_id, x.category, x.term))").alias("sample_claims"))
    full = base.withColumn("level", level).withColumn("contributions", best).join(kinds, "topic", "left").join(first, "topic", "left")
    return full.select("topic", "n", "n_indicators", *SUPPRESSION, "score", "confidence", "level", "categories", "contributions", "sample_claims")
