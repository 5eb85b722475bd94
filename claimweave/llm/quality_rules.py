"""Quality rules with risk-controlled thresholds (operator 6). DataFrame functions only.

Base counts are taken of every whole text. Texts that pass the base limits are then held against
ratio rules ("reject above the cutoff"). Cutoffs are chosen per stratum (language) from labelled
holdout texts: a cutoff of a rule is admissible if the exact binomial test rejects "this rule rejects
more than the risk's share of good texts of this stratum" at the level divided by all tests made
(Bonferroni over strata, rules and cutoffs). With probability 1 - level, every chosen cutoff therefore
keeps its promise at once, and a stratum loses at most risk of its good texts, as each of the R rules
gets risk / R. A trial is one distinct doc_id and text, however many rows repeat it. Equal or near texts under
ids of their own count each: the promise is as good as the labelled documents are independent. Of the admissible cutoffs the one that rejects most bad texts is taken, the laxest of
equals, and none where no bad text would go or too few texts are labelled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import SPACES, text_id, written

RISK = 0.05
LEVEL = 0.05
#: Candidate cutoffs of each ratio, and the expressions of the ratios.
RULES = {
    "symbols": ("n_symbols / n_words", [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7]),
    "repeats": ("n_repeat_words / n_words", [0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.18]),
    "capitals": ("n_capitals / greatest(word_chars, 1)", [0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7]),
    "shouts": ("n_shouts / n_words", [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8]),
    "long_words": ("word_chars / n_words", [7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0]),
}
MOST_BROADCAST = 50_000  #: cutoffs sent to every task; more are joined as the planner sees fit
_COUNTED = {"n_symbols": "[A-Z!]+", "n_capitals": "[^A-Z]+", "n_shouts": "[^!]+"}  #: what to strip from the marks of a text


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_shouts, base_failed, and x1 and x2, which stand for the text."""
    docs = docs.select("*", *text_id())
    keep = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    marks = F.regexp_replace(text, r"[^#*$%&|<>!A-Z]+", "")
    first = docs.select(*keep, words.alias("ws"), lines.alias("ls"), marks.alias("marks"))
    hashes = "case when size(ws) < 5 then cast(array() as array<bigint>) else transform(slice(ws, 1, size(ws) - 4), (w, i) -> xxhash64(w, ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4])) end"
    counted = [F.length(F.regexp_replace("marks", off, "")).alias(c) for c, off in _COUNTED.items()]
    second = first.select(*keep, *counted, F.length(F.array_join("ws", "")).alias("word_chars"), F.size("ws").alias("n_words"), F.size("ls").alias("n_lines"), (F.size("ls") - F.size(F.array_distinct("ls"))).alias("n_dup_lines"), F.expr(hashes).alias("hs"))
    # positions of windows that occur again: only texts that have any sort their (hash, position) pairs
    pairs = "array_sort(transform(hs, (h, i) -> struct(h as h, i as i)))"
    third = second.withColumn("ps", F.expr(f"if(size(array_distinct(hs)) < size(hs), {pairs}, null)"))
    # in hash order, a window is repeated if a neighbour has its hash
    spots = "array_sort(transform(filter(ps, (x, k) -> (k > 0 and element_at(ps, greatest(k, 1)).h = x.h) or (k < size(ps) - 1 and element_at(ps, least(k + 2, size(ps))).h = x.h)), x -> x.i))"
    fourth = third.withColumn("at", F.expr(f"if(ps is null, null, {spots})"))
    covered = "if(at is null, 0, 5 + aggregate(transform(slice(at, 1, size(at) - 1), (p, k) -> least(5, element_at(at, k + 2) - p)), 0, (a, b) -> a + b))"
    out = fourth.withColumn("n_repeat_words", F.expr(covered)).drop("hs", "ps", "at")
    out = out.withColumn("base_failed", F.expr("n_words < 10 or 100L * n_repeat_words > 20L * n_words"))
    return out.select(*keep, *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts")), "base_failed")


def _lgamma(x: str) -> str:
    """SQL for ln(gamma(x)), x >= 1: Stirling's series after a shift by 10, good to about 1e-13."""
    shifted = " + ".join(f"ln({x} + {k})" for k in range(10))
    z = f"({x} + 10)"
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046728D + 1 / (12 * {z}) - 1 / (360 * power({z}, 3)) + 1 / (1260 * power({z}, 5)) - ({shifted}))"


def binomial_tail(k: str, n: str, p: float) -> str:
    """SQL for P(X <= k), X binomial(n, p), exact up to rounding; terms further than 60 deviations from k are nil."""
    reach = f"cast(least({k}, 60 * sqrt({n} * {p * (1 - p)}) + 200) as bigint)"
    term = f"exp({_lgamma(f'({n} + 1D)')} - {_lgamma('(j + 1D)')} - {_lgamma(f'({n} - j + 1D)')} + j * ln({p}D) + ({n} - j) * ln({1 - p}D))"
    return f"aggregate(sequence({k} - {reach}, {k}), 0.0D, (s, j) -> s + {term})"


def cutoffs(counts: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, rule, cutoff): the chosen cutoffs. counts has doc_id, stratum and the base counts; labels doc_id, quality.

    Each distinct doc_id and text of a stratum is one trial.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = counts.where("not base_failed").join(known, "doc_id").select("stratum", "doc_id", "x1", "x2", "quality", *(F.expr(e).alias(r) for r, (e, _) in RULES.items()))
    held = held.groupBy("stratum", "doc_id", "x1", "x2").agg(F.first("quality").alias("quality"), *(F.first(r).alias(r) for r in RULES))
    each = held.selectExpr("stratum", "quality", f"stack({len(RULES)}, " + ", ".join(f"'{r}', cast({r} as double)" for r in RULES) + ") as (rule, x)")
    grid = "array(" + ", ".join(f"struct('{r}' as rule, {c}D as cutoff)" for r, (_, cs) in RULES.items() for c in cs) + ")"
    tried = each.selectExpr("stratum", "quality", "rule", "x", f"explode(transform(filter({grid}, g -> g.rule = rule), g -> g.cutoff)) as cutoff")
    told = tried.groupBy("stratum", "rule", "cutoff").agg(F.count_if(F.expr("quality = 1")).alias("good"), F.count_if(F.expr("quality = 1 and x > cutoff")).alias("lost"), F.count_if(F.expr("quality = 0 and x > cutoff")).alias("caught"))
    tests = told.agg(F.greatest(F.count("*"), F.lit(1)).alias("tests"))
    share = risk / len(RULES)
    tail = f"case when lost >= good * {share}D then 1.0D else {binomial_tail('lost', 'good', share)} end"
    sure = told.crossJoin(F.broadcast(tests)).withColumn("p_value", F.expr(tail)).where(f"caught > 0 and p_value <= {level}D / tests")
    return sure.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("caught", "cutoff")).alias("cutoff"))


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Documents (doc_id, text, lang, ...) and labels (doc_id, quality) -> doc_id, counts, base_failed, kept, rejected_by.

    Null and empty texts have no words and fail the base. A null lang is a stratum of its own. Labels with
    null quality or doc_id are unused; of several labels of one doc_id the least counts. Without labels
    only the base decides. Other columns are ignored; an empty table gives no rows; repeated rows are
    judged alike. Words are code-point runs outside space and control 9-13; long texts are counted whole.
    """
    stats = written(base_counts(docs.select("doc_id", F.col("lang").alias("stratum"), "text")), "counts")
    out = _limited(stats, labels, risk, level).withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(F.col("rejected_by")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def _limited(stats: DataFrame, labels: DataFrame, risk: float, level: float) -> DataFrame:
    """Adds rejected_by, the first rule whose cutoff a row exceeds, to a written table of doc_id, stratum and counts. A null stratum is one of its own."""
    chosen = written(cutoffs(stats, labels, risk, level), "cutoffs")
    limits = chosen.groupBy(F.col("stratum").alias("of")).agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))
    few = F.broadcast if chosen.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else (lambda x: x)
    hits = [F.when(F.expr(f"{e} > cut_{r}"), F.lit(r)) for r, (e, _) in RULES.items()]
    return stats.join(few(limits), F.col("stratum").eqNullSafe(F.col("of")), "left").withColumn("rejected_by", F.coalesce(*hits))


def kept_only(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The rows of docs that pass, with all their columns: the chosen cutoffs are applied to each row's own counts.

    Rows are counted once and written with their counts; the cutoffs are learned from the counts alone, so no
    text is shuffled. Null and empty texts go; repeated rows stay or go together; ids may be null or repeated;
    an empty table gives no rows.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.col("lang").alias("stratum"), "text")
    passed = _limited(written(base_counts(rows), "counted"), labels, risk, level).where("not base_failed and rejected_by is null")
    return passed.select("row.*")
