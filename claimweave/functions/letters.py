"""Pairs of names alike by their 3-letter pieces, by a prefix filter instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimweave.functions.tables import discard, written


def pieces(name: Column) -> Column:
    """The 3-letter pieces of the padded lower-case words of a name, repeats included."""
    words = F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(3)))))


def alike(names: DataFrame, floor: float) -> DataFrame:
    """a, b, similarity: pairs a < b of distinct names whose counts of pieces have a cosine of at least the floor. Exact.

    names: name and, if only some pairs are wanted, fresh (boolean): then one of the two is fresh. Pieces go from rare to common,
    by the names that have them. If two names share no piece of those up to where the rest of one's length falls below the
    floor, their cosine is below it; so only names that share such a piece meet, and common pieces list nobody. Names
    without letters or digits, blank and null names give no pairs; rows of one name are one, fresh if any is.
    """
    fresh = F.col("fresh") if "fresh" in names.columns else F.lit(True)
    own = names.where("name is not null").select("name", fresh.alias("fresh")).groupBy("name").agg(F.max("fresh").alias("fresh"))
    count = own.select("name", "fresh", F.explode(pieces(F.col("name"))).alias("p")).groupBy("name", "fresh", "p").agg(F.count("*").alias("n"))
    size = W.partitionBy("name")
    count = written(count.withColumn("x", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(size))), "pieces")
    many = count.groupBy("p").agg(F.count("*").alias("many"))
    rare = W.partitionBy("name").orderBy("many", "p").rowsBetween(W.unboundedPreceding, -1)
    left = 1 - F.coalesce(F.sum(F.col("x") * F.col("x")).over(rare), F.lit(0.0))
    prefix = written(count.join(many, "p").withColumn("left", left).where(F.col("left") >= floor * floor - 1e-9).select("name", "fresh", "p"), "prefixes")
    u, v = prefix.alias("u"), prefix.alias("v")
    met = u.join(v, (F.col("u.p") == F.col("v.p")) & (F.col("u.name") < F.col("v.name")) & (F.col("u.fresh") | F.col("v.fresh"))).select(F.col("u.name").alias("a"), F.col("v.name").alias("b")).distinct()
    vectors = count.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("p", "x"))).alias("vec"))
    side = lambda end: vectors.select(F.col("name").alias(end), F.col("vec").alias(f"v_{end}"))
    dot = F.expr("aggregate(map_entries(v_a), 0.0D, (s, e) -> s + e.value * coalesce(v_b[e.key], 0.0D))")
    out = written(met.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(dot, 12).alias("similarity")).where(F.col("similarity") >= floor), "alike")
    discard(count, prefix)
    return out
