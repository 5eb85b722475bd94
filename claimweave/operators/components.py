"""Connected components by alternating large-star and small-star rounds, each cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.rounds import by_rows
from claimweave.functions.tables import discard, written

HEAVY = 100_000  #: rows of one node that a join may bring together, about
MOST_HEAVY = 10_000  #: nodes with more rows than that, whose minima are broadcast


def _met(rows: DataFrame, least: DataFrame, heavy: int) -> DataFrame:
    """u, v: of rows (u, v) v and the minimum m of their u, by least (u, m, n: rows of u).

    Rows of a node with more than heavy of them stay where they lie and its minimum comes to them, so no task takes a hub's.
    """
    few = F.broadcast(least.where(F.col("n") > heavy).select("u", F.col("m").alias("hub")))
    at = rows.join(few, "u", "left")
    far = at.where("hub is not null").select(F.col("v").alias("u"), F.col("hub").alias("v"))
    near = at.where("hub is null").select("u", "v").join(least.where(F.col("n").between(1, heavy)).select("u", "m"), "u")
    return far.union(near.select(F.col("v").alias("u"), F.col("m").alias("v")))


def _large_star(edges: DataFrame, heavy: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    return _met(both.where("v > u"), least, heavy)


def _small_star(down: DataFrame, heavy: int) -> DataFrame:
    """down: u > v in each row, as large stars are."""
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"), F.count("*").alias("n"))
    linked = _met(down, least.where("m < most"), heavy)  # a node of one neighbour has nothing to link
    return linked.where("u <> v").union(least.select("u", "m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) links of longs -> (node, component): component is the smallest node reachable; unlinked nodes are absent.

    Self-links and repeats are allowed; null ends are dropped; no links give no rows. Hubs are star
    centres: minima are pre-aggregated, and those of hubs are broadcast to their rows, which are never brought together.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"), "links")
    rows, before = now.count(), None
    for _ in range(rounds):
        heavy = max(HEAVY, rows // MOST_HEAVY)
        with by_rows(spark, 2 * rows):
            star = written(_small_star(now, heavy).distinct(), "stars")
            discard(now)
            now = written(_large_star(star, heavy), "links")
            discard(star)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        rows, before = state[0], state
    else:
        raise RuntimeError("links did not settle; raise rounds")
    # stars: each node has one link, to its centre
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
