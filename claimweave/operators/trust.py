"""Trust carried along signed edges until it settles, for one start or many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.rounds import dealt
from claimweave.functions.tables import discard, written


def transition(edges: DataFrame, compat_norm: bool = False) -> DataFrame:
    """src, dst, p: parallel edges (src, dst, w) summed and divided by the sum of weights into dst, a sum of 0 counting as 1.

    With compat_norm the divisor is the sum of weights into src, as an edge's row was divided by its column's sum.
    Edges with a null end or weight are left out.
    """
    e = edges.where("src is not null and dst is not null and w is not null").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    into = e.groupBy(F.col("dst").alias("of")).agg(F.sum("w").alias("total"))
    met = e.join(into, F.col("src" if compat_norm else "dst") == F.col("of"), "left")
    return met.select("src", "dst", (F.col("w") / F.when(F.coalesce(F.col("total"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("total"))).alias("p"))


def _settled(starts: DataFrame, edges: DataFrame, damping: float, rounds: int, tol: float, compat_norm: bool) -> DataFrame:
    """run, node, trust from run, node, t0: every run goes on until its own scores move by less than tol (L2), and is scaled by its own range."""
    starts = written(starts.where("node is not null").select("run", "node", F.col("t0").cast("double").alias("t0")), "starts")
    live, done = written(starts.withColumn("t", F.col("t0")), "trust"), []
    with dealt(transition(edges, compat_norm), "src") as a:
        for k in range(rounds):
            got = a.join(live.select("run", F.col("node").alias("src"), "t"), "src").groupBy("run", F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("t")).alias("inflow"))
            new = live.withColumnRenamed("t", "was").join(got, ["run", "node"], "left")
            new = written(new.select("run", "node", "t0", ((1 - damping) * F.col("t0") + damping * F.coalesce("inflow", F.lit(0.0))).alias("t"), "was"), "trust")
            moved = new.groupBy("run").agg(F.sqrt(F.sum(F.pow(F.col("t") - F.col("was"), 2))).alias("change"))
            left = written(moved.where(F.col("change") >= tol).select("run"), "unsettled")
            discard(live)
            if k == rounds - 1 or left.isEmpty():
                done.append(new.drop("was"))
                break
            done.append(written(new.join(left, "run", "left_anti").drop("was"), "settled"))
            live = written(new.join(left, "run", "left_semi").drop("was"), "trust")
            discard(new, left)
        else:
            done.append(live)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    ends = out.groupBy("run").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return out.join(ends, "run").select("run", "node", F.round(scaled, 6).alias("trust"))


def settled_trust(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, rounds: int = 20, tol: float = 1e-6, compat_norm: bool = False) -> DataFrame:
    """Node, trust: t = (1 - d) t0 + d A't until the L2 norm of its change is below tol, at most `rounds` times, then scaled to [0, 1].

    nodes: node (each once), t0; edges: src, dst, w (G1); seeds: node, score, which replace t0 of known nodes, of several the largest.
    Edges from or to unknown nodes carry nothing. Equal scores all round scale to 0; null nodes go; no nodes, no rows.
    """
    starts = nodes.select("node", "t0")
    if seeds is not None:
        s = seeds.where("node is not null and score is not null").groupBy("node").agg(F.max("score").alias("score"))
        starts = starts.join(s, "node", "left").select("node", F.coalesce(F.col("score").cast("double"), "t0").alias("t0"))
    return _settled(starts.withColumn("run", F.lit(0)), edges, damping, rounds, tol, compat_norm).drop("run")


def personal_trust(users: DataFrame, nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, tol: float = 1e-6, compat_norm: bool = False) -> DataFrame:
    """user_id, node, trust: settled_trust for every user in one run, their own scores as seeds; users: user_id, node, score.

    A row for each user and node, as every run is scaled by its own range; graph.personalized_trust gives the unscaled
    differences of many users where they reach alone. Users without a known node have the unseeded scores; null users go.
    """
    known = nodes.where("node is not null").select("node", "t0")
    s = users.where("user_id is not null").groupBy("user_id", "node").agg(F.max("score").alias("score"))
    ids = s.groupBy("user_id").agg(F.count("*").alias("many"))
    each = known.join(ids.select("user_id"), F.lit(True))  # every user scores every node
    starts = each.join(s, ["user_id", "node"], "left").select(F.col("user_id").alias("run"), "node", F.coalesce(F.col("score").cast("double"), "t0").alias("t0"))
    return _settled(starts, edges, damping, rounds, tol, compat_norm).withColumnRenamed("run", "user_id")
