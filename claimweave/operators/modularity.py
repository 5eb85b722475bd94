"""Communities by modularity, level by level: local moves over grouped edge weights, then contraction."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.rounds import dealt
from claimweave.functions.tables import discard, written

#: The weight of an edge that has none, by type, and of other types.
DEFAULTS = {"CITES": 1.0, "SUPPORTS": 1.0, "CLAIMS": 1.0, "RELATED_TO": 0.5}
OTHERWISE = 0.5
LEFT_OUT = ["CONTRADICTS"]
GAIN = 1e-9  #: what a round must add to modularity


class Level(NamedTuple):
    """One level: node -> community for all first nodes, and the modularity it reached."""

    place: DataFrame
    modularity: float


def undirected(edges: DataFrame) -> DataFrame:
    """src, dst, w both ways, parallel edges summed: positive weights, a missing one by rel_type, without CONTRADICTS and self-links."""
    kind = F.col("rel_type") if "rel_type" in edges.columns else F.lit(None).cast("string")
    default = F.coalesce(*(F.when(kind == k, w) for k, w in DEFAULTS.items()), F.lit(OTHERWISE))
    e = edges.where(~F.coalesce(kind.isin(LEFT_OUT), F.lit(False))).select("src", "dst", F.coalesce(F.col("weight").cast("double"), default).alias("w")).where("w > 0 and src <> dst")
    return e.union(e.select("dst", "src", "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _measure(e: DataFrame, place: DataFrame, total: float) -> float:
    """Modularity of node -> c over e (src, dst, w both ways, self-links once, as they count twice), total the sum of weights."""
    a = e.join(place.withColumnsRenamed({"node": "src", "c": "c1"}), "src").join(place.withColumnsRenamed({"node": "dst", "c": "c2"}), "dst")
    by = a.groupBy("c1").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("c1") == F.col("c2"), F.col("w")).otherwise(0.0)).alias("own"))
    got = by.agg(F.sum("own").alias("own"), F.sum(F.col("all") * F.col("all")).alias("square")).first()
    return got.own / total - got.square / (total * total)


def _moves(e: DataFrame, now: DataFrame, total: float) -> DataFrame:
    """node, c, best, gain: the community among its neighbours' to which a node's move adds most, where it adds anything. now: node, k, c."""
    held = now.groupBy("c").agg(F.sum("k").alias("held"), F.count("*").alias("many"))
    links = e.where("src <> dst").join(now.select(F.col("node").alias("dst"), F.col("c").alias("to")), "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("w").alias("w"))
    all_ = links.join(held.withColumnsRenamed({"c": "to", "held": "to_held", "many": "to_many"}), "to").join(now, "node").join(held, "c")
    own = all_.where("to = c").select("node", F.col("w").alias("own_w"))
    away = all_.where("to <> c").join(own, "node", "left").withColumn("gain", F.expr(f"(w - coalesce(own_w, 0.0D)) - k * (to_held - (held - k)) / {total!r}D"))
    # of two single nodes the larger goes to the smaller, so that they don't change places
    fit = away.where(F.col("gain") > GAIN * total).where("many > 1 or to_many > 1 or to < c")
    return fit.groupBy("node", "c").agg(F.max_by("to", F.struct(F.round("gain", 9), -F.col("to"))).alias("best"), F.max("gain").alias("gain"))


def _apart(moves: DataFrame) -> DataFrame:
    """Of the moves those that are the best of every community they leave or enter: their gains add up exactly."""
    rank = F.struct("gain", "node")
    ends = moves.select("node", "gain", F.explode(F.array("c", "best")).alias("of"))
    top = ends.groupBy("of").agg(F.max(rank).alias("top"))
    won = ends.join(top, "of").where("top.node = node").groupBy("node").agg(F.count("*").alias("n")).where("n = 2")
    return moves.join(won, "node", "left_semi")


def _local(edges: DataFrame, rounds: int, least: float) -> tuple[DataFrame, float, bool]:
    """Moves nodes until no round adds to modularity: node -> c, the modularity, whether any node moved."""
    with dealt(edges, "src") as e:
        total = e.agg(F.sum("w")).first()[0] or 0.0
        now = written(e.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).withColumn("c", F.col("node")), "places")
        if not total:
            return now.select("node", "c"), 0.0, False
        best, any_, alone = _measure(e, now.select("node", "c"), total), False, 0
        for r in range(rounds):
            found = _moves(e, now, total)
            # halves by turns, so that neighbours seldom swap; where a half doesn't add, the moves that can't disturb one another
            found = written(_apart(found) if alone else found.where(F.pmod(F.xxhash64("node", F.lit(r // 2)), F.lit(2)) == r % 2), "moves")
            new = written(now.join(found.select("node", "best"), "node", "left").select("node", "k", F.coalesce("best", "c").alias("c")), "places")
            got = best if found.isEmpty() else _measure(e, new.select("node", "c"), total)
            discard(found)
            if got > best + least:
                discard(now)
                now, best, any_, alone = new, got, True, max(0, alone - 1)
                continue
            discard(new)
            if alone == 2:
                break
            alone = 2
        return now.select("node", "c"), best, any_


def louvain(edges: DataFrame, levels: int = 10, rounds: int = 40, least: float = 1e-4) -> list[Level]:
    """The levels of a modularity clustering of edges (src, dst, weight, rel_type, with ids that are whole numbers), the finest first.

    In a round every second node may move to the neighbouring community that adds most to modularity (ties the
    smallest); a round is kept only if modularity rose. When it doesn't, moves that share no community are made,
    whose gains add up, until there is none left. Then communities become nodes, with the summed weights of
    their edges, for the next level. A community is named by its smallest node. Unlinked nodes are absent; no
    edges, no levels.
    """
    e = undirected(edges)
    place, out = None, []
    for _ in range(levels):
        found, q, moved = _local(e, rounds, least)
        if not moved and out:
            break
        place = found if place is None else place.join(found.withColumnsRenamed({"node": "of", "c": "to"}), F.col("c") == F.col("of")).select("node", F.col("to").alias("c"))
        names = place.groupBy("c").agg(F.min("node").alias("name"))
        place = written(place.join(names, "c").select("node", F.col("name").alias("c")), "communities")
        out.append(Level(place.select("node", F.col("c").alias("community")), q))
        if not moved:
            break
        own = written(found.join(names, "c").select(F.col("node").alias("n"), F.col("name")), "names")
        met = e.join(own.withColumnsRenamed({"n": "src", "name": "a"}), "src").join(own.withColumnsRenamed({"n": "dst", "name": "b"}), "dst")
        e = written(met.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "contracted")
    return out


def communities(edges: DataFrame, **more) -> DataFrame:
    """Node, level, community for every level of louvain(), from 1, with modularity rounded to 6 digits."""
    out = None
    for k, level in enumerate(louvain(edges, **more), 1):
        part = level.place.select("node", F.lit(k).alias("level"), "community", F.lit(round(level.modularity, 6)).alias("modularity"))
        out = part if out is None else out.union(part)
    if out is None:
        return edges.select(F.col("src").alias("node"), F.lit(0).alias("level"), F.col("src").alias("community"), F.lit(0.0).alias("modularity")).limit(0)
    return out
