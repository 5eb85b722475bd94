"""Graph analytics and pattern mining over edges and mentions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimweave.functions.tables import written
from claimweave.operators.mining import frequent_pairs

ANY = 1e-12  #: a share of documents that every pair has


def trust_edges(edges: DataFrame) -> DataFrame:
    """G1: src, dst, w: -0.5 w for CONTRADICTS, w for SUPPORTS, 0.5 w for others, parallel edges summed."""
    w = F.when(F.col("rel_type") == "CONTRADICTS", -0.5 * F.col("weight")).when(F.col("rel_type") == "SUPPORTS", F.col("weight")).otherwise(0.5 * F.col("weight"))
    return edges.groupBy("src", "dst").agg(F.sum(w).alias("w"))


def trust_propagation(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 3) -> DataFrame:
    """t = (1 - d) t0 + d A't over `iterations` rounds, A normalised by the sum of absolute weights out of a node; min-max to [0, 1].

    nodes has node, t0; edges src, dst, w. The plan is one declarative chain; for many rounds write the
    result of some to a table and go on from there.
    """
    out = edges.groupBy("src").agg(F.sum(F.abs("w")).alias("total"))
    a = edges.join(out, "src").select("src", "dst", F.try_divide("w", "total").alias("p"))
    t = nodes.select("node", "t0", F.col("t0").alias("t"))
    for _ in range(iterations):
        got = a.join(t.select(F.col("node").alias("src"), "t"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("t")).alias("inflow"))
        t = nodes.join(got, "node", "left").select("node", "t0", ((1 - damping) * F.col("t0") + damping * F.coalesce("inflow", F.lit(0.0))).alias("t"))
    ends = t.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))  # one row
    return t.crossJoin(F.broadcast(ends)).select("node", F.round(F.coalesce(F.try_divide(F.expr("t - lo"), F.expr("hi - lo")), F.lit(0.5)), 6).alias("trust"))


def cooccurrence(mentions: DataFrame, min_freq: int = 3, min_conf: float = 0.0) -> DataFrame:
    """Pairs of entities mentioned by the same documents, with counts, confidence both ways and lift co * N / (c1 * c2).

    Entities below min_freq are pruned before documents are paired up, and pairs are counted in pieces of bounded size (mining.frequent_pairs).
    """
    n = mentions.agg(F.count_distinct("doc").alias("n"))  # one row
    full = frequent_pairs(mentions, min_freq, ANY).crossJoin(F.broadcast(n))
    return full.select("e1", "e2", "co", F.round(F.col("co") / F.col("c1"), 6).alias("conf12"), F.round(F.col("co") / F.col("c2"), 6).alias("conf21"), F.round(F.col("co") * F.col("n") / (F.col("c1") * F.col("c2")), 6).alias("lift")).where(F.greatest("conf12", "conf21") >= min_conf)


def temporal_sequences(dated: DataFrame, days: int = 90, least: int = 3) -> DataFrame:
    """How often entity b has a document within `days` days after one of entity a of the same group.

    dated has grp, entity, day (date). Days are bucketed by `days`, so the range join is an equi-join on
    this bucket or the next.
    """
    b = F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / days)
    left = dated.withColumn("bucket", F.explode(F.array(b, b + 1))).alias("x")
    right = dated.withColumn("bucket", b).alias("y")
    gap = F.datediff("y.day", "x.day")
    met = left.join(right, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.grp") == F.col("y.grp")) & (F.col("x.entity") != F.col("y.entity")) & (gap > 0) & (gap <= days))
    return met.groupBy(F.col("x.entity").alias("e1"), F.col("y.entity").alias("e2")).agg(F.count("*").alias("n"), F.round(F.avg(gap), 6).alias("mean_days")).where(F.col("n") >= least)


def chains(edges: DataFrame, top: int | None = None, kinds: list[str] | None = None, longest: int = 2) -> DataFrame:
    """Simple paths of 2 to `longest` (2 or 3) edges of the kinds without a direct edge between their ends.

    a, b, c and, for 3 edges, d; strength is the product of weights; the strongest `top`, ties by nodes. edges has
    src, dst, weight and, for kinds, rel_type. One edge counts where several join the same nodes: the heaviest.
    """
    e = (edges.where(F.col("rel_type").isin(kinds)) if kinds else edges).groupBy("src", "dst").agg(F.max("weight").alias("weight")).where("src <> dst")
    if top and longest == 2:
        return _strongest(written(e, "edges"), top)
    step = lambda a, b, w: e.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("weight").alias(w))
    two = step("a", "b", "w1").join(step("b", "c", "w2"), "b").where("a <> c")
    direct = lambda end: e.select(F.col("src").alias("a"), F.col("dst").alias(end))
    out = two.join(direct("c"), ["a", "c"], "left_anti").select("a", "b", "c", F.round(F.col("w1") * F.col("w2"), 6).alias("strength"))
    if longest > 2:
        three = two.join(step("c", "d", "w3"), "c").where("a <> d and b <> d").join(direct("d"), ["a", "d"], "left_anti")
        none = F.lit(None).cast(e.schema["src"].dataType)
        out = out.select("a", "b", "c", none.alias("d"), "strength").union(three.select("a", "b", "c", "d", F.round(F.expr("w1 * w2 * w3"), 6).alias("strength")))
    return out.orderBy(F.desc("strength"), *out.columns[:-1]).limit(top) if top else out


def _strongest(e: DataFrame, top: int) -> DataFrame:
    """The `top` of chains() with two edges, from written edges without repeats.

    The paths through the heaviest few edges into and out of each node give the strength that the last of the `top` has at least.
    Then only edges meet that reach it with the best partner at their node, so no path of that strength is lost; if those few
    give less than `top` paths, all edges meet.
    """
    strength = F.round(F.col("w1") * F.col("w2"), 6)
    into = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w1"))
    out = e.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("weight").alias("w2"))
    direct = e.select(F.col("src").alias("a"), F.col("dst").alias("c"))
    paths = lambda x, y: x.join(y, "b").where("a <> c").select("a", "b", "c", strength.alias("strength"))
    best = lambda df, w, end: df.withColumn("rank", F.row_number().over(W.partitionBy("b").orderBy(F.desc_nulls_last(w), end))).where(F.col("rank") <= math.isqrt(top) + 1).drop("rank")
    few = paths(best(into, "w1", "a"), best(out, "w2", "c")).where("strength is not null").join(direct, ["a", "c"], "left_anti")
    floor = few.orderBy(F.desc("strength")).limit(top).agg(F.when(F.count("*") == top, F.min("strength")).alias("floor"))  # one row
    ends = lambda df, w: df.groupBy("b").agg(F.max(w).alias("hi"), F.min(w).alias("lo"))  # noqa: E731  the best partner of a negative weight is the lowest
    reach = lambda df, w, other: df.join(other, "b").crossJoin(F.broadcast(floor)).where(F.expr(f"floor is null or greatest({w} * hi, {w} * lo) >= floor - 1e-6")).drop("hi", "lo", "floor")
    found = paths(reach(into, "w1", ends(out, "w2")), reach(out, "w2", ends(into, "w1")))
    found = found.crossJoin(F.broadcast(floor)).where("floor is null or strength >= floor")
    found = found.join(direct, ["a", "c"], "left_anti").select("a", "b", "c", "strength")
    return found.orderBy(F.desc("strength"), "a", "b", "c").limit(top)


def _spots(edges: DataFrame, c: str) -> tuple[F.Column, F.Column]:
    """A node as a word and a bit in it: 64 neighbouring ids share a word if ids are whole numbers, any other id has a word of its own."""
    if edges.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return F.shiftright(F.col(c).cast("long"), 6), F.expr(f"shiftleft(1L, cast({c} & 63 as int))")
    return F.col(c), F.lit(1).cast("long")


def cascades(edges: DataFrame, first: int = 3, second: int = 5, top: int | None = 20) -> DataFrame:
    """Nodes with enough distinct successors and successors of those, the node itself left out of the latter.

    magnitude is the product of both counts; the `top` largest, ties by node. Parallel edges count once and edges with
    a null end not at all. A node has at most as many second successors as its successors have edges, and as there are nodes with
    edges into them; that bound tells which nodes can be among the `top`, and theirs alone are united. Without `top` all are.
    """
    e = written(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "edges")
    n1 = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n1"))
    known = e.agg(F.count_distinct("dst").alias("known"))  # one row
    after = n1.select(F.col("node").alias("dst"), F.col("n1").alias("next"))
    most = e.join(after, "dst").groupBy(F.col("src").alias("node")).agg(F.sum("next").alias("most")).crossJoin(F.broadcast(known)).select("node", F.least("most", "known").alias("most"))
    able = written(n1.where(F.col("n1") >= first).join(most.where(F.col("most") >= second), "node").select("node", "n1", (F.col("n1") * F.col("most")).alias("bound")), "bounds")
    if top is None:
        return _second_successors(e, able, second)
    best = _second_successors(e, able.orderBy(F.desc("bound"), "node").limit(2 * top), second).orderBy(F.desc("magnitude")).limit(top)
    floor = best.agg(F.when(F.count("*") == top, F.min("magnitude")).alias("floor"))  # one row
    able = able.crossJoin(F.broadcast(floor)).where("floor is null or bound >= floor").drop("floor")
    return _second_successors(e, able, second).orderBy(F.desc("magnitude"), "node").limit(top)


def _second_successors(e: DataFrame, nodes: DataFrame, second: int) -> DataFrame:
    """Node, n1, n2, magnitude of nodes (node, n1) with at least `second` second successors over edges without repeats.

    Successors are held as bits of words, so a path of two steps is a row for each word of the middle's successors, not for each
    of them, and words of one node are united before they are shuffled.
    """
    word, bit = _spots(e, "dst")
    own_word, own_bit = _spots(e, "src")
    after = e.groupBy(F.col("src").alias("mid"), word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    own = e.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    met = own.join(after, F.col("dst") == F.col("mid")).select(F.col("src").alias("node"), "word", F.when(F.col("word") == own_word, F.col("bits").bitwiseAND(F.bitwise_not(own_bit))).otherwise(F.col("bits")).alias("bits"))
    ends = met.where("bits <> 0").groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
    two = ends.groupBy("node").agg(F.sum(F.bit_count("bits")).alias("n2")).where(F.col("n2") >= second).join(nodes, "node")
    return two.select("node", "n1", "n2", (F.col("n1") * F.col("n2")).alias("magnitude"))


def contested(edges: DataFrame, trust: DataFrame, own: float = 0.7, other: float = 0.5) -> DataFrame:
    """Trusted nodes contradicted, either way, by trusted ones; score = trust times their number."""
    c = edges.where("rel_type = 'CONTRADICTS'").select("src", "dst")
    both = c.union(c.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    hit = both.join(trust.select(F.col("node").alias("src"), F.col("trust").alias("t1")), "src").join(trust.select(F.col("node").alias("dst"), F.col("trust").alias("t2")), "dst").where((F.col("t1") > own) & (F.col("t2") > other))
    return hit.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.round(F.max("t1") * F.count("*"), 6).alias("score"))


def degree_stats(edges: DataFrame) -> DataFrame:
    """Edges by type with the mean and the largest out-degree."""
    per = edges.groupBy("rel_type", "src").agg(F.count("*").alias("d"))
    return per.groupBy("rel_type").agg(F.sum("d").alias("n_edges"), F.round(F.avg("d"), 6).alias("mean_degree"), F.max("d").alias("max_degree"))


def hubs(edges: DataFrame, least: int = 3, top: int = 10) -> DataFrame:
    """The nodes of highest degree with their number of distinct neighbours.

    Degrees are sums of counts, a row for each node; only the edges of the best nodes are looked at again for distinct neighbours.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))  # null ends are a node, too
    best = ends.groupBy("node").agg(F.count("*").alias("degree")).where(F.col("degree") >= least).orderBy(F.desc("degree"), "node").limit(top)
    best = written(best, "hubs")  # `top` rows
    both = edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst")
    near = both.join(F.broadcast(best.select("node")), F.col("src").eqNullSafe(F.col("node"))).groupBy("node").agg(F.count_distinct("dst").alias("neighbours"))
    out = F.broadcast(best).join(near.withColumnRenamed("node", "of"), F.col("node").eqNullSafe(F.col("of"))).select("node", "degree", "neighbours")
    return out.orderBy(F.desc("degree"), "node").limit(top)


def timeline_groups(claims: DataFrame, by: str, top: int = 20) -> DataFrame:
    """V2: counts per group, the largest `top` by name and the others together."""
    n = claims.groupBy(by).agg(F.count("*").alias("n"))
    best = n.orderBy(F.desc("n"), by).limit(top).select(by, F.lit(True).alias("_top"))
    return n.join(F.broadcast(best), by, "left").groupBy(F.when(F.col("_top"), F.col(by).cast("string")).otherwise("_other").alias("grp")).agg(F.sum("n").alias("n"))


def timeline_histogram(claims: DataFrame, unit: str = "week") -> DataFrame:
    """V4: claims per calendar unit."""
    return claims.where("ts is not null").groupBy(F.date_trunc(unit, "ts").cast("date").alias("bucket")).agg(F.count("*").alias("n"))


def network_size(nodes: DataFrame, label: str, edges: DataFrame) -> DataFrame:
    """Nodes by label and edges by type: what, name, n."""
    n = nodes.groupBy(F.col(label).cast("string").alias("name")).agg(F.count("*").alias("n")).withColumn("what", F.lit("node"))
    e = edges.groupBy(F.col("rel_type").alias("name")).agg(F.count("*").alias("n")).withColumn("what", F.lit("edge"))
    return n.unionByName(e)


def personalized_trust(users: DataFrame, nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 2) -> DataFrame:
    """G2 for many users in one run, before scaling: a user's own scores replace t0. users has user_id, node, score.

    Propagation is linear, so the base run is done once and each user's difference to it is carried only
    where it reaches: user_id, node, trust for the nodes within `iterations` steps of a scored one. A
    user's other nodes have the base trust.
    """
    out = edges.groupBy("src").agg(F.sum(F.abs("w")).alias("total"))
    a = edges.join(out, "src").select("src", "dst", F.try_divide("w", "total").alias("p"))
    base = nodes.select("node", "t0", F.col("t0").alias("t"))
    first = users.join(nodes, "node").select("user_id", "node", (F.col("score") - F.col("t0")).alias("d"))
    delta = first
    for _ in range(iterations):
        got = a.join(base.select(F.col("node").alias("src"), "t"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("t")).alias("inflow"))
        base = nodes.join(got, "node", "left").select("node", "t0", ((1 - damping) * F.col("t0") + damping * F.coalesce("inflow", F.lit(0.0))).alias("t"))
        flow = a.join(delta.withColumnRenamed("node", "src"), "src").select("user_id", F.col("dst").alias("node"), (damping * F.col("p") * F.col("d")).alias("d"))
        kept = first.select("user_id", "node", ((1 - damping) * F.col("d")).alias("d"))
        delta = kept.union(flow).groupBy("user_id", "node").agg(F.sum("d").alias("d"))
    return delta.join(base, "node").select("user_id", "node", F.round(F.col("t") + F.col("d"), 6).alias("trust"))


def unexpected_links(edges: DataFrame, nodes: DataFrame, trusted: float = 0.6, top: int = 30) -> DataFrame:
    """Edges between trusted nodes of other kind and other community, the `top` by the product of trusts. nodes: node, kind, community, trust."""
    good = nodes.where(F.col("trust") > trusted)
    side = lambda end, s: good.select(F.col("node").alias(end), *(F.col(c).alias(c + s) for c in ("kind", "community", "trust")))
    met = edges.where("rel_type in ('RELATED_TO', 'SUPPORTS', 'CONTRADICTS')").join(side("src", "1"), "src").join(side("dst", "2"), "dst").where("kind1 <> kind2 and community1 <> community2")
    return met.select("src", "dst", "rel_type", F.round(F.expr("trust1 * trust2"), 6).alias("strength")).orderBy(F.desc("strength"), "src", "dst").limit(top)


def pattern_store(**patterns: tuple[DataFrame, list[str]]) -> DataFrame:
    """Patterns of several kinds as one table: kind, a stable id, the nodes involved and the row as JSON.

    Each argument is a table and the columns that name its nodes.
    """
    parts = []
    for kind, (df, nodes) in sorted(patterns.items()):
        key = F.concat_ws("|", F.lit(kind), *(F.col(c).cast("string") for c in nodes))
        parts.append(df.select(F.lit(kind).alias("kind"), F.md5(key).alias("pattern_id"), F.array(*(F.col(c).cast("string") for c in nodes)).alias("nodes"), F.to_json(F.struct("*")).alias("pattern")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pattern_links(store: DataFrame) -> DataFrame:
    """Kind, pattern_id, node: one row per node of a pattern."""
    each = store.groupBy("kind", "pattern_id").agg(F.array_distinct(F.flatten(F.collect_set("nodes"))).alias("nodes"))  # patterns, not their nodes, are shuffled
    return each.select("kind", "pattern_id", F.explode("nodes").alias("node"))


def filter_graph(nodes: DataFrame, edges: DataFrame, min_trust: float, max_nodes: int) -> DataFrame:
    """V1: the edges among the first max_nodes nodes: detected ones first, then by trust. nodes: node, trust, detected."""
    best = nodes.where(F.col("trust") >= min_trust).orderBy(F.desc("detected"), F.desc("trust"), "node").limit(max_nodes).select("node")
    return edges.join(best.withColumnRenamed("node", "src"), "src", "left_semi").join(best.withColumnRenamed("node", "dst"), "dst", "left_semi")


def timeline_scale(claims: DataFrame, by: list[str]) -> DataFrame:
    """V3: per group the unit that suits its range of dates; under two dates: year."""
    days = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 86_400_000_000
    unit = F.when(F.count("ts") < 2, "year").when(days < 30, "day").when(days < 180, "week").when(days < 730, "month").when(days < 3650, "year").when(days < 36500, "decade").otherwise("century")
    return claims.groupBy(*by).agg(unit.alias("unit"))


def stance(claims: DataFrame, edges: DataFrame, anti: list[str], pro: list[str]) -> DataFrame:
    """V5: anti or pro by the types of a node's edges (CONTRADICTS first), else by the majority of keywords, else neutral."""
    flags = edges.groupBy(F.col("src").alias("node")).agg(F.max(F.col("rel_type") == "CONTRADICTS").alias("_a"), F.max(F.col("rel_type") == "SUPPORTS").alias("_p"))
    n = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("claim_text"), w)))
    by_words = F.when(n(anti) > n(pro), "anti").when(n(pro) > n(anti), "pro").otherwise("neutral")
    return claims.join(flags, "node", "left").select("node", F.when(F.col("_a"), "anti").when(F.col("_p"), "pro").otherwise(by_words).alias("stance"))


def related_timeline(edges: DataFrame, dated: DataFrame) -> DataFrame:
    """V6: per node its dated neighbours, either way, by year; a missing year counts as 0. dated: node, year."""
    e = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    met = e.join(dated.select(F.col("node").alias("dst"), F.coalesce("year", F.lit(0)).alias("year")), "dst")
    order = W.partitionBy("src").orderBy("year", "dst")
    return met.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "year", F.row_number().over(order).alias("place"))
