"""T27 in full: citations within documents and between claims that share entities, and their figures, with hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.rounds import light
from claimweave.functions.tables import discard, written
from claimweave.operators.evidence import build_citations
from claimweave.operators.graph import _spots
from claimweave.operators.mining import frequent_pairs

PIECE = 1024  #: words of 64 claims that one row carries at most
LIGHT = 16  #: entities of a claim whose pairs are listed, at most
HOT = 16  #: claims of a pair of entities that meet each other, at most


def entity_citations(mentions: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """T27, second phase: src, dst, n_shared: pairs of claims, the later id citing the earlier, with `least` entities in common, and that share of those of the claim with fewer.

    mentions: claim_id, entity; repeats count once, nulls go. An entity of very many claims lists a claim only if it is among the
    rarest of that claim, so hubs make few pairs; none is lost.
    """
    p = frequent_pairs(mentions.select(F.col("entity").alias("doc"), F.col("claim_id").alias("entity")), least, share)
    return p.select(F.col("e2").alias("src"), F.col("e1").alias("dst"), F.col("co").alias("n_shared"))


def _united(own: DataFrame, mentions: DataFrame) -> DataFrame:
    """claim_id, n: for claims (claim_id, es: their entities) in how many claims of mentions (claim_id, entity) any of them is; claims that meet none are absent.

    Claims with the same entities are looked up once. The claims of an entity are bits of words and travel
    as arrays, in pieces of PIECE words; a set's partners are the union of its entities' words, united where all of the set has
    come together. Sets of entities are told by 128-bit hashes.
    """
    word, bit = _spots(mentions, "claim_id")
    held = mentions.select("entity", word.alias("word"), bit.alias("bit")).repartition("entity").groupBy("entity", "word").agg(F.bit_or("bit").alias("bits"))
    held = held.groupBy("entity").agg(F.collect_list("word").alias("ws"), F.collect_list("bits").alias("bs"))
    pieces = f"explode(transform(sequence(1, size(ws), {PIECE}), i -> struct(slice(ws, i, {PIECE}) as ws, slice(bs, i, {PIECE}) as bs)))"
    held = held.select("entity", F.expr(pieces).alias("x")).select("entity", "x.ws", "x.bs")
    own = own.select("claim_id", "es", F.xxhash64("es").alias("s1"), F.xxhash64(F.lit(1), "es").alias("s2"))
    sets = own.groupBy("s1", "s2").agg(F.first("es").alias("es")).select("s1", "s2", F.explode("es").alias("entity"))
    n = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as arrays are few bytes for the work in them
    met = sets.join(held, "entity").select("s1", "s2", "ws", "bs").repartition(n, "s1", "s2")
    words = met.select("s1", "s2", F.expr("inline(arrays_zip(ws, bs))")).toDF("s1", "s2", "word", "bits")
    reach = words.groupBy("s1", "s2", "word").agg(F.bit_or("bits").alias("bits")).groupBy("s1", "s2").agg(F.sum(F.bit_count("bits")).alias("n"))
    return own.select("claim_id", "s1", "s2").join(reach, ["s1", "s2"]).select("claim_id", "n")


def _counted(own: DataFrame, met: DataFrame) -> DataFrame:
    """claim_id, n: for claims (claim_id, es) how many others of them share any entity; met: claim_id, x, y: the pairs of entities that several claims have.

    Those of each entity are added up, and who shares t entities was added t times: it is met in t * (t - 1) / 2 pairs of them.
    """
    each = own.select("claim_id", F.explode("es").alias("entity"))
    many = each.groupBy("entity").agg((F.count("*") - 1).alias("n"))
    sums = each.join(many, "entity").groupBy("claim_id").agg(F.sum("n").alias("n"))
    both = met.join(met.select("x", "y", F.col("claim_id").alias("other")), ["x", "y"]).where("claim_id <> other").groupBy("claim_id", "other").agg(F.count("*").alias("k"))
    again = both.groupBy("claim_id").agg(F.sum(F.expr("cast(round((sqrt(1 + 8 * k) - 1) / 2) as bigint)")).alias("again"))
    return sums.join(again, "claim_id", "left").select("claim_id", F.expr("n - coalesce(again, 0)").alias("n"))


def entity_reach(mentions: DataFrame) -> DataFrame:
    """claim_id, n_partners: how many other claims share any entity with a claim; exact.

    Claims of each entity are counted, not listed: only claims that share two entities or more meet, where at most HOT claims have the
    two. Claims of more than LIGHT entities, or with two that more claims have, are looked up as bits and travel as arrays (_united()), and
    so do those that meet them; no pair of these becomes a row. mentions: claim_id, entity; repeats count once, nulls go.
    """
    m = mentions.where("claim_id is not null and entity is not null")
    own = written(m.groupBy("claim_id").agg(F.array_sort(F.collect_set("entity")).alias("es")), "sets")
    pairs = "inline(flatten(transform(es, (x, i) -> transform(slice(es, i + 2, size(es)), y -> struct(x, y)))))"
    listed = own.where(f"size(es) between 2 and {LIGHT}").select("claim_id", F.expr(pairs)).toDF("claim_id", "x", "y")
    shared = written(listed.select(F.xxhash64("x", "y").alias("k")).groupBy("k").agg(F.count("*").alias("many")).where("many > 1"), "shared")
    few = light(shared, 2 * shared.count())
    met = written(listed.withColumn("k", F.xxhash64("x", "y")).join(few, "k").select("claim_id", "x", "y", "many"), "met")
    hard = written(own.where(f"size(es) > {LIGHT}").select("claim_id").union(met.where(f"many > {HOT}").select("claim_id")).distinct(), "hard")
    if not (n := hard.count()):
        out = _counted(own, met.drop("many"))
        return out.select("claim_id", F.col("n").alias("n_partners"))
    them = light(hard, n)
    theirs, others = written(own.join(them, "claim_id", "left_semi"), "hard"), written(own.join(them, "claim_id", "left_anti"), "others")
    each = lambda df: df.select("claim_id", F.explode("es").alias("entity"))
    out = _united(theirs, each(own)).selectExpr("claim_id", "n - 1 as n_partners")
    more = _united(others, each(theirs)).withColumnRenamed("n", "more")
    rest = _counted(others, met.drop("many").join(them, "claim_id", "left_anti")).join(more, "claim_id", "left")
    discard(shared)
    return out.union(rest.selectExpr("claim_id", "n + coalesce(more, 0) as n_partners"))


def citation_network(claims: DataFrame, mentions: DataFrame, doc: str, seq: str, most: int = 5, least: int = 2, share: float = 0.5) -> DataFrame:
    """Src, dst, kind: both phases, in_document and shared_entities, each edge once per kind."""
    inside = build_citations(claims, doc, seq, most).select("src", "dst", F.lit("in_document").alias("kind"))
    return inside.distinct().union(entity_citations(mentions, least, share).select("src", "dst", F.lit("shared_entities")))


def citation_stats(edges: DataFrame) -> DataFrame:
    """Kind (null: all), total, avg_per_claim, max_per_claim: citations of each kind and of all by the claims that cite."""
    per = edges.groupBy("kind", "src").agg(F.count("*").alias("n"))
    by = per.groupBy("kind").agg(F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("avg_per_claim"), F.max("n").alias("max_per_claim"))
    all_ = per.groupBy("src").agg(F.sum("n").alias("n")).agg(F.lit(None).cast("string").alias("kind"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.round(F.avg("n"), 6).alias("avg_per_claim"), F.max("n").alias("max_per_claim"))
    return by.union(all_)
