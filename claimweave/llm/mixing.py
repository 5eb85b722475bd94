"""Mixing sources to target weights (operator 7): a low-discrepancy source schedule over equal-token blocks.

Slot i of the mix lies at the golden-ratio point frac((i + 1) / phi); mapped through the cumulative target
weights it names a source, so every stretch of the mix holds the sources near their weights. The r-th
slot of a source takes the r-th block of that source's stream: its documents in a shuffled order, once
per epoch, each epoch shuffled anew, cut into blocks of equally many tokens. Slots past a source's
target stay empty and its last block ends at the target, so what is taken matches the target to a token.

Ranks and running sums are taken within chunks of bounded size; chunk bases come from prefix sums over
the chunk totals, so no source is ever gathered in one task.
"""

from __future__ import annotations

from itertools import accumulate
from math import inf

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimweave.llm.common import SPACES, scratch, written

WEIGHTS = (3, 1, 2)  #: repeated over the sources in code-point order, null last
SHARE = 1.5
MOST_EPOCHS = 2
BLOCK = 4096  #: tokens of a block, fewer where the whole mix is small
SLOTS_LEAST = 20_000
MOST_SOURCES = 100_000  #: sources are named on the driver; more are refused
BROADCAST_COPIES = 1_000_000  #: counts of copies (12 bytes each) sent to every task, so that no text moves; more are joined by shuffle
CHUNK = 2_000  #: documents or slots of a chunk, about
_GOLDEN = 0.6180339887498949


def fair_targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> list[float]:
    """Share of each source of share * sum(sizes), by weight, none above most times its size; the excess is reshared by weight."""
    own = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    left, targets, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        total = sum(own[i] for i in open_)
        full = {i for i in open_ if left * own[i] / total > most * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = left * own[i] / total
            break
        for i in full:
            targets[i] = float(most * sizes[i])
        left, open_ = left - sum(targets[i] for i in full), open_ - full
    return targets


def _running(df: DataFrame, keys: list[str], order: list, size: str, out: str) -> DataFrame:
    """Adds out: the sum of size over the rows before this one, by keys in the given order, chunk by chunk."""
    totals = df.groupBy(*keys, "chunk").agg(F.sum(size).alias("part"))
    base = totals.withColumn("base", F.coalesce(F.sum("part").over(W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("part")
    within = F.coalesce(F.sum(size).over(W.partitionBy(*keys, "chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("within", within).join(base, [*keys, "chunk"]).withColumn(out, F.col("base") + F.col("within")).drop("base", "within", "chunk")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = 7) -> DataFrame:
    """Documents (doc_id, text, source, ...) -> doc_id, size, source_size, target, taken, first_slot.

    size counts words (null text: 0) and taken how many words the mix takes of the document, repeats
    counted, at most twice size. first_slot is the first slot that holds the document, null where it is
    not taken. Every row is a document of its own, also if it repeats another; rows with null source
    form a source. Empty texts are never taken. Other columns are ignored. An empty table gives no rows.
    The order is a hash of seed, doc_id and text, so reruns agree.
    """
    return _mixed(docs, weights, share, seed).drop("key")


def _key(seed: int) -> F.Column:
    """A hash of a document, by which its source's documents are shuffled."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _mixed(docs: DataFrame, weights: tuple[int, ...], share: float, seed: int) -> DataFrame:
    """mixed() with each row's key."""
    spark = docs.sparkSession
    size = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACES), "")).cast("long")
    rows = written(docs.select("doc_id", "source", size.alias("size"), _key(seed).alias("o1")), "sizes")
    told = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(MOST_SOURCES + 1).collect()
    if len(told) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    told.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    targets = fair_targets([r["size"] for r in told], weights, share)
    whole = sum(targets)
    block = int(min(BLOCK, max(1, whole // SLOTS_LEAST)))
    chunks = 1 + max([r.docs for r in told], default=0) // CHUNK
    plan = [(i, r.source, r["size"], t, int(t), chunks) for i, (r, t) in enumerate(zip(told, targets, strict=True))]
    schema = "sid int, source string, source_size long, target double, goal long, chunks int"
    sources = F.broadcast(spark.createDataFrame(plan, schema))
    base = rows.join(sources.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")

    # each document's place in the stream of its source: once per epoch, each epoch in another order
    some = base.where("size > 0")
    span = F.expr("cast(floor((cast(o as double) / 18446744073709551616D + 0.5D) * chunks) as int)")
    one = _running(some.withColumn("o", F.col("o1")).withColumn("chunk", F.least(span, F.col("chunks") - 1)), ["sid"], ["o1", "doc_id"], "size", "at1")
    two = _running(one.withColumn("o", F.xxhash64(F.lit(seed + 1), "o1", "doc_id", "at1")).withColumn("chunk", F.least(span, F.col("chunks") - 1)), ["sid"], ["o", "doc_id", "at1"], "size", "at2")
    placed = written(two.select("doc_id", F.col("o1").alias("key"), "sid", "size", "source_size", "target", "goal", "at1", "at2"), "placed")
    spans = placed.selectExpr("sid", "at1", "goal", "size", "explode(array(at1, source_size + at2)) as lo").selectExpr("sid", "at1", "lo", "least(lo + size, goal) as hi").where("hi > lo")
    cut = spans.selectExpr("sid", "at1", "lo", "hi", f"explode(sequence(lo div {block}, (hi - 1) div {block})) as rank").selectExpr("sid", "at1", "rank", f"least(hi, (rank + 1) * {block}) - greatest(lo, rank * {block}) as words")

    # the schedule: a few slots more than blocks, so that every source comes to its target
    held = [i for i, t in enumerate(targets) if t >= 1]
    bounds = list(accumulate(targets[i] / whole for i in held)) if whole else []
    slots = int(whole / block * 1.02 + 40 * len(held) + 40) if held else 0
    point = F.expr(f"pmod((slot + 1) * {_GOLDEN}D, 1.0D)")
    inner = sorted(set(bounds[:-1]))
    if inner:  # a binary search, however many sources
        found = Bucketizer(splits=[-inf, *inner, inf], inputCol="point", outputCol="place").transform(spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")))
        first = {b: i for i, b in zip(reversed(held[:-1]), reversed(bounds[:-1]), strict=True)}  # of sources with one bound, the first
        named = found.select("slot", F.element_at(F.array(*(F.lit(x) for x in [*(first[b] for b in inner), held[-1]])), F.col("place").cast("int") + 1).cast("int").alias("sid"))
    else:
        named = spark.range(slots).select(F.col("id").alias("slot"), F.lit(held[-1] if held else 0).alias("sid"))
    ranked = _running(named.withColumn("chunk", F.expr(f"cast(slot div {CHUNK} as int)")).withColumn("one", F.lit(1)), ["sid"], ["slot"], "one", "rank")

    # blocks the schedule didn't come to are none in practice; if rounding leaves one, it stands at the end
    got = cut.join(ranked.select("sid", F.col("rank").cast("long").alias("rank"), "slot"), ["sid", "rank"], "left")
    taken = got.groupBy("sid", "at1").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    full = placed.join(taken, ["sid", "at1"], "left").select("doc_id", "key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")
    none = base.where("size = 0").select("doc_id", F.col("o1").alias("key"), "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return full.union(none)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = 7) -> DataFrame:
    """The rows of docs as often as the mix takes them, to the nearest whole copy: a document that it takes for less than half goes.

    All columns are kept. Rows with one doc_id and text share the most that any of them is taken; others with its
    doc_id, null or not, are documents of their own. Texts without words go. An empty table gives no rows.
    """
    with scratch() as keep:
        copies = keep(_copies(docs, weights, share, seed))
    light = F.broadcast if copies.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES else (lambda x: x)
    rows = docs.select(F.struct(*docs.columns).alias("row"), _key(seed).alias("key")).join(light(copies), "key")
    return rows.select("row", F.explode(F.expr("sequence(1, copies)")).alias("copy")).select("row.*")


def _copies(docs: DataFrame, weights: tuple[int, ...], share: float, seed: int) -> DataFrame:
    """key, copies: how often the mix takes each document that it takes."""
    copies = _mixed(docs, weights, share, seed).groupBy("key").agg(F.max(F.expr("cast(floor(taken / greatest(size, 1) + 0.5D) as int)")).alias("copies"))
    return written(copies.where("copies > 0"), "copies")
