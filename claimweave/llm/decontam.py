"""Benchmark decontamination (operator 9): SimHash of item-sized windows, multi-index Hamming search, exact check.

DataFrame functions only. A window has as many words as the benchmark items it may repeat. Windows are
laid where a word shingle of the text is one of some item's (a window that shares none has similarity
0), at the offset which that shingle has there; windows of equal words are one. Which items a window
repeats is found by fingerprint: every window and item gets a SimHash of 384 bits of its weighted
shingles, cut into 24 blocks of 16. Windows are looked up by each block among the items' blocks, as they
are and with any one bit flipped, so all fingerprints within 47 bits meet for certain (24 blocks can't
all differ in two), and two of similarity 0.75, which differ in some 66, with a chance of 99.6 %; at 0.8
it is 99.9 %. Others meet with a chance of 0.6 %, and go where more than RADIUS bits differ. Windows that
fingerprints miss are found by an item's rarest shingles: those after which the others weigh less than
the threshold's share of the item, so a window without any of them is below it. Pairs
found are checked exactly: the sum of minima over the sum of maxima of shingle weights, where a shingle
weighs its count times ln((1 + items) / (1 + items with it)) + 1. Items with equal words are one there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimweave.llm.common import SPACES, scratch, text_id, written

LONGS = 6  #: 64-bit words of a fingerprint
BLOCK = 16  #: bits of a block
RADIUS = 96  #: bits in which fingerprints of similarity 0.75 differ at most: their mean and four deviations
BROADCAST_HITS = 200_000  #: windows of documents with a hit sent to every task; more are joined by shuffle
BROADCAST_SHINGLES = 200_000  #: item shingles sent to every task; more are joined by shuffle
BROADCAST_LEAKY = 200_000  #: texts to drop sent to every task; more are joined by shuffle
BROADCAST_INDEX = 20_000  #: items whose blocks are sent to every task (408 rows each, of 70 bytes); more are joined by shuffle


def _shingles(words: str, width: int) -> str:
    """SQL for the hash of every run of width words, in order."""
    rest = "".join(f", {words}[i + {k}]" for k in range(1, width))
    return f"case when size({words}) >= {width} then transform(slice({words}, 1, size({words}) - {width - 1}), (w, i) -> xxhash64(w{rest})) else array() end"


def _simhash(shingles: str) -> str:
    """SQL for the SimHash of an array<struct<h, w>>, as an array of longs.

    A shingle votes with the square root of its weight: sets with a weighted Jaccard similarity (minima over
    maxima) of J then have a cosine of at least 2 J / (1 + J), however uneven the weights are.
    """
    longs = []
    for k in range(LONGS):
        votes = f"transform({shingles}, x -> struct(xxhash64(x.h, {k}) as h, sqrt(x.w) as w))"
        sums = f"aggregate({votes}, array_repeat(0.0D, 64), (acc, x) -> transform(acc, (a, b) -> a + x.w * (2 * (shiftright(x.h, b) & 1) - 1)))"
        longs.append(f"aggregate(transform({sums}, (a, b) -> if(a > 0, shiftleft(1L, b), 0L)), 0L, (a, b) -> a | b)")
    return f"array({', '.join(longs)})"


def _blocks(fingerprint: str) -> str:
    """SQL for the blocks of a fingerprint."""
    cuts = (f"cast(shiftright({fingerprint}[{k}], {at}) & {(1 << BLOCK) - 1} as int)" for k in range(LONGS) for at in range(0, 64, BLOCK))
    return f"array({', '.join(cuts)})"


def _apart(a: str, b: str) -> str:
    """SQL for the number of bits in which two fingerprints differ."""
    return "(" + " + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(LONGS)) + ")"


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.75, width: int = 5) -> DataFrame:
    """Passages of docs (doc_id, text, ...) that repeat items (item_id, text, ...).

    Returns doc_id, item_id, start_word, n_words, hamming, similarity: the best window of each document
    and item, by similarity, then the earliest. Words are lower-cased runs of non-space characters. An
    item shorter than width words is one shingle. Null and empty texts match nothing; items with equal
    words match alike; a repeated document or item gives its rows once. Documents are told apart by id and text and
    items by id and words, so null and repeated ids are ids like any other, and rows of one id keep to their own text.
    Other columns are ignored; an empty table on either side gives no rows. Words and texts are told by 64-bit hashes.
    """
    split = f"filter(split(lower(coalesce(text, '')), '{SPACES}'), w -> w <> '')".replace("\\", "\\\\")
    named = written(items.selectExpr("item_id", f"{split} as words").where("size(words) > 0").selectExpr("item_id", "xxhash64(words) as wid", "words").distinct(), "items")
    known = named.dropDuplicates(["wid"]).selectExpr("wid", "words", "size(words) as n_words", f"least(size(words), {width}) as k")
    widths = [r.k for r in known.select("k").distinct().collect()]  # at most `width` numbers
    if not widths:
        return docs.join(items, F.lit(False)).selectExpr("doc_id", "item_id", "0 as start_word", "0 as n_words", "0 as hamming", "0.0D as similarity").limit(0)
    sized = "case k " + " ".join(f"when {k} then {_shingles('words', k)}" for k in widths) + " end"
    known = written(known.selectExpr("wid", "n_words", "k", f"{sized} as hs"), "items")
    total = known.count()
    spread = known.select("wid", "k", F.posexplode("hs").alias("at", "h"))
    rarity = written(spread.groupBy("h").agg(F.count_distinct("wid").alias("df")).selectExpr("h", f"ln({1 + total}D / (1 + df)) + 1 as idf"), "rarity")
    light = F.broadcast if rarity.count() <= BROADCAST_SHINGLES else (lambda x: x)
    top = float(__import__("math").log(1 + total)) + 1.0
    weighed = spread.groupBy("wid", "h").agg(F.count("*").alias("n")).join(light(rarity), "h").groupBy("wid").agg(F.collect_list(F.expr("struct(h, n * idf as w)")).alias("iw"))
    items_w = written(known.join(weighed, "wid").selectExpr("wid", "n_words", "array_sort(iw) as iw").selectExpr("wid", "n_words", "iw", f"{_simhash('iw')} as ifp"), "items")
    shingle_rows = written(known.select("n_words", "k", F.posexplode("hs").alias("at", "h")).distinct(), "items")
    shingle_rows_count = shingle_rows.count()
    hint = F.broadcast if shingle_rows_count <= BROADCAST_SHINGLES else (lambda x: x)

    # where windows lie: documents by their own two hashes, of id and text
    who = ["xxhash64(doc_id, text) as d1", "xxhash64(1, doc_id is null, doc_id, text) as d2"]
    base = docs.selectExpr(*who, f"{split} as words")
    found = None
    for k in widths:
        runs = base.selectExpr("d1", "d2", f"posexplode({_shingles('words', k)}) as (p, h)")
        hit = runs.join(hint(shingle_rows.where(F.col("k") == k).drop("k")), "h")
        hit = hit.selectExpr("d1", "d2", f"cast({k} as int) as k", "n_words", "p - at as start").distinct()
        found = hit if found is None else found.union(hit)
    laid = written(found.groupBy("d1", "d2").agg(F.collect_set(F.struct("k", "n_words", "start")).alias("laid")), "hits")
    hint = F.broadcast if (laid.agg(F.sum(F.size("laid"))).first()[0] or 0) <= BROADCAST_HITS else (lambda x: x)
    there = docs.selectExpr("doc_id", "text", *who).join(hint(laid), ["d1", "d2"]).selectExpr("doc_id", "d1", "d2", f"{split} as words", "laid")
    start = "greatest(0, least(x.start, size(words) - x.n_words))"
    cuts = there.selectExpr("doc_id", "d1", "d2", f"explode(array_distinct(transform(laid, x -> struct(x.k as k, x.n_words as n_words, {start} as start_word, slice(words, {start} + 1, x.n_words) as ws)))) as y")
    sized_w = "case k " + " ".join(f"when {k} then {_shingles('ws', k)}" for k in widths) + " end"
    cut = cuts.select("doc_id", "d1", "d2", "y.*").selectExpr("doc_id", "d1", "d2", "n_words", "start_word", f"{sized_w} as hs")
    cut = written(cut.selectExpr("doc_id", "d1", "d2", "n_words", "start_word", "xxhash64(n_words, hs) as wk", "hs"), "windows")
    distinct = written(cut.groupBy("wk").agg(F.first("n_words").alias("n_words"), F.first("hs").alias("hs")), "windows")
    each = distinct.selectExpr("wk", "n_words", "explode(hs) as h").groupBy("wk", "n_words", "h").agg(F.count("*").alias("n"))
    each = each.join(light(rarity), "h", "left").selectExpr("wk", "n_words", f"struct(h, n * coalesce(idf, {top!r}D) as w) as x")
    windows = each.groupBy("wk", "n_words").agg(F.array_sort(F.collect_list("x")).alias("ww"))
    windows = written(windows.selectExpr("wk", "n_words", "ww", f"{_simhash('ww')} as wfp"), "windows")

    flips = f"array(0, {', '.join(str(1 << b) for b in range(BLOCK))})"
    index = items_w.selectExpr("wid", "n_words", "ifp", f"posexplode({_blocks('ifp')}) as (b, v)").selectExpr("wid", "n_words", "ifp", "b", f"explode(transform({flips}, f -> v ^ f)) as v")
    index = F.broadcast(index) if total <= BROADCAST_INDEX else index
    probes = windows.selectExpr("wk", "n_words", "wfp", f"posexplode({_blocks('wfp')}) as (b, v)")
    near = probes.join(index, ["n_words", "b", "v"]).where(f"{_apart('wfp', 'ifp')} <= {RADIUS}").select("wk", "wid")
    # the exact way for the rest: an item's shingles from rare to common, up to where what is left can't reach the threshold
    part = items_w.selectExpr("wid", "n_words", "explode(iw) as x").selectExpr("wid", "n_words", "x.h as h", "x.w as w")
    left = F.sum("w").over(W.partitionBy("wid").orderBy("w", "h"))
    rare = part.withColumns({"left": left, "mass": F.sum("w").over(W.partitionBy("wid"))}).where(F.col("left") >= threshold * F.col("mass") - 1e-5 * F.col("mass")).select("n_words", "h", "wid")
    rare = F.broadcast(rare) if light is F.broadcast and shingle_rows_count <= BROADCAST_SHINGLES else rare
    missed = windows.selectExpr("wk", "n_words", "explode(ww) as x").selectExpr("wk", "n_words", "x.h as h").join(rare, ["n_words", "h"]).select("wk", "wid")
    near = near.union(missed).distinct()
    both = near.join(windows.select("wk", "n_words", "ww", "wfp"), "wk").join(items_w.select("wid", "iw", "ifp"), "wid").withColumn("hamming", F.expr(_apart("wfp", "ifp")))
    least = "aggregate(ww, 0.0D, (a, x) -> a + coalesce(aggregate(filter(iw, y -> y.h = x.h), 0.0D, (s, y) -> s + least(y.w, x.w)), 0.0D))"
    mass = lambda a: f"aggregate({a}, 0.0D, (s, y) -> s + y.w)"
    scored = both.selectExpr("wk", "wid", "hamming", f"{least} as low", f"{mass('ww')} + {mass('iw')} as mass")
    scored = scored.selectExpr("wk", "wid", "hamming", "round(low / (mass - low), 6) as similarity").where(F.col("similarity") >= threshold)
    scored = written(scored, "scored")
    few = F.broadcast if scored.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS else (lambda x: x)
    hits = cut.select("doc_id", "d1", "d2", "n_words", "start_word", "wk").join(few(scored), "wk")
    best = hits.groupBy("doc_id", "d1", "d2", "wid").agg(F.max_by(F.struct("start_word", "n_words", "hamming", "similarity"), F.struct("similarity", -F.col("start_word"))).alias("x"))
    names = named.select("item_id", "wid")
    return best.join(F.broadcast(names) if total <= BROADCAST_HITS and names.count() <= BROADCAST_HITS else names, "wid").select("doc_id", "item_id", "x.start_word", "x.n_words", "x.hamming", "x.similarity")


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.75, width: int = 5) -> DataFrame:
    """The rows of docs that repeat no item, with all their columns. Rows of one text stay or go together, whatever their ids; an empty table gives no rows."""
    texts = docs.select(F.struct(*text_id()).alias("doc_id"), "text")  # whether a row goes hangs on its text alone
    with scratch() as keep:
        bad = keep(written(leaks(texts, items, threshold, width).select(F.col("doc_id").alias("leaky")).distinct(), "leaky"))
    few = F.broadcast if bad.limit(BROADCAST_LEAKY + 1).count() <= BROADCAST_LEAKY else (lambda x: x)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct(*text_id()).alias("own"))  # so that no column of docs can clash
    return rows.join(few(bad), F.col("own") == F.col("leaky"), "left_anti").select("row.*")
