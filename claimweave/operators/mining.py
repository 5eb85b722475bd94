"""G7 and G9 by pruned candidates: correlated entities and sequences in time, without a row for every pair of a document or a window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimweave.functions.tables import discard, written
from claimweave.functions.workers import ready


def significance(co: F.Column, c1: F.Column, c2: F.Column, total: F.Column) -> F.Column:
    """The chi-square of a count against chance, a twentieth of it, at most 1; 0.1 where chance alone gives less than 5, 0 without counts."""
    expected = c1 * c2 / total
    return F.when((c1 == 0) | (c2 == 0) | (total == 0), 0.0).when(expected < 5, 0.1).otherwise(F.least(F.lit(1.0), F.pow(co - expected, 2) / expected / 20))


HEAVY = 256  #: entities from which on a document's pairs are not listed
FEW = 2_000  #: entities whose pairs are counted where the documents lie
SPLIT = 50_000  #: documents of an entity from which on its partners are dealt over several tasks
ROWS = 500_000  #: rows of a task, about
BLOCK = 1 << 17  #: later entities of a block, about, at most: they are bits of each day's row
BITS = 1 << 28  #: days times entities of a block, about, at most
DAYS = 2_000_000  #: days of a block's entities, about, at most
SPOTS = 2_048  #: days whose bits are laid together
CHUNK = 2_048  #: earlier entities of a row
FIRST = 2_048  #: earlier entities judged first, about


def _light_pairs(m: DataFrame, few: bool, n: int) -> DataFrame:
    """a, ca, b, co: how many documents of m (doc, entity, c) pairs have together, a the rarer entity; a document's partners travel as one array."""
    lists = m.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("c", "entity"))).alias("es")).where("size(es) > 1")
    each = lists.select(F.expr("transform(es, x -> x.entity)").alias("ids"), F.posexplode("es").alias("i", "x"))
    each = each.select(F.col("x.entity").alias("a"), F.col("x.c").alias("ca"), F.expr("slice(ids, i + 2, size(ids))").alias("bs")).where("size(bs) > 0")
    if few:
        return each.select("a", "ca", F.explode("bs").alias("b")).groupBy("a", "ca", "b").agg(F.count("*").alias("co"))
    parts = each.withColumn("part", F.explode(F.expr(f"sequence(0, ca div {SPLIT})")))
    parts = parts.withColumn("bs", F.expr(f"if(ca < {SPLIT}, bs, filter(bs, b -> pmod(xxhash64(b), 1 + ca div {SPLIT}) = part))"))
    return parts.repartition(n, "a", "part").select("a", "ca", "part", F.explode("bs").alias("b")).groupBy("a", "ca", "part", "b").agg(F.count("*").alias("co")).drop("part")


def _heavy_pairs(light: DataFrame, m: DataFrame, need: F.Column) -> DataFrame:
    """light pairs and those of heavy documents: co with what m (doc, entity, c, size: the heavy documents' mentions alone) adds.

    Pairs that share no light document share one of the smallest c - need + 1 of the rarer entity's, all its light ones among them.
    """
    whole = W.partitionBy("entity")
    ranked = m.withColumns({"rank": F.row_number().over(whole.orderBy("size", "doc")), "many": F.count("*").over(whole)}).withColumn("ca", F.col("c"))
    prefix = ranked.where(F.col("rank") + F.col("c") - F.col("many") <= F.col("c") - need + 1)
    x, y = prefix.alias("x"), m.alias("y")
    rarer = (F.col("x.c") < F.col("y.c")) | ((F.col("x.c") == F.col("y.c")) & (F.col("x.entity") < F.col("y.entity")))
    met = x.join(y, (F.col("x.doc") == F.col("y.doc")) & rarer).select(F.col("x.entity").alias("a"), F.col("x.c").alias("ca"), F.col("y.entity").alias("b")).distinct()
    many = m.groupBy(F.col("entity").alias("a")).agg(F.count("*").alias("many"))
    near = light.union(met.withColumn("co", F.lit(0).cast("long"))).groupBy("a", "ca", "b").agg(F.sum("co").alias("co")).join(many, "a", "left")
    near = written(near.where(F.col("co") + F.coalesce("many", F.lit(0)) >= need).drop("many"), "candidates")
    more = near.select("a", "b").join(m.select(F.col("entity").alias("a"), "doc"), "a").join(m.select(F.col("entity").alias("b"), "doc"), ["b", "doc"]).groupBy("a", "b").agg(F.count("*").alias("more"))
    return near.join(more, ["a", "b"], "left").select("a", "ca", "b", F.expr("co + coalesce(more, 0)").alias("co"))


def frequent_pairs(mentions: DataFrame, least: int, share: float) -> DataFrame:
    """e1, e2, co, c1, c2: pairs e1 < e2 of entities in at least `least` documents together, and in that share of those of the rarer one (above 0).

    Pairs of documents of at most HEAVY entities are counted as they are listed, in one pass. In a heavier document only candidates are looked up:
    the rarer entity of such a pair has the other one in ceil(share * c) of its c documents, and so in one of any c - that + 1 of
    them, so only its smallest so many documents list partners. A document of very many entities is among the
    smallest of few, so it makes few pairs.
    """
    m = mentions.where("doc is not null and entity is not null").select("doc", "entity").distinct()
    c = written(m.groupBy("entity").agg(F.count("*").alias("c")).where(F.col("c") >= least), "counts")
    m = written(m.join(c, "entity"), "mentions")
    heavy = written(m.groupBy("doc").agg(F.count("*").alias("size")).where(F.col("size") > HEAVY), "heavy")
    any_, entities, n = not heavy.isEmpty(), *c.agg(F.count("*"), F.sum("c")).first()
    need = F.greatest(F.lit(least), F.ceil(F.col("ca") * share - 1e-9))
    parts = max(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), (n or 0) // ROWS)
    co = _light_pairs(m.join(heavy.select("doc"), "doc", "left_anti") if any_ else m, entities <= FEW, parts)
    if any_:
        co = _heavy_pairs(co, m.join(heavy, "doc"), need)
    co = co.where(F.col("co") >= need).join(c.select(F.col("entity").alias("b"), F.col("c").alias("cb")), "b")
    turn = F.col("a") < F.col("b")
    pick = lambda p, q: F.when(turn, F.col(p)).otherwise(F.col(q))
    out = written(co.select(pick("a", "b").alias("e1"), pick("b", "a").alias("e2"), "co", pick("ca", "cb").alias("c1"), pick("cb", "ca").alias("c2")), "pairs")
    discard(m, c, heavy)
    return out


def correlations(mentions: DataFrame, min_freq: int = 3, min_conf: float = 0.6, over: float = 0.5, top: int = 500) -> DataFrame:
    """e1, e2, co, c1, c2, conf12, conf21, lift, significance: pairs mentioned together often, in min_conf of one's documents, and significantly so.

    mentions: doc, entity; repeats count once, nulls go. Lift is co * N / (c1 * c2) with all N documents. The `top` by lift, ties by
    more documents together, then names.
    """
    n = mentions.where("doc is not null and entity is not null").agg(F.count_distinct("doc").alias("n"))  # one row
    p = frequent_pairs(mentions, min_freq, min_conf).crossJoin(F.broadcast(n))
    six = lambda e, c: F.round(e, 6).alias(c)
    sure = significance(F.col("co"), F.col("c1"), F.col("c2"), F.col("n"))
    out = p.withColumn("sure", sure).where(F.col("sure") > over)
    out = out.select("e1", "e2", "co", "c1", "c2", six(F.col("co") / F.col("c1"), "conf12"), six(F.col("co") / F.col("c2"), "conf21"), six(F.col("co") * F.col("n") / (F.col("c1") * F.col("c2")), "lift"), six(F.col("sure"), "significance"))
    return out.orderBy(F.desc("lift"), F.desc("co"), "e1", "e2").limit(top)


class _Block:
    """Entities that may come later: of each day a row of bits, which of them have a document within the `days` days after it."""

    def __init__(self, e, many, d, n, spots: np.ndarray, days: int):
        self.e, self.d, self.n, self.days = np.asarray(e), np.asarray(d, np.int64), np.asarray(n, np.int64), days
        self.ends = np.concatenate([[0], np.cumsum(np.asarray(many, np.int64))])
        words = -(-len(self.e) // 64)
        self.rows = np.zeros((len(spots), words), np.uint64)
        of = np.repeat(np.arange(len(self.e)), np.diff(self.ends))
        k = 0
        while k < len(spots):
            first = spots[k]
            end = int(np.searchsorted(spots, first + SPOTS))
            span = int(spots[end - 1] - first) + 1
            # a document on day y follows those of the days from y - days to y - 1: rows of single days, then of 2, 4 and so on together
            here = np.flatnonzero((self.d > first) & (self.d < first + span + days))
            on = np.zeros((span - 1 + days, words * 8), np.uint8)
            np.bitwise_or.at(on.reshape(-1), (self.d[here] - first - 1) * (words * 8) + (of[here] >> 3), np.left_shift(1, of[here] & 7).astype(np.uint8))
            on, size = on.view(np.uint64), 1
            while size * 2 <= days:
                on, size = on[:-size] | on[size:], size * 2
            if size < days:
                on = on[:span] | on[days - size : days - size + span]
            self.rows[k:end] = on[spots[k:end] - first]
            k = end

    def _places(self, word: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(word.view(np.uint8), count=len(self.e), bitorder="little"))

    def after_all(self, at: np.ndarray) -> np.ndarray:
        """Entities with a document soon after each of these days."""
        word = self.rows[at[0]].copy()
        for k, x in enumerate(at[1:].tolist()):
            word &= self.rows[x]
            if k & 3 == 3 and not word.any():
                return np.zeros(0, np.int64)
        return self._places(word)

    def after(self, at: np.ndarray, n: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Entities that come soon after `need` of the n documents of these days, and after how many: one counter for each entity, its digits in words."""
        digits: list[np.ndarray] = []
        for x, m in zip(at.tolist(), n.tolist(), strict=True):
            for b in range(m.bit_length()):
                if m >> b & 1:
                    carry = self.rows[x]
                    while b < len(digits) and carry.any():
                        digits[b], carry = digits[b] ^ carry, digits[b] & carry
                        b += 1
                    if carry.any():
                        digits += [np.zeros_like(carry) for _ in range(b - len(digits))] + [carry.copy()]
        if need >> len(digits):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        more, same = np.zeros_like(digits[0]), np.full_like(digits[0], np.iinfo(np.uint64).max)
        for b in reversed(range(len(digits))):
            if need >> b & 1:
                same &= digits[b]
            else:
                more |= same & digits[b]
                same &= ~digits[b]
        j = self._places(more | same)
        count = np.zeros(len(j), np.int64)
        for b, x in enumerate(digits):
            count += (x.view(np.uint8)[j >> 3] >> (j & 7) & 1).astype(np.int64) << b
        return j, count

    def followed(self, j: np.ndarray, days: np.ndarray) -> np.ndarray:
        """Documents of these entities that come soon after one of the days."""
        many = self.ends[j + 1] - self.ends[j]
        pair = np.repeat(np.arange(len(j)), many)
        day = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.ends[j], many)
        to = self.d[day]
        after = np.searchsorted(days, to) > np.searchsorted(days, to - self.days)
        return np.bincount(pair, weights=after * self.n[day], minlength=len(j)).astype(np.int64)


def _millionths(count, c):
    """The share count of c, rounded to 6 digits, as a whole number."""
    return (2_000_000 * count + c) // (2 * c)


def _least(c: int, least: int, share: float, low: tuple[int, int]) -> int:
    """The least count of an entity's c documents with which a pair is over the bounds and, by share and count, no worse than low; more than c if there is none."""
    good = lambda k: k >= least and k >= c * share - 1e-9 and (_millionths(k, c), k) >= low
    a, b = 1, c + 1
    while a < b:
        k = (a + b) // 2
        a, b = (a, k) if good(k) else (k + 1, b)
    return a


def _best(found: list[pd.DataFrame], top: int) -> pd.DataFrame:
    return pd.concat(found).sort_values(["q", "count1", "e1", "e2"], ascending=[False, False, True, True]).head(top)


def _judged(block: _Block, r, found: list[pd.DataFrame], spots: np.ndarray, least: int, share: float, top: int, whole: bool) -> list[pd.DataFrame]:
    """found, and what entities of a row make with those of a block: pairs over the bounds that may be among the `top`; whole: only those with a share of 1."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(r.many, np.int64))])
    d, n, cs = np.asarray(r.d, np.int64), np.asarray(r.n, np.int64), np.asarray(r.c, np.int64)
    at, low, needs, held = np.searchsorted(spots, d), (0, 0), {}, sum(len(x) for x in found)
    if held >= top:
        low = (int(found[0]["q"].iloc[-1]), int(found[0]["count1"].iloc[-1])) if len(found) == 1 and len(found[0]) == top else low
    for i in np.argsort(-cs, kind="stable").tolist():
        c, own = int(cs[i]), slice(ends[i], ends[i + 1])
        if c not in needs:
            needs[c] = _least(c, least, share, low)
        if (need := needs[c]) > c:
            continue
        if whole:
            j = block.after_all(at[own])
            count1 = np.full(len(j), c, np.int64)
        else:
            j, count1 = block.after(at[own], n[own], need)
            first = np.argsort(-count1, kind="stable")
            j, count1 = j[first], count1[first]
        kept = 0
        for k in range(0, len(j), 4_096):
            x, one = j[k : k + 4_096], count1[k : k + 4_096]
            if kept >= top and one[0] < last:  # noqa: F821
                break
            two = block.followed(x, d[own])
            on = (two >= least) & (block.e[x] != r.e[i])
            if not on.any():
                continue
            x, one, two = x[on], one[on], two[on]
            if kept < top <= kept + len(x):
                last = one[top - kept - 1]
            kept += len(x)
            found = [*found, pd.DataFrame({"e1": [r.e[i]] * len(x), "e2": block.e[x], "count1": one, "count2": two, "c1": c, "q": _millionths(one, c)})]
            held += len(x)
        if held > max(4 * top, 10_000):
            found = [_best(found, top)]
            held = len(found[0])
            low, needs = (int(found[0]["q"].iloc[-1]), int(found[0]["count1"].iloc[-1])), {}
    return [_best(found, top)] if found else []


def _first_rows(known: DataFrame, key: F.Column, kind: int) -> DataFrame:
    """Entities of a key as one row of arrays: kind, key, e, c, many, d, n."""
    lists = known.withColumn("key", key).groupBy("key").agg(F.collect_list(F.struct("entity", "c", "ds")).alias("rows"))
    each = lambda x: f"transform(rows, r -> {x})"
    return lists.selectExpr(f"{kind} as kind", "key", f"{each('r.entity')} as e", f"{each('r.c')} as c", f"{each('size(r.ds)')} as many", f"flatten({each('transform(r.ds, x -> x.d)')}) as d", f"flatten({each('transform(r.ds, x -> x.n)')}) as n")


def sequences(dated: DataFrame, days: int = 90, least: int = 3, share: float = 0.6, top: int = 50) -> DataFrame:
    """e1, e2, count1, count2, c1, share: e2 comes within `days` days after e1.

    dated: entity, doc, day; a document has one day. count1 are e1's documents with one of e2 at most `days` later, count2 those of e2 so
    preceded, both at least `least`; share, count1 of all c1 documents of e1, is at least that. The `top` by share, then count1, then names.

    Later entities are bits: of each day, which of a block's have a document soon after. Those that follow all documents of an
    entity are what its days' rows have in common. Of pairs of share 1 those of more documents are better, so entities of the most documents are
    judged first, against all, and none of fewer than the last of the `top` has. Only where that are fewer than `top`
    pairs are all counted, in words of 64 entities. The work is that of all pairs at worst, of a few bits for each; of a task's pairs only its `top` become rows.
    """
    d = dated.where("entity is not null and doc is not null and day is not null").select("entity", "doc", F.datediff("day", F.lit("1970-01-01").cast("date")).alias("d")).distinct()
    per = d.groupBy("entity", "d").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("c"), F.array_sort(F.collect_list(F.struct("d", "n"))).alias("ds")).where(F.col("c") >= least)
    known = written(per, "entities")
    spark = known.sparkSession
    ready(spark)
    kind = known.schema["entity"].dataType.simpleString()
    out = f"e1 {kind}, e2 {kind}, count1 long, count2 long, c1 long, q long"
    spots = np.array(sorted(r.d for r in known.select(F.explode("ds.d").alias("d")).distinct().collect()), np.int64)  # days, not documents
    sizes = sorted(((r.c, r.n) for r in known.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    entities, all_days = known.agg(F.count("*"), F.sum(F.size("ds"))).first()
    if not entities:
        return spark.createDataFrame([], out).selectExpr("e1", "e2", "count1", "count2", "c1", "cast(q as double) as share")
    blocks = max(-(-entities // max(64, min(BLOCK, BITS // max(len(spots), SPOTS + days)))) if BLOCK >= 64 else -(-entities // BLOCK), -(-all_days // DAYS))
    later = written(_first_rows(known, F.pmod(F.xxhash64("entity"), F.lit(blocks)).cast("int"), 0).withColumnRenamed("key", "block"), "blocks")
    parts = -(-2 * spark.sparkContext.defaultParallelism // blocks)  # each gets a block's entities

    def judge(low: int, high: int, many: int, whole: bool) -> DataFrame:
        """What entities of low to high documents, about many, make with all."""
        chunks = max(-(-many // CHUNK), min(parts, -(-many // 64)))
        earlier = _first_rows(known.where(F.col("c").between(low, high)), F.pmod(F.xxhash64("entity", F.lit(1)), F.lit(chunks)).cast("int"), 1)
        each = earlier.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "part": F.col("key") % parts}).drop("key")
        every = later.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        cols = ["block", "part", "kind", "e", "c", "many", "d", "n"]
        rows = every.select(cols).union(each.select(cols)).repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", "kind")

        def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block, found = None, []
            for pdf in batches:
                for r in pdf.itertuples():
                    if r.kind:
                        found = _judged(block, r, found, spots, least, share, top, whole) if block is not None else found
                    else:
                        block = None  # one at a time
                        block = _Block(r.e, r.many, r.d, r.n, spots, days)
            yield from found

        best = rows.mapInPandas(judged, out).orderBy(F.desc("q"), F.desc("count1"), "e1", "e2").limit(top)
        return written(best, "sequences")

    got, low, k, many = None, None, 0, FIRST
    while share <= 1 and k < len(sizes) and (low is None or sizes[k][0] >= low):
        high, some = sizes[k][0], 0
        many = max(many, entities // 64)
        while k < len(sizes) and (low is None or sizes[k][0] >= low) and some < many:
            some += sizes[k][1]
            k += 1
        new = judge(sizes[k - 1][0], high, some, True)
        if got is not None:
            new = written(got.union(new).orderBy(F.desc("q"), F.desc("count1"), "e1", "e2").limit(top), "sequences")
        got = new
        n, least1 = got.agg(F.count("*"), F.min("count1")).first()
        low = least1 if n >= top else None
        many *= 4
    if low is None:
        got = judge(least, sizes[0][0], entities, False)
    discard(known, later)
    return got.select("e1", "e2", "count1", "count2", "c1", F.round(F.col("count1") / F.col("c1"), 6).alias("share")).orderBy(F.desc("share"), F.desc("count1"), "e1", "e2").limit(top)
