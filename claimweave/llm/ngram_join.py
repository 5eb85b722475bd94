"""N-gram Jaccard join (operator 10): a size-aware heavy-light set join.

Each text is the set of its distinct word shingles. Texts with one set are one class, so copies cost
one row per task and never meet in pairs. Two classes link when their Jaccard similarity reaches the
threshold t, which for sizes n <= m needs c(n, m) = ceil(t (n + m) / (1 + t)) shared shingles.

* Light sets (size up to a boundary B) enumerate, for every possible partner size, their subsets of
  c(n, m) shingles. Two light sets link exactly if they share such a subset: no check is needed.
* Heavy sets put a prefix of their shingles into inverted lists. Shingles are ordered from rare to
  common by a count sketch of fixed size, so what many texts share stands last, out of the prefixes.
  Any order is right; a good one keeps the lists short. Two sets that link share at least
  c - max(n - p(n), m - p(m)) prefix shingles, p the prefix lengths; pairs with fewer are dropped and
  the others are checked on their whole sets. Each entry carries its place in the order: the first
  shingle that two linked sets share stands at most at place n - c(n, m) of the one and m - c(n, m) of
  the other, so for each pair of sizes the prefixes are only as long as those two sizes need.
  Parities of 512 bits a set bound the number of differing shingles from below and drop further pairs.
* B is where the counted cost of subsets plus lists is least.

Lists are not expanded into all pairs. First each class meets only the smallest class of its lists and
is checked against the one it shares most with; classes so linked become components. In further rounds
the classes outside the largest component of their lists meet a class of that one, by a new draw in each
round. Then only pairs that lie in different components meet. No link between components is lost.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations
from math import ceil, comb, floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.llm.common import discard, may_be_among, nulled, ready, scratch, text_id, whole, written
from claimweave.llm.components import components
from claimweave.llm.textkeys import U, mix, shingle_set, signature

SKETCH_MOST = 23  #: the sketch has at most 2**23 counters, broadcast in 16 bits: 16 MB at any input size
ROUNDS = 1  #: star rounds after the first
LIGHT_MOST = 12  #: sets larger than this never enumerate subsets
HOT = 256  #: a shingle that the sketch counts more often, noise apart, may have a long list: that one is dealt over many tasks
SALTS = 64  #: parts of a long list at first
STAR = 1000  #: members of a star that are checked in one task
SEEN_MOST = 200_000  #: signatures a task remembers to skip further copies
PARITY = [f"b{k}" for k in range(8)]  #: columns of a set's 512 parity bits
_PART = 1 << 12


def shared_needed(n: int, m: int, t: Fraction) -> int:
    return ceil(t * (n + m) / (1 + t))


def partner_sizes(n: int, t: Fraction) -> range:
    return range(ceil(t * n), floor(n / t) + 1)


def prefix_length(n: int, t: Fraction) -> int:
    return n - ceil(t * n) + 1


def _subset_cost(n: int, t: Fraction) -> int:
    return sum(comb(n, shared_needed(n, m, t)) for m in partner_sizes(n, t) if shared_needed(n, m, t) <= min(n, m) and not (m == n and shared_needed(n, n, t) == n))


def light_boundary(sizes: dict[int, int], t: Fraction, list_weight: float = 4.0) -> int:
    """The B of least cost. sizes: classes by set size, for sizes a little over LIGHT_MOST.

    A list entry weighs list_weight subset keys: it is counted, joined and, if it matches, checked.
    """
    def cost(b: int) -> float:
        light = sum(k * _subset_cost(n, t) for n, k in sizes.items() if n <= b)
        return light + list_weight * sum(k * prefix_length(n, t) for n, k in sizes.items() if n > floor(t * b))

    return min(range(LIGHT_MOST + 1), key=lambda b: (cost(b), b))


def parity(sets: np.ndarray) -> np.ndarray:
    """512 bits as eight longs: bit b tells whether an odd number of hashes fall on b."""
    many = np.bincount((mix(sets ^ U(0x2127599BF4325C37)) >> U(55)).astype(np.int64), minlength=512)
    return np.packbits((many & 1).astype(np.uint8)).view("<i8")


def sketch_bits(texts: int) -> int:
    """Counters for about 16 shingles of each text, within bounds."""
    return max(12, min(SKETCH_MOST, (16 * max(1, texts) - 1).bit_length()))


def _digests(batches, text_at: str, width: int, bits: int):
    """Per text its set size and signature; per task the counters of all its shingles, in parts."""
    counts = np.zeros(1 << bits, np.uint32)
    for pdf in batches:
        rows = []
        for text in pdf[text_at]:
            got = shingle_set(text, width)
            rows.append((len(got), *signature(got), *parity(got)))
            np.add.at(counts, (got >> U(64 - bits)).astype(np.int64), 1)
        frame = pd.DataFrame(rows, columns=["n", "s1", "s2", *PARITY])
        yield frame.assign(**{c: pdf[c].to_numpy() for c in ("doc_id", "doc_id_null", "x1", "x2")}, part=-1, counts=None)
    for k in range(0, len(counts), _PART):
        if counts[k : k + _PART].any():
            zeros = {x: [0] for x in ("n", "s1", "s2", *PARITY, "doc_id", "x1", "x2")}
            yield pd.DataFrame({**zeros, "doc_id_null": [True], "part": [k // _PART], "counts": [counts[k : k + _PART].tobytes()]})


def _in_order(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the hashes from rare to common by the sketch; ties by hash."""
    bits = len(counts).bit_length() - 1
    return np.argsort(counts[(sets >> U(64 - bits)).astype(np.int64)], kind="stable")


def _entries(batches, text_at: str, width: int, t: Fraction, boundary: int, sketch):
    counts, seen = np.frombuffer(sketch.value, "<u2"), set()
    bits, long_list = len(counts).bit_length() - 1, HOT + 2 * float(np.minimum(counts, 1024).mean())
    for pdf in batches:
        keys, classes, sizes, gaps, hot = [], [], [], [], []
        for text in pdf[text_at]:
            got = shingle_set(text, width)
            n = len(got)
            if not n:
                continue
            s1, _ = signature(got)
            if s1 in seen:
                continue
            if len(seen) < SEEN_MOST:
                seen.add(s1)
            if n > floor(t * boundary):
                pre = got[_in_order(got, counts)[: prefix_length(n, t)]]
                keys.append(mix(pre))
                classes.append(np.full(len(pre), s1))
                sizes.append(np.full(len(pre), n, np.int32))
                gaps.append(-1 - np.arange(len(pre), dtype=np.int32))  # below 0: an entry of a prefix, and its place there
                hot.append(counts[(pre >> U(64 - bits)).astype(np.int64)] > long_list)
            if n <= boundary:
                made, wide = [], []
                for m in partner_sizes(n, t):
                    c = shared_needed(n, m, t)
                    if m > boundary or c > min(n, m) or (m == n and c == n):
                        continue
                    tag = U(((min(n, m) << 8 | max(n, m)) << 8 | c) * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF)
                    chosen = np.array(list(combinations(range(n), c)), dtype=np.int64)
                    made.append(mix(np.add.reduce(mix(got[chosen] ^ tag), axis=1, dtype=U) ^ tag))
                    wide.append(np.full(len(chosen), abs(m - n), np.int32))
                if made:
                    keys.append(np.concatenate(made))
                    classes.append(np.full(len(keys[-1]), s1))
                    sizes.append(np.full(len(keys[-1]), n, np.int32))
                    gaps.append(np.concatenate(wide))
                    hot.append(np.full(len(keys[-1]), counts[(got >> U(64 - bits)).astype(np.int64)].min() > long_list))
        if keys:
            yield pd.DataFrame({"h": np.concatenate(keys).astype(np.int64), "c": np.concatenate(classes).astype(np.int64), "n": np.concatenate(sizes), "gap": np.concatenate(gaps), "hot": np.concatenate(hot)})


def _added(batches):
    """Sums of the counters of each part, streamed: a task holds its parts' sums alone, however many tasks counted."""
    sums: dict[int, np.ndarray] = {}
    for pdf in batches:
        for part, x in zip(pdf["part"], pdf["counts"], strict=True):
            got = np.frombuffer(x, np.uint32)
            sums[part] = sums[part] + got if part in sums else got.astype(np.uint64)
    if sums:
        yield pd.DataFrame({"part": list(sums), "counts": [_rated(x).tobytes() for x in sums.values()]})


def _rated(counts: np.ndarray) -> np.ndarray:
    """Counts up to 2**32 in 16 bits, exact below 2**10 and in steps of a thousandth from there on."""
    high = 1024 + np.log2(np.maximum(counts, 1024) / 1024.0) * 1466
    return np.where(counts < 1024, counts, np.minimum(high, 65535)).astype("<u2")


def _sketch_bytes(parts: DataFrame, bits: int) -> bytes:
    """The sum of all tasks' counters, at most 2**SKETCH_MOST numbers of 16 bits whatever the input."""
    dealt = parts.select("part", "counts").repartition(max(1, min(64, (1 << bits) // _PART)), "part")
    table = np.zeros(1 << bits, "<u2")
    for r in dealt.mapInPandas(_added, "part int, counts binary").toArrow().to_pylist():
        table[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["counts"], "<u2")[: min(_PART, len(table))]
    return table.tobytes()


def _checked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, t: Fraction) -> DataFrame:
    """Of pairs (a, b) of classes, those whose whole sets reach the threshold, as (u, v), a written table; the texts that it reads are deleted."""
    stars = pairs.groupBy(F.col("a").alias("lead")).agg(F.expr(f"cast(1 + count(*) div {STAR} as int)").alias("salts"))
    members = pairs.select(F.col("b").alias("c"), F.col("a").alias("lead")).join(stars, "lead").select("c", "lead", F.expr("cast(pmod(xxhash64(c), salts) as int)").alias("salt"))
    roles = members.union(stars.select(F.col("lead").alias("c"), "lead", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))).distinct()
    needed = roles.select("c").distinct().join(classes.select("c", "s2", "rep"), "c").select("c", "s2", F.col("rep").alias("doc_id"))
    needed = written(needed, "needed")
    may_be = may_be_among(docs.sparkSession, needed.select(F.xxhash64("doc_id").alias("k")))
    there = written(docs.where(may_be(F.xxhash64("doc_id"))).select("doc_id", "text"), "texts")  # so that no task runs two Python workers at once
    texts = there.join(needed.withColumnRenamed("doc_id", "rep"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("c", "s2", "text")

    def sets(batches):
        for pdf in batches:
            out = []
            for c, s2, text in zip(pdf["c"], pdf["s2"], pdf["text"], strict=True):
                got = shingle_set(text, width)
                if signature(got) == (c, s2):  # another text may have the same doc_id
                    out.append((c, got.astype(np.int64)))
            yield pd.DataFrame(out, columns=["c", "xs"])

    known = texts.mapInPandas(sets, "c long, xs array<long>").dropDuplicates(["c"])
    dealt = roles.join(known, "c").select("lead", "salt", (F.col("c") != F.col("lead")).alias("member"), "c", "xs").repartition("lead", "salt").sortWithinPartitions("lead", "salt", "member")

    def check(batches):
        lead, own = None, None
        for pdf in batches:
            out = []
            for g, member, c, xs in zip(pdf["lead"], pdf["member"], pdf["c"], pdf["xs"], strict=True):
                if not member:
                    lead, own = g, np.asarray(xs)
                elif g == lead:
                    both = len(np.intersect1d(own, np.asarray(xs), assume_unique=True))
                    if both * t.denominator >= t.numerator * (len(own) + len(xs) - both):
                        out.append((g, c))
            yield pd.DataFrame(out, columns=["u", "v"])

    out = written(dealt.mapInPandas(check, "u long, v long"), "checked")
    discard(needed, there)
    return out


def _needed(n: str, m: str, t: Fraction) -> F.Column:
    p, q = t.numerator, t.denominator
    return F.expr(f"({p} * ({n} + {m}) + {p + q - 1}) div {p + q}")


def _sizes_allow(n: str, m: str, t: Fraction) -> F.Column:
    return F.expr(f"{t.numerator} * greatest({n}, {m}) <= {t.denominator} * least({n}, {m})")


def _enough(t: Fraction) -> F.Column:
    """Whether n and m allow a link and k shared prefix entries leave it possible."""
    kept = lambda a: F.expr(f"({t.numerator} * {a} + {t.denominator - 1}) div {t.denominator} - 1")  # noqa: E731  n - p(n)
    return _sizes_allow("n", "m", t) & (F.col("k") >= _needed("n", "m", t) - F.greatest(kept("n"), kept("m")))


def _in_reach(t: Fraction) -> F.Column:
    """Whether a shingle at x.pos and y.pos can be one that two linked sets share, and so early that their first must be.

    Linked sets differ in at most n + m - 2 c(n, m) shingles, and each of these flips one parity bit: sets whose
    parities differ in more bits don't link.
    """
    c = _needed("x.n", "y.n", t)
    most = F.expr("1 + least(x.pos, y.pos) + least(x.n - 1 - x.pos, y.n - 1 - y.pos)")
    apart = F.expr(" + ".join(f"bit_count(x.{b} ^ y.{b})" for b in PARITY))
    return _sizes_allow("x.n", "y.n", t) & (F.expr("x.n - x.pos") >= c) & (F.expr("y.n - y.pos") >= c) & (most >= c) & (apart <= F.expr("x.n + y.n") - 2 * c)


def jaccard_classes(docs: DataFrame, threshold: float = 0.75, width: int = 5) -> DataFrame:
    """Documents (doc_id, text, ...) -> doc_id, n_shingles, component_id.

    Words are runs of non-space characters with A-Z lower-cased; a text with fewer words than width is
    one shingle. Null and empty texts have size 0 and link with nothing: their component is their own
    doc_id. Repeated rows and equal texts share a component. component_id is the smallest non-null
    doc_id of the component; a null doc_id is a document like any other. Other columns are ignored. An
    empty table gives no rows. Shingles are compared by 64-bit hashes.
    """
    with scratch() as keep:
        found = keep(written(_placed(docs, threshold, width), "placed"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _placed(docs: DataFrame, threshold: float, width: int) -> DataFrame:
    """Documents -> doc_id, x1, x2 (the text's identity), n (its shingles), component, component_id; both null for n = 0.

    component tells components apart even where doc_ids are null or repeated.
    """
    spark, t = docs.sparkSession, Fraction(str(threshold))
    ready(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_id(), "text")
    bits = sketch_bits(docs.count())
    schema = f"n long, s1 long, s2 long, {', '.join(x + ' long' for x in PARITY)}, doc_id long, doc_id_null boolean, x1 long, x2 long, part int, counts binary"
    got = written(docs.select(*whole("doc_id"), "x1", "x2", "text").mapInPandas(lambda it: _digests(it, "text", width, bits), schema), "digests")
    digest = got.where("part < 0").select(nulled("doc_id"), "x1", "x2", "n", "s1", "s2", *PARITY)
    sketch = spark.sparkContext.broadcast(_sketch_bytes(got.where("part >= 0"), bits))
    classes = written(digest.where("n > 0").groupBy(F.col("s1").alias("c"), "s2").agg(F.min("doc_id").alias("rep"), F.first("n").cast("int").alias("n"), *(F.first(x).alias(x) for x in PARITY)), "classes")
    few = {r.n: r["k"] for r in classes.where(F.col("n") <= 2 * LIGHT_MOST).groupBy("n").agg(F.count("*").alias("k")).collect()}
    boundary = light_boundary(few, t)

    entries = docs.mapInPandas(lambda it: _entries(it, "text", width, t, boundary, sketch), "h long, c long, n int, gap int, hot boolean")
    # short lists are seen whole by one task; long ones in salted parts here, and whole from these parts' sums
    bounds = {"lo": "min(struct(c, n))", "hi": "max(c)", "n1": "min(n)", "n2": "max(n)"}
    parted = entries.withColumn("salt", F.expr(f"if(hot, pmod(xxhash64(c), {SALTS}), 0)"))
    listed = parted.selectExpr("h", "c", "n", "gap", "hot", *(f"{e} over (partition by h, salt) as {x}" for x, e in bounds.items()))
    listed = written(listed.where("hot or lo.c < hi"), "lists")
    sums = listed.where("hot").groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("n1").alias("n1"), F.max("n2").alias("n2")).where("lo.c < hi")
    long_ = listed.where("hot").select("h", "c", "n", "gap", "hot").join(sums, "h").select(*listed.columns)
    live = listed.where("not hot").union(long_).selectExpr("h", "c", "n", "gap", "hot", "lo", "n2 - n1 as wide").distinct()

    light = live.where("gap >= 0 and c <> lo.c and (gap = 0 or wide > 0)").select(F.col("lo.c").alias("u"), F.col("c").alias("v"))
    heavy = written(live.where("gap < 0").selectExpr("h", "c", "n", "hot", "-1 - gap as pos", "lo"), "heavy")
    stars = heavy.where("c <> lo.c").groupBy(F.col("lo.c").alias("a"), F.col("c").alias("b")).agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("lo.n").alias("m"))
    best = stars.where(_enough(t)).groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("a"))
    stars = written(best, "stars")
    first = written(_checked(docs, classes, stars, width, t).union(light).distinct(), "links")
    discard(listed)
    place = components(first)

    links, tried = first, stars.select("a", "b")
    lists = heavy.select("h", "c", "n", "hot", "pos")
    for k in range(ROUNDS + 1):
        sizes = place.groupBy("component").agg(F.count("*").alias("many"))
        sized = place.join(sizes, "component").withColumnRenamed("node", "c")
        placed = lists.join(sized, "c", "left").select("h", "c", "n", "hot", "pos", F.coalesce("component", "c").alias("g"), F.coalesce("many", F.lit(1)).alias("many"))
        told = {"lead": f"max(struct(many, -g as og, xxhash64(c, {k}) as draw, c, g, n))", "g1": "min(g)", "g2": "max(g)", "low": "min(n)"}
        short = placed.where("not hot").selectExpr("h", "c", "n", "hot", "pos", "g", *(f"{e} over (partition by h) as {x}" for x, e in told.items()))
        sums = placed.where("hot").groupBy("h").agg(*(F.expr(e).alias(x) for x, e in told.items())).where("g1 < g2")
        long_ = placed.where("hot").select("h", "c", "n", "hot", "pos", "g").join(sums, "h").select(*short.columns)
        before, placed = heavy if not k else placed, written(short.where("g1 < g2").union(long_).drop("g1", "g2"), "mixed")
        discard(before)
        lists = placed.select("h", "c", "n", "hot", "pos")
        if k == ROUNDS:
            break
        # every class outside the largest component of its lists meets a class of that one, each round another
        met = placed.where("g <> lead.g").groupBy(F.col("lead.c").alias("a"), F.col("c").alias("b")).agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("lead.n").alias("m"))
        fresh = met.where(_enough(t)).join(tried, ["a", "b"], "left_anti")
        best = written(fresh.groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("a")), "stars")
        if best.isEmpty():
            break
        tried = written(tried.union(best.select("a", "b")), "tried")
        links = written(links.union(_checked(docs, classes, best, width, t)), "links")
        place = components(links)
    # an entry whose place no set of its list is small enough to reach is left out
    p, q = t.numerator, t.denominator
    last = placed.where(F.expr(f"(n - pos) * {p + q} div {p} - n >= low")).select("h", "c", "n", "pos", "g").join(classes.select("c", *PARITY), "c")
    x, y = last.alias("x"), last.alias("y")
    both_sizes = {"n": F.first("x.n"), "m": F.first("y.n"), "i": F.max("x.pos"), "j": F.max("y.pos"), "k": F.count("*")}
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.g") < F.col("y.g")) & _in_reach(t)).groupBy(F.col("x.c").alias("a"), F.col("y.c").alias("b")).agg(*(v.alias(k) for k, v in both_sizes.items()))
    both = tried.union(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = written(met.where(F.col("k") + F.expr("least(n - 1 - i, m - 1 - j)") >= _needed("n", "m", t)).select("a", "b").join(both, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        place = components(links.union(_checked(docs, classes, rest, width, t)))

    known = classes.join(place.withColumnRenamed("node", "c"), "c", "left").select("c", "s2", "rep", F.coalesce("component", "c").alias("component"))
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = known.join(least, "component").select(F.col("c").alias("s1"), "s2", "component", "component_id")
    return digest.join(named, ["s1", "s2"], "left").select("doc_id", "x1", "x2", "n", "component", "component_id")


def _told(docs: DataFrame, threshold: float, width: int) -> DataFrame:
    """kept_id, kept1, kept2, kept: the documents of components with more than one, and which of them stays."""
    found = _placed(docs, threshold, width).where("n > 0").select("doc_id", "x1", "x2", "component")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("idless"), "doc_id", "x1", "x2")).alias("y"), F.count("*").alias("many")).where("many > 1")
    told = found.join(first, "component").select(F.col("doc_id").alias("kept_id"), F.col("x1").alias("kept1"), F.col("x2").alias("kept2"), F.expr("doc_id <=> y.doc_id and x1 = y.x1 and x2 = y.x2").alias("kept")).distinct()
    return written(told, "told")


def one_per_component(docs: DataFrame, threshold: float = 0.75, width: int = 5) -> DataFrame:
    """Keeps one row of each component: of the smallest doc_id, null last, and of its texts that of the smallest hash.

    All columns are kept. Texts without words all stay. Rows without links stay whatever doc_id they share. Of
    rows with one doc_id and text one stays, whichever. Only rows of components with more than one are shuffled.
    An empty table gives no rows.
    """
    with scratch() as keep:
        told = keep(_told(docs, threshold, width))
    may_be = may_be_among(docs.sparkSession, told.select(F.xxhash64("kept_id", "kept1", "kept2").alias("k")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), *text_id())
    wordless = F.coalesce(F.length(F.regexp_replace("row.text", r"[\x20\x09-\x0D]+", "")), F.lit(0)) == 0
    apart = may_be(F.xxhash64("id", "x1", "x2")) & ~wordless  # the rows of components with more than one, and a few others
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("x1") == F.col("kept1")) & (F.col("x2") == F.col("kept2"))
    one = rows.where(apart).join(told, same, "left").where(F.coalesce("kept", F.lit(True))).dropDuplicates(["id", "x1", "x2"])
    return rows.where(~apart).select("row.*").unionByName(one.select("row.*"))
