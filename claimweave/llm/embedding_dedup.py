"""Embedding near-dedup (operator 11): product quantisation over coarse inverted lists, exact cosine rerank.

Vectors of one label and length are compared. Equal vectors of one label are one class, so copies never
meet in pairs. The index has

* coarse lists: unit centroids by k-means, in levels of 1, 2, 4, ... lists; a label takes the level that
  gives its lists about LIST classes. A class lives in the list of its nearest centroid;
* codes: of the residual to that centroid, one byte for each of PARTS stretches of the vector, and the
  length of what the code gets wrong.

Centroids and codebooks are fitted on a bounded sample; every class is indexed. A class is looked up in
its own list and in each list whose centroid it is nearly as close to: two vectors with a cosine of at
least the floor lie within d = sqrt(2 - 2 floor), and of two such in different lists at least one lies within
d / 2 of the plane midway between the two centroids. Probing all lists that near loses no pair. A probed
list is scanned by asymmetric distances, from tables of the exact query to each codeword. By the triangle
inequality a member within d has an estimate of at most d plus its code's error, so this filter loses none
either. What passes is reranked by the exact cosine in double precision. With `reach` below 0.5 fewer lists are
probed and recall is no longer certain.

Lists are dealt in blocks of at most about BLOCK members, and queries stream past a block in batches. Only
counts of links, and links that join a block's members to one another first, leave a task: at most one for
each query and member. So a dense group costs arithmetic, but no rows for its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import nulled, ready, whole, written
from claimweave.operators.components import components

LIST = 128  #: classes of a list, about
MOST_LEVEL = 14  #: at most 2**14 lists a label
SAMPLE = 65_536  #: classes that the index is fitted on, at most
SAMPLE_BYTES = 64 << 20  #: of the sample, and of what is broadcast, at most
PARTS = 8
CODES = 256
ROUNDS = 5  #: of k-means
APART = 0.8  #: cosine of the nearest two centroids
BLOCK = 2_000  #: members of a block, about
_SLACK = 1e-5  #: for single precision in what filters


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors, one row each, at length 1; scaled first, so that no square leaves the range of doubles."""
    v = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, ties the first, some rows at a time."""
    half, step = (centres * centres).sum(axis=1) / 2, max(1, (1 << 23) // len(centres))
    return np.concatenate([np.argmax(x[i : i + step] @ centres.T - half, axis=1) for i in range(0, len(x), step)])


def spread(x: np.ndarray, k: int) -> np.ndarray:
    """The first k rows of x, unit vectors, of which no two have a cosine over APART: a dense group gets few centres, whatever its share."""
    kept = x[:0]
    for i in range(0, len(x), 1024):
        part = x[i : i + 1024]
        if len(kept):
            part = part[(part @ kept.T).max(axis=1) <= APART]
        apart, alive = part @ part.T <= APART, np.ones(len(part), bool)
        for r in range(len(part)):
            if alive[r]:
                alive[r + 1 :] &= apart[r, r + 1 :]
        kept = np.concatenate([kept, part[alive]])
        if len(kept) >= k:
            break
    return kept[:k]


def k_means(x: np.ndarray, k: int, spherical: bool) -> np.ndarray:
    """At most k centres of the rows of x; a centre without rows stays. Spherical ones have length 1 and are spread."""
    centres = spread(x, k) if spherical else x[:k].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        order = np.argsort(own, kind="stable")
        found, first = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True)) if spherical else np.diff([*first, len(x)])[:, None]
        centres[found] = np.where(size > 0, sums / np.where(size > 0, size, 1), centres[found])
    return spread(centres, k) if spherical else centres


class Index:
    """Centroids by level and the codebooks, fitted on a sample of unit vectors and the levels of their labels."""

    def __init__(self, sample: np.ndarray, levels: np.ndarray) -> None:
        x = sample.astype(np.float32)
        self.width = x.shape[1]
        self.centroids = {int(k): k_means(x, min(1 << int(k), len(x)), True) for k in np.unique(levels)}
        rest = np.concatenate([x[levels == k] - c[nearest(x[levels == k], c)] for k, c in self.centroids.items()])
        self.cuts = np.linspace(0, self.width, min(PARTS, self.width) + 1).astype(int)
        self.books = [k_means(rest[:, a:b], min(CODES, len(rest)), False) for a, b in zip(self.cuts, self.cuts[1:])]

    def code(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, one row each, and the residuals that they stand for."""
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1).astype(np.uint8)
        return codes, self.decode(codes)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)

    def estimates(self, query: np.ndarray, codes: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Squared distances of queries (residuals to the list) from coded members: a table per part, looked up by the codes. far: squared lengths of the decoded."""
        dots = np.zeros((len(query), len(codes)), np.float32)
        for k, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            dots += (query[:, a:b] @ book.T)[:, codes[:, k]]
        return (query * query).sum(axis=1)[:, None] - 2 * dots + far[None, :]

    def probes(self, x: np.ndarray, level: int, margin: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """The list of each row and the other lists within margin of the plane between both centroids."""
        centres = self.centroids[level]
        home, others, step = nearest(x, centres), [], max(1, (1 << 23) // len(centres))
        for i in range(0, len(x), step):
            own = home[i : i + step]
            dots = x[i : i + step] @ centres.T
            apart = np.sqrt(np.maximum(0, 2 - 2 * (centres[own] @ centres.T)))
            rows = np.arange(len(own))
            near = dots[rows, own][:, None] - dots <= margin * apart + _SLACK
            near[rows, own] = False
            others += [np.flatnonzero(r) for r in near]
        return home, others


def _indexed(batches: Iterator[pd.DataFrame], index, margin: float, kind: str) -> Iterator[pd.DataFrame]:
    """Adds to classes their list, the other lists to probe, codes and the code's error."""
    ix: Index = index.value
    for pdf in batches:
        home, visits, codes, error = np.zeros(len(pdf), np.int64), [None] * len(pdf), [None] * len(pdf), np.zeros(len(pdf), np.float32)
        levels, sizes = pdf["level"].to_numpy(), pdf["dim"].to_numpy()
        for level, dim in sorted(set(zip(levels.tolist(), sizes.tolist(), strict=True))):
            at = np.flatnonzero((levels == level) & (sizes == dim))
            x = _padded(unit([pdf["v"][i] for i in at], kind), ix.width)
            home[at], found = ix.probes(x, level, margin)
            rest = x - ix.centroids[level][home[at]]
            made, near = ix.code(rest)
            error[at] = np.sqrt(((rest - near) ** 2).sum(axis=1))
            for i, f, c in zip(at, found, made, strict=True):
                visits[i], codes[i] = f.astype(np.int32), c.tobytes()
        yield pdf.assign(home=home.astype(np.int32), visits=visits, codes=codes, error=error)


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))).astype(np.float32)


class _Block:
    """The members of a block, what links to each, and which of them are joined so far."""

    def __init__(self, rows: pd.DataFrame, ix: Index, floor: float, kind: str) -> None:
        self.ix, self.floor, self.kind = ix, floor, kind
        self.c, self.many = rows["c"].to_numpy(), rows["many"].to_numpy()
        self.codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
        self.error = rows["error"].to_numpy().astype(np.float32)
        decoded = ix.decode(self.codes)
        self.far = (decoded * decoded).sum(axis=1)
        self.unit = unit(list(rows["v"]), kind)
        self.centre = ix.centroids[int(rows["level"].iloc[0])][int(rows["list"].iloc[0])]
        self.list = int(rows["list"].iloc[0])
        lengths = [len(v) for v in rows["visits"]]
        owner = np.repeat(np.arange(len(rows)), lengths)
        self.visits = np.sort(owner.astype(np.int64) << 20 | np.concatenate([np.asarray(v, np.int64) for v in rows["visits"]])) if sum(lengths) else np.zeros(0, np.int64)
        self.links = np.zeros(len(rows), np.int64)
        self.root = np.arange(len(rows))

    def met(self, vectors: np.ndarray) -> np.ndarray:
        """Which members each of some unit vectors links with: estimates first, what may be near then exactly."""
        reach = sqrt(2 - 2 * self.floor)
        query = _padded(vectors, self.ix.width) - self.centre
        out = self.ix.estimates(query, self.codes, self.far) <= (reach + self.error[None, :]) ** 2 + _SLACK
        rows, cols = np.flatnonzero(out.any(axis=1)), np.flatnonzero(out.any(axis=0))
        exact = vectors[rows] @ self.unit[cols].T >= self.floor
        out[np.ix_(rows, cols)] &= exact
        return out

    def join(self, hit: np.ndarray) -> np.ndarray:
        """Joins the members that each row hits to one another; returns a member for each row with a hit."""
        some = hit.any(axis=1)
        first = hit.argmax(axis=1)
        i, j = np.nonzero(hit)
        a, b = self.root[first[i]], self.root[j]
        for key in np.unique((a * len(self.c) + b)[a != b]).tolist():
            a, b = self.root[key // len(self.c)], self.root[key % len(self.c)]
            if a != b:
                self.root[self.root == max(a, b)] = min(a, b)
        return np.where(some, first, -1)

    def among(self) -> None:
        """Links of members with one another."""
        for i in range(0, len(self.c), 1000):
            hit = self.met(self.unit[i : i + 1000])
            own = np.arange(len(hit)), np.arange(i, i + len(hit))
            hit[own] = False
            self.links[i : i + 1000] += hit @ self.many
            hit[own] = True
            self.join(hit)

    def ask(self, rows: pd.DataFrame) -> Iterator[tuple]:
        """Links of queries with members: rows of c, links and of c, a linked member."""
        hit = self.met(unit(list(rows["v"]), self.kind))
        home, many = rows["home"].to_numpy().astype(np.int64), rows["many"].to_numpy()
        first = self.join(hit)
        yield rows["c"].to_numpy(), hit @ self.many, np.where(first >= 0, self.c[first], rows["c"].to_numpy())
        # a member that probes the query's list counts the pair there, as a query
        i, j = np.nonzero(hit)
        if len(i):
            asked = j << 20 | home[i]
            at = np.searchsorted(self.visits, asked)
            there = (home[i] != self.list) & (np.append(self.visits, -1)[at] == asked)
            np.add.at(self.links, j[~there], many[i[~there]])

    def told(self) -> tuple:
        return self.c, self.links, self.c[self.root]


def _linked(batches: Iterator[pd.DataFrame], index, floor: float, kind: str) -> Iterator[pd.DataFrame]:
    """c, links found, and a class it is linked to or itself; rows come by block, its members before its queries."""
    keys = ["lk", "list", "block"]
    held, block, now = [], None, None
    frame = lambda x: pd.DataFrame(dict(zip(("c", "links", "other"), x, strict=True)))

    def closed():
        made = block
        if held:
            made = _Block(pd.concat(held), index.value, floor, kind)
            made.among()
        return made

    for pdf in batches:
        spots = pdf[keys].to_numpy()
        ends = [0, *(np.flatnonzero((spots[1:] != spots[:-1]).any(axis=1)) + 1), len(pdf)]
        for a, b in zip(ends, ends[1:]):
            here = tuple(spots[a])
            if here != now:
                done = closed()
                if done:
                    yield frame(done.told())
                held, block, now = [], None, here
            part = pdf.iloc[a:b]
            asks = part["asks"].to_numpy()
            if not asks.all():
                held.append(part[~asks])
            if asks.any():
                block, held = closed(), []
                if block:  # a probed list may have no members
                    for x in block.ask(part[asks]):
                        yield frame(x)
    done = closed()
    if done:
        yield frame(done.told())


def near_duplicates(vectors: DataFrame, floor: float = 0.98, reach: float = 0.5) -> DataFrame:
    """Vectors (vec_id, embedding, label, ...) -> vec_id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null, their lengths are equal and their cosine is at least the floor.
    n_links counts the other rows that a row links with directly; component_id is the smallest vec_id reachable by
    links, its own included; kept says whether that is the row's own. Null, empty and zero vectors, and those that hold
    null or non-finite components, link with nothing. Every row is a vector of its own, repeated or not; a null vec_id is no
    component's smallest unless there is no other, and rows that share the smallest are all kept. Other columns are
    ignored; an empty table gives no rows. Equal vectors are told by 64-bit hashes. reach: how near to the plane between two
    lists' centroids a vector is looked up in both, as a share of the largest distance of a link; from 0.5 on no link is lost.
    """
    spark = vectors.sparkSession
    ready(spark)
    real = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    kind = "<f4" if real == "float" else "<f8"
    e = F.col("embedding").cast(f"array<{real}>")
    sound = F.size(e) > 0
    sound &= ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    sound = F.coalesce(sound & F.col("label").isNotNull(), F.lit(False))
    lk = F.xxhash64(F.col("label"), F.size(e))
    rows = vectors.select(*whole("vec_id"), sound.alias("sound"), lk.alias("lk"), e.alias("e"))
    rows = rows.select("vec_id", "vec_id_null", "sound", "lk", F.xxhash64("lk", "e").alias("c"), "e")
    ids = written(rows.select(nulled("vec_id"), "sound", F.when(F.col("sound"), F.col("c")).alias("c")), "ids")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = [np.asarray(x, kind).tobytes() for x in pdf["e"]]
            yield pd.DataFrame({"lk": pdf["lk"], "c": pdf["c"], "many": pdf["many"], "dim": [len(x) for x in pdf["e"]], "v": v})

    copies = rows.where("sound").groupBy("c").agg(F.first("lk").alias("lk"), F.count("*").alias("many"), F.first("e").alias("e"))
    classes = written(copies.mapInPandas(packed, "lk long, c long, many long, dim int, v binary"), "classes")
    labels = classes.groupBy("lk").agg(F.count("*").alias("n"))
    leveled = labels.select("lk", F.expr(f"cast(least({MOST_LEVEL}, greatest(0, floor(log2(n / {LIST}D)))) as int)").alias("level"))
    leveled = written(leveled, "levels")
    total, width = classes.agg(F.count("*"), F.max("dim")).first()
    if not total:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    most = max(CODES, min(SAMPLE, SAMPLE_BYTES // (4 * width)))
    leveled = leveled.withColumn("level", F.least("level", F.lit(max(0, int(log2(most / 2)))))) if most < 2 << MOST_LEVEL else leveled
    few = F.broadcast(leveled) if leveled.limit(100_001).count() <= 100_000 else leveled
    classes = classes.join(few, "lk")
    share = min(1.0, most / total)
    picked = classes.where(F.expr(f"pmod(xxhash64(c, 1), 1048576) < {share * 1048576}")).limit(most).select("c", "level", "dim", "v").toArrow().to_pandas()
    picked = picked.sort_values("c", kind="stable") if len(picked) else classes.limit(most).select("c", "level", "dim", "v").toArrow().to_pandas()
    x = np.concatenate([_padded(unit([v], kind), width) for v in picked["v"]])
    fitted = Index(x, picked["level"].to_numpy())
    for k in {r.level for r in leveled.select("level").distinct().collect()} - set(fitted.centroids):  # labels that the sample missed
        fitted.centroids[k] = k_means(x, min(1 << k, len(x)), True)
    index = spark.sparkContext.broadcast(fitted)

    margin = reach * sqrt(2 - 2 * floor)
    schema = "lk long, c long, many long, dim int, v binary, level int, home int, visits array<int>, codes binary, error float"
    placed = written(classes.select("lk", "c", "many", "dim", "v", "level").mapInPandas(lambda it: _indexed(it, index, margin, kind), schema), "indexed")
    lists = written(placed.groupBy("lk", F.col("home").alias("list")).agg(F.expr(f"cast(1 + count(*) div {BLOCK} as int)").alias("blocks")), "lists")
    light = F.broadcast(lists) if lists.count() <= 100_000 else lists
    block = F.expr("cast(pmod(xxhash64(c, 2), blocks) as int)")
    members = placed.withColumn("list", F.col("home")).join(light, ["lk", "list"])
    nothing = {"visits": F.expr("cast(array() as array<int>)"), "codes": F.lit(b""), "error": F.lit(0.0).cast("float")}
    columns = ["lk", "list", "block", "asks", "c", "many", "v", "level", "home", "visits", "codes", "error"]
    own = members.withColumn("block", block).withColumn("asks", F.lit(False)).select(*columns)
    # a member asks the blocks after its own, and a visitor all blocks of the list that it visits
    later = members.withColumn("at", block).where("at < blocks - 1").withColumn("block", F.explode(F.expr("sequence(at + 1, blocks - 1)")))
    away = placed.withColumn("list", F.explode("visits")).join(light, ["lk", "list"]).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    asks = [d.withColumns({**nothing, "asks": F.lit(True)}).select(*columns) for d in (later, away)]
    dealt = own.union(asks[0]).union(asks[1]).repartition("lk", "list", "block").sortWithinPartitions("lk", "list", "block", "asks")
    found = written(dealt.mapInPandas(lambda it: _linked(it, index, floor, kind), "c long, links long, other long"), "found")

    links = found.where("links > 0").groupBy("c").agg(F.sum("links").alias("links"))
    place = components(found.where("c <> other").select(F.col("c").alias("u"), F.col("other").alias("v")))
    told = classes.select("c", "many").join(links, "c", "left").join(place.withColumnRenamed("node", "c"), "c", "left")
    told = told.select("c", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "c").alias("component"))
    named = ids.join(told, "c", "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = named.join(least, "component", "left")
    root = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
