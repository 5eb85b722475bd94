"""Pairs of vectors, block by block: work is that of all pairs, by matrix products, but only what is asked for becomes rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.workers import ready

BLOCK = 4_000  #: vectors of a block, about: each vector is shuffled once for every second block
STRIP = 500  #: vectors of a block that are multiplied at a time


def _blocks(vectors: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """by, block, blocks, the columns of keep as arrays and the vectors one after another: about BLOCK vectors a row."""
    ready(vectors.sparkSession)
    sizes = vectors.groupBy(*by).agg(F.expr(f"cast(1 + count(*) div {BLOCK} as int)").alias("blocks"))
    key = F.xxhash64(*keep, F.to_json(F.col("embedding")))
    parted = vectors.join(sizes, by).withColumn("block", F.pmod(key, F.col("blocks")).cast("int"))
    kind = vectors.schema["embedding"].dataType.simpleString()  # floats travel as such
    rows = F.collect_list(F.struct(*keep, F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("e")))
    return parted.groupBy(*by, "block", "blocks").agg(rows.alias("rows")).select(*by, "block", "blocks", *(F.expr(f"transform(rows, r -> r.{c})").alias(c) for c in keep), F.expr("flatten(transform(rows, r -> r.e))").alias("e"))


def _unit(flat, n: int) -> np.ndarray:
    v = np.asarray(flat, np.float64).reshape(n, -1)
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _met(blocks: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Every block with itself and those after it, dealt evenly."""
    other = blocks.drop("blocks").withColumnsRenamed({c: f"{c}2" for c in ["block", "e", *keep]})
    return blocks.withColumn("block2", F.explode(F.expr("sequence(block, blocks - 1)"))).join(other, [*by, "block2"])


def _strips(r, k: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a row of _met strip by strip: where the strip starts, its keys, the other block's and the cosines.

    A block meets itself in its own order: the other side's may be another one, as collected rows come in any order.
    """
    own = r.block == r.block2
    a, b = np.asarray(getattr(r, k)), np.asarray(getattr(r, k if own else f"{k}2"))
    u = _unit(r.e, len(a))
    v = u if own else _unit(r.e2, len(b))
    for i in range(0, len(a), STRIP):
        yield i, a[i : i + STRIP], b, u[i : i + STRIP] @ v.T


def pair_stats(vectors: DataFrame, floors: list[float]) -> DataFrame:
    """Per topic over pairs of vectors (topic, source, embedding) from different sources: pairs, over1, over2, ... (above each floor), mean, most."""
    good = vectors.where("topic is not null and source is not null and embedding is not null").select("topic", F.col("source").cast("string").alias("source"), "embedding")
    met = _met(_blocks(good, ["topic"], ["source"]), ["topic"], ["source"])

    def count(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                for i, a, b, sims in _strips(r, "source"):
                    apart = a[:, None] != b[None, :]
                    if r.block == r.block2:
                        apart &= np.tri(len(a), len(b), k=i - 1, dtype=bool)
                    own = sims[apart]
                    if len(own):
                        out.append((r.topic, len(own), float(own.sum()), float(own.max()), *(int((own > x).sum()) for x in floors)))
            yield pd.DataFrame(out, columns=["topic", "pairs", "total", "most", *over])

    over = [f"over{k + 1}" for k in range(len(floors))]
    kind = good.schema["topic"].dataType.simpleString()
    parts = met.select("topic", "block", "block2", "source", "source2", "e", "e2").mapInPandas(count, f"topic {kind}, pairs long, total double, most double, " + ", ".join(f"{x} long" for x in over))
    return parts.groupBy("topic").agg(F.sum("pairs").alias("pairs"), *(F.sum(x).alias(x) for x in over), (F.sum("total") / F.sum("pairs")).alias("mean"), F.max("most").alias("most"))


def vector_join(vectors: DataFrame, key: str, floor: float) -> DataFrame:
    """A, b, similarity of all pairs a < b of vectors (key, embedding) with a cosine of at least the floor. Exact; null keys or vectors are left out."""
    good = vectors.where(F.col(key).isNotNull() & F.col("embedding").isNotNull()).select(F.lit(0).alias("whole"), F.col(key).alias("k"), "embedding")
    met = _met(_blocks(good, ["whole"], ["k"]), ["whole"], ["k"])

    def found(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                for _, a, b, sims in _strips(r, "k"):
                    i, j = np.nonzero(sims >= floor)
                    x, y = a[i], b[j]
                    kept = x < y if r.block == r.block2 else x != y
                    yield pd.DataFrame({"a": np.minimum(x, y)[kept], "b": np.maximum(x, y)[kept], "similarity": sims[i, j][kept]})

    kind = good.schema["k"].dataType.simpleString()
    return met.select("block", "block2", "k", "k2", "e", "e2").mapInPandas(found, f"a {kind}, b {kind}, similarity double")
