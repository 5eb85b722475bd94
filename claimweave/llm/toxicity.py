"""Toxicity (operator 5): FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs with one word between, hashed into 2**18
coordinates; beyond 256 of them each counts a little less, by the fourth root of their number.
Training takes a bounded sample of labelled documents (at most MOST_ROWS, those with the smallest hashes;
a document is a doc_id with a text, repeated rows are one), dealt over up to MOST_SHARDS tasks. Each task runs FTRL-proximal (per-coordinate rates, L1 and
L2) from the common state and returns how it changed z and n; Spark averages the changes for the next
of EPOCHS rounds. L1 leaves most weights at zero; what is broadcast is at most 2**18 numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import ready, written
from claimweave.llm.textkeys import U, mix, word_hashes

BITS = 18
MOST_ROWS = 40_000
MOST_SHARDS = 6
SHARD_ROWS = 4_000  #: rows that make a further shard worth while
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 4.0, 0.1


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct coordinates of a whole text; coordinate 0 is the constant."""
    w = word_hashes(text, punctuation=True)
    parts = [w, mix(w[:-1] * U(3) + w[1:]), mix(w[:-2] * U(5) + w[2:] + U(1))]
    got = np.unique(np.concatenate(parts) >> U(64 - bits)).astype(np.int64) if len(w) else np.zeros(0, np.int64)
    return np.concatenate(([0], got[got > 0]))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def _value(count: int) -> float:
    """Every feature of a text counts the same; many features count less each, but by the fourth root only."""
    return float((256.0 / max(256, count)) ** 0.25)


def _train(batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    z, n = (np.frombuffer(x).copy() for x in state.value)
    z0, n0 = z.copy(), n.copy()
    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["label"], strict=True):
            at = features(text)
            w, x = _weights(z[at], n[at]), _value(len(at))
            p = 1 / (1 + np.exp(-np.clip(w.sum() * x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    at = np.flatnonzero((z != z0) | (n != n0))
    yield pd.DataFrame({"at": at, "dz": (z - z0)[at], "dn": (n - n0)[at]})


def fit(labelled: DataFrame, most_rows: int = MOST_ROWS) -> np.ndarray:
    """Weights from doc_id, text, label (0 or 1). At most most_rows different documents are used, all where there are fewer."""
    spark = labelled.sparkSession
    ready(spark)
    rows = labelled.select(F.xxhash64("doc_id", "text").alias("o"), "text", F.col("label").cast("double").alias("label"))
    if labelled.count() > most_rows:
        keys = written(rows.select("o").distinct(), "keys")
        if keys.count() > most_rows:
            rows = rows.where(F.col("o") < hash_bound(keys, most_rows))
    rows = written(rows.groupBy("o").agg(F.first("text").alias("text"), F.max("label").alias("label")), "labelled")
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    shards = max(1, min(MOST_SHARDS, rows.count() // SHARD_ROWS))
    for _ in range(EPOCHS):
        state = spark.sparkContext.broadcast((z.tobytes(), n.tobytes()))
        dealt = rows.repartition(shards, F.expr(f"pmod(o, {shards})")).sortWithinPartitions("o").select("text", "label")
        steps = dealt.mapInPandas(lambda it, s=state: _train(it, s), "at long, dz double, dn double")
        got = steps.groupBy("at").agg(F.sum("dz").alias("dz"), F.sum("dn").alias("dn")).toArrow().to_pandas()
        z[got["at"]] += got["dz"] / shards
        n[got["at"]] += got["dn"] / shards
    return _weights(z, n)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.5) to docs; only text is looked at. Null text counts as empty."""
    spark = docs.sparkSession
    ready(spark)
    used = np.flatnonzero(weights)
    shared = spark.sparkContext.broadcast((used.astype(np.int32).tobytes(), weights[used].tobytes()))

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        table = np.zeros(1 << BITS)
        table[np.frombuffer(shared.value[0], np.int32)] = np.frombuffer(shared.value[1])
        out = []
        for text in texts:
            at = features(text)
            out.append(1 / (1 + np.exp(-np.clip(table[at].sum() * _value(len(at)), -35, 35))))
        return pd.Series(out, dtype=float)

    return docs.withColumn("score", of("text")).withColumn("predicted", F.expr("if(score >= 0.5, 1, 0)"))


def hash_bound(known: DataFrame, most_rows: int) -> int:
    """The bound under which the most_rows smallest hashes o of known lie; known has more rows than that.

    Found on counts of 4096 ranges, then of 4096 parts of the range that the bound is in, down to single hashes.
    """
    room, within, shift = most_rows, known, 52
    while True:
        steps = within.groupBy(F.shiftright("o", shift).alias("b")).agg(F.count("*").alias("n")).collect()
        for r in sorted(steps, key=lambda r: r.b):
            if r["n"] > room:
                break
            room -= r["n"]
        if not room or not shift:
            return r.b << shift
        within, shift = known.where(F.shiftright("o", shift) == r.b), max(0, shift - 12)


def classify(docs: DataFrame, labels: DataFrame, held_out, most_rows: int = MOST_ROWS) -> DataFrame:
    """Documents (doc_id, text, ...) and labels (doc_id, toxic) -> doc_id, held_out, score, predicted.

    held_out is a condition on doc_id; only other rows' labels are learned. Labels with null toxic or
    doc_id are unused; of several labels of a doc_id the largest counts. Without labels every score is
    0.5. A null doc_id isn't held out. Repeated rows are scored alike; other columns are ignored; an empty
    table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"), F.xxhash64("doc_id").alias("o"))
    known = known.where(~F.coalesce(held_out, F.lit(False)))
    total = known.count()
    if total > most_rows:
        end = hash_bound(known, most_rows)
        known, rows_in = known.where(F.col("o") < end), rows.where(F.xxhash64("doc_id") < end)
    else:
        rows_in = rows
    weights = fit(rows_in.where("not held_out").join(known.select("doc_id", "label"), "doc_id"), most_rows)
    return score(rows, weights).drop("text")
