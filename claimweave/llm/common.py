"""Shared helpers: tables, the shared folder, lineage cuts, exact ids in Python tasks and bit tables of fixed size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import workers
from claimweave.functions.tables import discard, scratch, shared_dir, written  # noqa: F401  for the operators

#: Words are runs of anything but these characters (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20  #: of the batches that Python workers get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """workers.ready with smaller batches, as texts may be long."""
    workers.ready(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_id() -> list[F.Column]:
    """128 bits that stand for a row's text, as two longs x1 and x2."""
    return [F.xxhash64("text").alias("x1"), F.xxhash64(F.lit(1), "text").alias("x2")]


def whole(name: str) -> list[F.Column]:
    """A nullable long as two columns for Python tasks: its value, 0 for null, and name_null. So no batch turns it into floats."""
    c = F.col(name)
    return [F.coalesce(c.cast("long"), F.lit(0)).alias(name), c.isNull().alias(f"{name}_null")]


def nulled(name: str) -> F.Column:
    """The nullable long that whole() parted."""
    return F.when(~F.col(f"{name}_null"), F.col(name)).alias(name)


def may_be_among(spark: SparkSession, keys: DataFrame, bits: int = 24):
    """A function of a long column: whether the value may be among keys (one long column).

    A table of 2**bits bits is broadcast, 2 MB at any size of keys; what it lets through needs an exact join.
    """
    name = keys.columns[0]
    spots = keys.select(F.explode(F.array(name, F.shiftrightunsigned(name, 32))).alias("x")).select(F.expr(f"x & {(1 << bits) - 1}").alias("x"))
    words = spots.groupBy(F.shiftright("x", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("bits"))
    table = np.zeros(1 << (bits - 6), np.int64)
    got = words.toArrow().to_pandas()
    table[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(table.tobytes())

    @F.pandas_udf("boolean")
    def may_be(values: pd.Series) -> pd.Series:
        U = np.uint64
        known, k = np.frombuffer(shared.value, U), values.to_numpy(np.int64).astype(U)
        found = np.ones(len(k), bool)
        for x in (k, k >> U(32)):
            x = x & U((1 << bits) - 1)
            found &= (known[(x >> U(6)).astype(np.int64)] >> (x & U(63))) & U(1) == 1
        return pd.Series(found)

    return may_be
