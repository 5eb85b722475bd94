"""Structured Streaming jobs over the same column logic as the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def burst_counts(claims: DataFrame, days: int = 14, late: str | None = None) -> DataFrame:
    """Claims per topic and sliding window of `days` days by one day; `late` is the watermark of a stream."""
    at = claims.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    at = at.withWatermark("ts", late) if late else at
    return at.groupBy("topic", F.window("ts", f"{days} days", "1 day").alias("w")).agg(F.count("*").alias("n")).select("topic", F.col("w.start").alias("window_start"), "n")


def ingest(spark: SparkSession, inbox: str, checkpoint: str, apply: Callable[[DataFrame, int], None], schema: str) -> StreamingQuery:
    """Hands each batch of new chunk files to `apply`, once each, and stops when none is left."""
    lines = spark.readStream.schema(schema).json(inbox)
    return lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unseen(claims: DataFrame, late: str = "7 days") -> DataFrame:
    """Of a stream of claims (claim_id, ts, ...), each claim_id once within the watermark."""
    return claims.withWatermark("ts", late).dropDuplicatesWithinWatermark(["claim_id"])
