"""New chunk files to claims, entities and mentions, and new claims to vectors, each upserted exactly once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimweave.operators.entities import embed, hashed_ngrams, pattern_entities
from claimweave.operators.text import hashed_id, indicator_claims
from claimweave.streaming.sink import UpsertTable

CHUNKS = "source_file string, seq int, text string"  #: of the files that arrive, as JSON lines


def graph_tables(spark: SparkSession, root: str, buckets: int = 64) -> dict[str, UpsertTable]:
    """The tables of the ingest below root, with what happens to rows that come again."""
    made = lambda name, schema, key, policies: UpsertTable(spark, f"{root}/{name}", schema, key, policies, buckets=buckets)
    return {
        "chunks": made("chunks", "chunk_id string, source_file string, seq int, text string", ["chunk_id"], {"source_file": "first", "seq": "first", "text": "last"}),
        "claims": made("claims", "claim_id string, chunk_id string, claim_text string, confidence double", ["claim_id"], {"chunk_id": "first", "claim_text": "first", "confidence": "max"}),
        "entities": made("entities", "entity string, type string, confidence double", ["entity", "type"], {"confidence": "max"}),
        "mentions": made("mentions", "chunk_id string, entity string, type string, confidence double", ["chunk_id", "entity", "type"], {"confidence": "max"}),
    }


def extracted(chunks: DataFrame) -> dict[str, DataFrame]:
    """The rows that new chunks (source_file, seq, text) give each table. Blank and null texts give none; a chunk is its file and place."""
    own = chunks.where(F.trim("text") != "").select(hashed_id("chunk_", F.col("source_file"), F.col("seq").cast("string")).alias("chunk_id"), "source_file", "seq", "text")
    claims = indicator_claims(own.select(F.col("chunk_id").alias("doc_id"), "text")).select("claim_id", F.col("doc_id").alias("chunk_id"), "claim_text", "confidence")
    found = pattern_entities(own).select("chunk_id", "entity", "type", "confidence")
    return {"chunks": own, "claims": claims, "entities": found.select("entity", "type", "confidence"), "mentions": found}


def ingest_batch(tables: dict[str, UpsertTable], chunks: DataFrame, batch: int) -> None:
    """Upserts what a batch of chunks gives to every table; any number of times, with one outcome."""
    kept = chunks.persist()
    try:
        for name, rows in extracted(kept).items():
            tables[name].upsert(rows, batch)
    finally:
        kept.unpersist()


def stream_ingest(spark: SparkSession, inbox: str, root: str, buckets: int = 64, each: Callable[[DataFrame, int], None] | None = None, files: int = 1000) -> StreamingQuery:
    """Every chunk file of inbox, `files` a batch, to the tables below root; stops when none is left and goes on from there when started again."""
    tables = graph_tables(spark, root, buckets)
    lines = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", files).json(inbox)
    apply = each or (lambda chunks, batch: ingest_batch(tables, chunks, batch))
    return lines.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def vector_table(spark: SparkSession, root: str, buckets: int = 64) -> UpsertTable:
    """The vectors: one for each claim, the first it got."""
    return UpsertTable(spark, f"{root}/vectors", "claim_id string, text_md5 string, embedding array<double>", ["claim_id"], {"text_md5": "first", "embedding": "first"}, buckets=buckets)


def embed_batch(table: UpsertTable, claims: DataFrame, batch: int, encoder: Callable[[pd.Series], list] = hashed_ngrams) -> None:
    """Vectors for the claims (claim_id, claim_text) of a batch that have none yet; only those are encoded. Null ids and blank texts get none."""
    rows = claims.where("claim_id is not null and trim(claim_text) <> ''").select("claim_id", "claim_text").groupBy("claim_id").agg(F.min("claim_text").alias("claim_text"))
    fresh = rows.join(table.read().select("claim_id"), "claim_id", "left_anti")
    table.upsert(embed(fresh, "claim_text", encoder).select("claim_id", F.md5("claim_text").alias("text_md5"), "embedding"), batch)


def stream_embed(spark: SparkSession, claims: DataFrame, root: str, encoder: Callable[[pd.Series], list] = hashed_ngrams, buckets: int = 64) -> StreamingQuery:
    """A stream of claims (claim_id, claim_text) to one vector a claim, however often a claim or a batch comes."""
    table = vector_table(spark, root, buckets)
    return claims.writeStream.foreachBatch(lambda rows, batch: embed_batch(table, rows, batch, encoder)).option("checkpointLocation", f"{root}/vectors-checkpoint").trigger(availableNow=True).start()
