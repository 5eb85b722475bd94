"""A training-corpus pipeline over the documents table; each stage is one operator of claimweave.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.

Stages keep all columns of docs, also others than those of documents, whatever their names, but for the last one, which
gives places. Ids may be null or repeated: rows are told apart by id and text. Rows that repeat both share their
fate, but for the second stage, which keeps one of them. An empty table gives no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimweave.llm import decontam, mixing, ngram_join, quality_rules, token_files
from claimweave.llm.common import table, written
from claimweave.llm.queries import vocabulary


def _compact(spark: SparkSession) -> None:
    """Stages' texts are written with Zstandard, which holds no direct buffers of whole pages beside the heap."""
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, whose cutoffs are certified on the labelled documents. Null and empty texts go; a null lang is a stratum of its own."""
    _compact(spark)
    return quality_rules.kept_only(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked by n-gram Jaccard similarity: the one with the smallest doc_id, null last. Texts without words all stay."""
    _compact(spark)
    return ngram_join.one_per_component(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item. Null and empty texts repeat none; rows of one text stay or go together."""
    _compact(spark)
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. A null source is a source; texts without words go."""
    _compact(spark)
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in token files that are written here: doc_id, start, n_tokens, ids_crc32. Null ids come first; null and empty texts are the end id alone."""
    return token_files.token_digest(docs, vocabulary())


STAGES = [("quality_rules", quality), ("ngram_jaccard", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("token_files", tokenize)]

#: Similarity links, certified cutoffs, SimHash and a tokenizer are beyond SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
