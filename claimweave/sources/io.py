"""Sources and sinks of the claim graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = """content string, text string, chunk_text string, sequence_num int, source_file string, domain string, title string,
 context_metadata struct<source_file string, title string, author string, domain string, confidence_score double>,
 context struct<source_file string, title string, domain string>, metadata struct<source string, source_type string, chunk_index int, total_chunks int, doc_id string>"""


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of chunks: the text is the first of content, text, chunk_text; blank texts and bad lines are dropped."""
    raw = spark.read.schema(CHUNK + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    body = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in ("content", "text", "chunk_text")))
    source = F.coalesce("context_metadata.source_file", "context.source_file", "metadata.source", "source_file", F.lit("unknown"))
    out = raw.where("_bad is null").select(body.alias("text"), source.alias("source_file"), F.coalesce("context_metadata.title", "context.title", "title").alias("title"), F.coalesce("context_metadata.domain", "context.domain", "domain", F.lit("general")).alias("domain"), F.coalesce("sequence_num", "metadata.chunk_index").alias("seq"))
    return out.where("text is not null")


def read_text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Every plain-text file below a folder as a document."""
    return spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by label and edges by type, as partitioned Parquet."""
    nodes.write.partitionBy("label").parquet(f"{path}/nodes")
    edges.write.partitionBy("rel_type").parquet(f"{path}/edges")


def new_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """The files of listing (path, length) whose path and base name are not among known.source_file."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    names = known.select(base(F.col("source_file")).alias("_name")).distinct()
    return listing.withColumn("_name", base(F.col("path"))).join(names, "_name", "left_anti").drop("_name")


def infer_category(path: Column, rules: list[tuple[str, str]], otherwise: str = "general") -> Column:
    """The category of the first keyword that the path contains."""
    out = None
    for word, category in rules:
        hit = F.contains(F.lower(path), F.lit(word))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def import_metadata(documents: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """S3: doc, entity, frequency: mentions by name joined to known documents (doc, name) and entities (entity, name); comma lists are split, blank names dropped."""
    names = mentions.select("doc_name", F.explode(F.split("entity_names", ",")).alias("n")).select("doc_name", F.trim("n").alias("n")).where("n <> ''")
    d, e = documents.select("doc", F.col("name").alias("doc_name")), entities.select("entity", F.col("name").alias("n"))
    return names.join(d, "doc_name").join(e, "n").groupBy("doc", "entity").agg(F.count("*").alias("frequency"))


def import_graph(edges: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges after an import of src, dst, rel_type, weight: weights of one edge are added; rows without both ends go."""
    both = edges.select("src", "dst", "rel_type", "weight").unionByName(incoming.select("src", "dst", "rel_type", "weight")).where("src is not null and dst is not null")
    return both.groupBy("src", "dst", "rel_type").agg(F.sum("weight").alias("weight"))


def write_extracted(extracted: DataFrame, path: str) -> None:
    """Extraction results as JSON lines, nulls kept."""
    extracted.write.option("ignoreNullFields", False).json(path)


def read_extracted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_extracted wrote; bad lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


PROFILE = """name string, scoring struct<mode string, happenstance_max int, coincidence_max int, enemy_action_base double, logarithmic_factor double, max_score double>,
 signal_weights map<string, double>, score_levels map<string, double>, min_claims int, patterns map<string, struct<include array<string>, exclude array<string>>>"""


def load_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The calibration profiles in a folder of JSON files, a row each; fields that a file lacks are null."""
    return spark.read.schema(PROFILE).option("multiLine", True).json(folder)


def listing_counts(listing: DataFrame, known: DataFrame, per_chunk: int = 4000) -> DataFrame:
    """Extension, n_new, n_known, bytes, chunks (estimated): a folder's files (path, length) against the known ones, by base name."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    names = known.select(base(F.col("source_file")).alias("_name")).distinct().withColumn("_known", F.lit(True))
    got = listing.withColumn("_name", base(F.col("path"))).join(names, "_name", "left")
    return got.groupBy(F.lower(F.regexp_extract("_name", r"\.([^.]+)$", 1)).alias("extension")).agg(F.count_if(F.col("_known").isNull()).alias("n_new"), F.count("_known").alias("n_known"), F.sum("length").alias("bytes"), F.sum(F.ceil(F.col("length") / per_chunk)).alias("chunks"))


def infer_domain(path: Column, rules: list[tuple[str, str, float]], otherwise: str = "general") -> Column:
    """Domain and confidence of the first keyword that the path contains; the default at 0.3."""
    out = F.struct(F.lit(otherwise).alias("domain"), F.lit(0.3).alias("confidence"))
    for word, domain, sure in reversed(rules):
        out = F.when(F.contains(F.lower(path), F.lit(word)), F.struct(F.lit(domain).alias("domain"), F.lit(sure).alias("confidence"))).otherwise(out)
    return out
