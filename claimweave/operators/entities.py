"""Entities and the graph build: names, matching, aliases, subjects, topics and the tables that extraction fills."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from claimweave.functions.letters import alike
from claimweave.functions.workers import ready
from claimweave.operators.components import components

# Title abbreviations, each followed by a period or a space; title words; acronyms; prefixes of ship names.
TITLES = {"gen": "General", "maj": "Major", "col": "Colonel", "lt": "Lieutenant", "capt": "Captain", "sgt": "Sergeant", "adm": "Admiral", "dr": "Doctor", "prof": "Professor", "mr": "Mister", "mrs": "Mistress", "ms": "Ms", "sen": "Senator", "rep": "Representative", "gov": "Governor", "pres": "President", "rev": "Reverend", "fr": "Father", "sr": "Sister"}
TITLE_WORDS = ["general", "major", "colonel", "lieutenant", "captain", "sergeant", "admiral", "doctor", "professor", "mister", "mistress", "ms", "senator", "representative", "governor", "president", "reverend", "father", "sister", "sir", "lord", "lady", "dame"]
ACRONYMS = ["USS", "NATO", "FBI", "CIA", "NSA", "USA", "UK", "UN", "EU", "CEO", "CFO", "CTO", "MD", "JD", "MBA", "BA", "BS", "MA", "WWII", "WWI", "NYPD", "LAPD", "IRS", "FDA", "CDC", "NIH", "MIT", "UCLA", "USC", "NYU", "USMC", "USAF", "USN", "HMS", "RMS", "SS", "MV"]
SHIP_PREFIXES = ["USS", "HMS", "RMS", "SS", "MV"]


def normalize_entity(name: Column) -> Column:
    """White space squeezed, title abbreviations at a word's start expanded (the first of each kind), title case but for acronyms.

    Null stays null. Words in mixed case, initials, short words in capitals with at most one vowel and the word after a
    ship prefix stay as they are.
    """
    out = F.trim(F.regexp_replace(name, r"\s+", " "))
    for short, full in TITLES.items():
        for end, kept in ((r"\.", ""), (" ", " ")):
            out = F.regexp_replace(out, rf"(?i)^(.*?)(?<!\p{{L}}){short}{end}", f"$1{full}{kept}")
    return _cased(out)


def _cased(x: Column) -> Column:
    """Title case word by word."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("keep"))
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))

    def step(s, w):
        few = (F.length(w) == 1) | ((F.length(w) <= 4) & (F.length(F.regexp_replace(w, "[^AEIOU]", "")) <= 1))
        upper, lower = (w == F.upper(w)) & (w != F.lower(w)), (w == F.lower(w)) & (w != F.upper(w))
        cased = F.when(s["keep"], w).when(F.upper(w).isin(ACRONYMS), F.upper(w)).when(upper, F.when(few, w).otherwise(capital(w))).when(lower, capital(w)).otherwise(w)
        return F.struct(F.concat(s["out"], F.array(cased)).alias("out"), (~s["keep"] & F.upper(w).isin(SHIP_PREFIXES)).alias("keep"))

    return F.aggregate(F.split(x, " "), start, step, lambda s: F.array_join(s["out"], " "))


def core_name(name: Column) -> Column:
    """A normalised name without title words; the name itself if it has no others."""
    core = F.array_join(F.filter(F.split(name, " "), lambda w: ~F.lower(w).isin(TITLE_WORDS)), " ")
    return F.when(core != "", core).otherwise(name)


# Fixed values of T10: patterns of persons and organisations, names that are no persons, concept words, words that make a phrase a concept.
PERSON_PATTERNS = [r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", r"\bDr\. [A-Z][a-z]+ [A-Z][a-z]+\b", r"\bProf\. [A-Z][a-z]+ [A-Z][a-z]+\b", r"\b[A-Z]\. [A-Z][a-z]+\b", r"\b[A-Z][a-z]+ [A-Z]\. [A-Z][a-z]+\b"]
ORGANIZATION_PATTERNS = [r"\b(?:CDC|NIH|FDA|WHO|EPA|NASA|NSF|DARPA|IEEE|USMC|USAF)\b", r"\bCompanyA\b|\bCompanyB\b|\bCompanyC\b", r"\b[A-Z][a-z]+ (?:University|Institute|Laboratory|Corp|Corporation)\b", r"\bDepartment of [A-Z][a-z]+\b", r"\b(?:Marine Corps|Air Force|Navy|Army)\b"]
NOT_PERSONS = ["The University", "New York", "United States", "Marine Corps"]
CONCEPT_WORDS = ["OODA loop", "Boyd cycle", "doctrine", "strategy", "tactics", "resilience", "stress", "ptsd", "depression", "anxiety", "trauma", "neuroscience", "brain", "cortex", "neural", "cognitive", "civilization", "archaeology", "ancient", "artifact", "consciousness", "awareness", "quantum", "reality", "vaccine", "clinical trial", "adverse event", "immune", "inflammation", "gene", "protein", "cell", "molecule", "receptor", "study", "research", "theory", "hypothesis", "mechanism"]
PHRASE_WORDS = ["loop", "cycle", "theory", "model", "framework"]
AUTHORS, AUTHOR, JOURNAL, PHRASE = r"(?i)Authors?\s*:\s*([^\n]+)", r"[A-Z][a-z]+(?: [A-Z]\.?)?(?: [A-Z][a-z]+)+", r"(?i)Journal\s*:\s*([^\n]+)", r"\b[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}\b"


def pattern_entities(chunks: DataFrame, boost: float | Column = 0.0, most: int = 20) -> DataFrame:
    """(chunk_id, text) -> chunk_id, rank, entity, type, confidence: names found by patterns, the first `most` of a chunk.

    In order: the first 10 authors of an author line and its journal (0.9), persons (0.7), organisations (0.8), the first place
    of each concept word (0.7), capitalised phrases with a concept's word (0.6); boost is added. Names equal but for case are
    one name of their type, spelt as found first. Null and empty texts give no rows; repeated rows are chunks of their own.
    """
    found = lambda p, of="text": F.regexp_extract_all(of, F.lit(f"(?U){p}"), 0)
    tagged = lambda names, kind, sure: F.transform(names, lambda n: F.struct(n.alias("entity"), F.lit(kind).alias("type"), F.lit(sure).alias("confidence")))
    line = F.regexp_replace(F.regexp_extract("text", JOURNAL, 1), r"\s+$", "")
    persons = F.filter(F.concat(*map(found, PERSON_PATTERNS)), lambda n: ~n.isin(NOT_PERSONS))
    concepts = F.filter(F.array(*(F.when(F.contains("low", F.lit(w.lower())), F.regexp_extract("text", rf"(?iU)\b{w}\b", 0)) for w in CONCEPT_WORDS)), lambda n: n != "")
    phrases = F.filter(found(PHRASE), lambda n: F.lower(n).rlike("|".join(PHRASE_WORDS)))
    names = F.concat(
        tagged(F.slice(found(AUTHOR, F.regexp_extract("text", AUTHORS, 1)), 1, 10), "Person", 0.9), tagged(F.filter(F.array(line), lambda n: F.length(n) > 5), "Organization", 0.9),
        tagged(persons, "Person", 0.7), tagged(F.concat(*map(found, ORGANIZATION_PATTERNS)), "Organization", 0.8), tagged(concepts, "Concept", 0.7), tagged(phrases, "Concept", 0.6),
    )
    more = boost if isinstance(boost, Column) else F.lit(boost)
    keyed = chunks.select("chunk_id", "text", more.alias("more"), F.lower("text").alias("low")).select("chunk_id", "more", names.alias("names"))
    keyed = keyed.withColumn("keys", F.transform("names", lambda n: F.concat(n["type"], F.lit(" "), F.lower(n["entity"]))))
    first = keyed.select("chunk_id", "more", "names", "keys", F.posexplode(F.slice(F.array_distinct("keys"), 1, most)).alias("rank", "key"))
    return first.withColumn("n", F.expr("element_at(names, cast(array_position(keys, key) as int))")).select("chunk_id", "rank", "n.entity", "n.type", F.round(F.col("n.confidence") + F.col("more"), 6).alias("confidence"))


def hashed_ngrams(texts: pd.Series, size: int = 256) -> list[np.ndarray]:
    """The built-in encoder: counts of the 3-letter pieces of padded lower-case words, hashed into `size` places."""
    import zlib

    out = []
    for text in texts:
        v = np.zeros(size)
        for word in (text or "").lower().split():
            padded = f" {word} "
            for k in range(len(padded) - 2):
                v[zlib.crc32(padded[k : k + 3].encode()) % size] += 1
        n = np.sqrt((v * v).sum())
        out.append(v / n if n else v)
    return out


def embed(df: DataFrame, text: str, encoder: Callable[[pd.Series], list] = hashed_ngrams) -> DataFrame:
    """Adds embedding (array<double>, unit length) by an encoder of a batch of texts; null and blank texts get zeros."""
    ready(df.sparkSession)
    made = F.pandas_udf(lambda texts: pd.Series(list(encoder(texts))), T.ArrayType(T.DoubleType()))
    return df.withColumn("embedding", made(F.col(text)))


def match_entities(new: DataFrame, known: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Each distinct name of new with the known entity it stands for: name, canonical, how (exact, alias, similar, new), confidence.

    known has canonical and aliases (array). Exact: equal normalised names or core names, in any case; alias: a listed
    alias; similar: the known name of highest cosine, at least the threshold; new: none, canonical is the normalised
    name. Of several the smallest canonical counts. Null and blank names are left out.
    """
    names = new.where(F.trim("name") != "").select("name").distinct().withColumn("norm", normalize_entity(F.col("name"))).withColumn("core", core_name(F.col("norm")))
    k = known.select("canonical", "aliases", normalize_entity(F.col("canonical")).alias("kn"))
    by_name = k.select("canonical", F.explode(F.array_distinct(F.array(F.lower("kn"), F.lower(core_name(F.col("kn")))))).alias("key")).groupBy("key").agg(F.min("canonical").alias("by_name"))
    by_alias = k.select("canonical", F.explode("aliases").alias("alias")).select(F.lower("alias").alias("key"), "canonical").groupBy("key").agg(F.min("canonical").alias("by_alias"))
    on = lambda df, col, out: df.withColumnsRenamed({"key": f"_{out}"}).select(F.col(f"_{out}").alias(f"k_{out}"), F.col(df.columns[1]).alias(out))
    out = names.join(on(by_name, "norm", "e1"), F.lower("norm") == F.col("k_e1"), "left").join(on(by_name, "core", "e2"), F.lower("core") == F.col("k_e2"), "left").join(on(by_alias, "name", "a"), F.lower("name") == F.col("k_a"), "left")
    out = out.select("name", "norm", "core", F.coalesce("e1", "e2").alias("exact"), F.col("a").alias("alias"))
    left = out.where("exact is null and alias is null").select(F.lower("core").alias("name"), F.lit(True).alias("fresh")).distinct()
    cores = k.select(F.lower(core_name(F.col("kn"))).alias("to"), "canonical").groupBy("to").agg(F.min("canonical").alias("canonical"))
    pairs = alike(left.union(cores.select("to", F.lit(False))), threshold)
    near = pairs.select(F.col("a").alias("n"), F.col("b").alias("to"), "similarity").union(pairs.select("b", "a", "similarity"))
    best = near.join(cores, "to").groupBy("n").agg(F.min(F.struct((-F.round("similarity", 6)).alias("s"), "canonical")).alias("top"))
    best = best.select("n", F.col("top.canonical").alias("similar"), (-F.col("top.s")).alias("sure"))
    out = out.join(best, F.lower("core") == F.col("n"), "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("alias").isNotNull(), "alias").when(F.col("similar").isNotNull(), "similar").otherwise("new")
    return out.select("name", F.coalesce("exact", "alias", "similar", "norm").alias("canonical"), how.alias("how"), F.when(how == "similar", F.col("sure")).when(how == "new", 0.0).otherwise(1.0).alias("confidence"))


def resolve_entities(names: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Name, canonical, aliases, tier: clusters of variants. Names link at a cosine of their core names of the threshold or more.

    The canonical name is the longest normalised one of its cluster, ties the smallest. tier of a name is SAME_AS where its
    core is at least 0.95 like the canonical's, else MAYBE_SAME_AS, null for the canonical itself. Null and blank names go.
    """
    n = names.where(F.trim("name") != "").select("name").distinct().withColumn("norm", normalize_entity(F.col("name"))).withColumn("core", core_name(F.col("norm")))
    pairs = alike(n.select(F.lower("core").alias("name")), threshold)
    found = components(pairs.select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v")))
    placed = n.withColumn("node", F.xxhash64(F.lower("core"))).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = placed.groupBy("component").agg(F.min(F.struct((-F.length("norm")).alias("o"), "norm", F.lower("core").alias("c"))).alias("y"), F.array_sort(F.collect_set("name")).alias("aliases"))
    like = pairs.where("similarity >= 0.95").select(F.col("a").alias("c1"), F.col("b").alias("c2")).union(pairs.where("similarity >= 0.95").select("b", "a"))
    out = placed.join(best, "component").select("name", "norm", F.lower("core").alias("c1"), F.col("y.norm").alias("canonical"), F.col("y.c").alias("c2"), "aliases").join(like.withColumn("same", F.lit(True)), ["c1", "c2"], "left")
    tier = F.when(F.col("norm") == F.col("canonical"), None).when(F.col("same") | (F.col("c1") == F.col("c2")), "SAME_AS").otherwise("MAYBE_SAME_AS")
    return out.select("name", "canonical", "aliases", tier.alias("tier"))


def extend_entities(known: DataFrame, new: DataFrame, threshold: float = 0.80) -> DataFrame:
    """T21 for names that come later: name, canonical, similarity, tier of all names, known clusters joined where new names link them.

    known: name, canonical, as resolve_entities gave them; new: name. Only pairs with a new name are compared; a known cluster stays
    whole. canonical is the longest normalised name of the cluster, ties the smallest. similarity is the carried cosine of a name's
    core to the canonical's, where they were compared or are equal, else of its best link in the cluster; tier is SAME_AS
    from 0.95 on, else MAYBE_SAME_AS, null for the canonical itself and for known names whose canonical stays. Null and blank
    names go; names that are known already count as known.
    """
    k = known.where(F.trim("name") != "").select("name", F.col("canonical").alias("was")).dropDuplicates(["name"])
    fresh = new.where(F.trim("name") != "").select("name").distinct().join(k, "name", "left_anti").withColumn("was", F.lit(None).cast("string"))
    all_ = k.union(fresh).withColumn("norm", normalize_entity(F.col("name"))).withColumn("core", F.lower(core_name(F.col("norm"))))
    pairs = alike(all_.select(F.col("core").alias("name"), F.col("was").isNull().alias("fresh")), threshold)
    node, held = F.xxhash64(F.lit("core"), "core"), F.xxhash64(F.lit("cluster"), "was")
    core = lambda c: F.xxhash64(F.lit("core"), c)
    links = pairs.select(core("a").alias("u"), core("b").alias("v")).union(all_.where("was is not null").select(node, held))
    placed = all_.withColumn("node", node).join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = placed.groupBy("component").agg(F.min(F.struct((-F.length("norm")).alias("o"), "norm", F.col("core").alias("c"))).alias("y"))
    both = pairs.select(F.col("a").alias("core"), F.col("b").alias("c"), "similarity").union(pairs.select("b", "a", "similarity"))
    own = both.groupBy("core").agg(F.max("similarity").alias("nearest"))
    out = placed.join(best, "component").select("name", "norm", "core", "was", F.col("y.norm").alias("canonical"), F.col("y.c").alias("c"))
    out = out.join(both, ["core", "c"], "left").join(own, "core", "left")
    sure = F.round(F.when(F.col("core") == F.col("c"), 1.0).otherwise(F.coalesce("similarity", "nearest")), 6)
    quiet = (F.col("norm") == F.col("canonical")) | F.coalesce(F.col("was") == F.col("canonical"), F.lit(False))
    tier = F.when(quiet, None).when(F.coalesce(sure, F.lit(0.0)) >= 0.95, "SAME_AS").otherwise("MAYBE_SAME_AS")
    return out.select("name", "canonical", sure.alias("similarity"), tier.alias("tier"))


def build_graph(extracted: DataFrame) -> dict[str, DataFrame]:
    """Chunks with their extracted entities and claims -> documents, chunks, entities, claims, contains, contains_claim, mentions.

    extracted has source_file, seq, text, entities array<struct<name, type, confidence>>, claims array<struct<claim_text,
    claim_type, confidence>>. Names are normalised; blank ones and repeats within a chunk go; an entity keeps its highest
    confidence. Null arrays count as empty; repeated chunks give one row.
    """
    chunk_id = F.concat(F.lit("chunk_"), F.substring(F.md5(F.concat_ws("_", "source_file", F.col("seq").cast("string"), F.substring("text", 1, 100))), 1, 12))
    c = extracted.withColumn("chunk_id", chunk_id).dropDuplicates(["chunk_id"])
    e = c.select("chunk_id", F.explode("entities").alias("e")).select("chunk_id", normalize_entity(F.col("e.name")).alias("entity"), F.col("e.type").alias("type"), F.col("e.confidence").alias("confidence")).where("entity <> ''")
    k = c.select("chunk_id", "source_file", F.explode("claims").alias("k")).select("chunk_id", "source_file", "k.*").where("trim(claim_text) <> ''")
    k = k.withColumn("claim_id", F.concat(F.lit("claim_"), F.substring(F.md5(F.concat_ws("_", "chunk_id", F.substring("claim_text", 1, 100))), 1, 12))).dropDuplicates(["claim_id"])
    return {
        "documents": c.groupBy("source_file").agg(F.count("*").alias("n_chunks")),
        "chunks": c.select("chunk_id", "source_file", "seq", "text"),
        "entities": e.groupBy(F.col("entity").alias("name")).agg(F.max("confidence").alias("confidence"), F.min("type").alias("type"), F.count("*").alias("frequency")),
        "claims": k.select("claim_id", "chunk_id", "source_file", "claim_text", "claim_type", "confidence"),
        "contains": c.select(F.col("source_file").alias("src"), F.col("chunk_id").alias("dst")),
        "contains_claim": k.select(F.col("chunk_id").alias("src"), F.col("claim_id").alias("dst")),
        "mentions": e.groupBy(F.col("chunk_id").alias("src"), F.col("entity").alias("dst")).agg(F.max("confidence").alias("weight")),
    }


def build_counts(graph: dict[str, DataFrame]) -> DataFrame:
    """Kind, n: one row per table of a built graph."""
    out = None
    for kind, df in sorted(graph.items()):
        row = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.union(row)
    return out


def link_topics(about: DataFrame, chunks: DataFrame, primary_from: int = 50) -> DataFrame:
    """Topic, n_documents, n_chunks, tier: primary from `primary_from` chunks on. about: source_file, topic; repeats count once, null topics go."""
    links = about.where("topic is not null").select("source_file", "topic").distinct()
    sizes = chunks.groupBy("source_file").agg(F.count("*").alias("k"))
    got = links.join(sizes, "source_file", "left").groupBy("topic").agg(F.count("*").alias("n_documents"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_chunks"))
    return got.withColumn("tier", F.when(F.col("n_chunks") >= primary_from, "primary").otherwise("secondary"))


def document_digest(claims: DataFrame, mentions: DataFrame, top_claims: int = 30, top_entities: int = 20) -> DataFrame:
    """Per doc its best claims by confidence and its most mentioned entities, as arrays in order. claims: doc, claim_id, confidence; mentions: doc, entity."""
    by = W.partitionBy("doc").orderBy(F.desc("confidence"), "claim_id")
    c = claims.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_claims).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("rank", "claim_id"))).alias("c"))
    m = mentions.groupBy("doc", "entity").agg(F.count("*").alias("k")).withColumn("rank", F.row_number().over(W.partitionBy("doc").orderBy(F.desc("k"), "entity"))).where(F.col("rank") <= top_entities)
    m = m.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("rank", "entity"))).alias("m"))
    return c.join(m, "doc", "full").select("doc", F.expr("transform(c, x -> x.claim_id)").alias("claims"), F.expr("transform(m, x -> x.entity)").alias("entities"))


# The words of each claim domain.
DOMAINS = {
    "medicine": ["medical", "health", "clinical", "disease", "treatment", "drug", "vaccine", "physician", "doctor"],
    "science": ["scientific", "research", "study", "laboratory", "experiment", "hypothesis", "data", "peer-review"],
    "military": ["military", "defense", "strategy", "tactical", "combat", "warfare", "intelligence", "operations"],
    "economics": ["economic", "financial", "market", "fiscal", "monetary", "trade", "gdp", "inflation"],
    "engineering": ["engineering", "technical", "design", "construction", "infrastructure", "mechanical", "civil"],
    "law": ["legal", "judicial", "court", "statute", "regulation", "constitutional", "attorney", "judge"],
    "history": ["historical", "ancient", "civilization", "archaeological", "dynasty", "empire", "period"],
    "climate": ["climate", "environmental", "atmospheric", "temperature", "carbon", "emission", "warming"],
    "education": ["educational", "pedagogical", "curriculum", "learning", "teaching", "academic", "student"],
    "technology": ["technology", "software", "hardware", "algorithm", "computing", "digital", "internet"],
}


def claim_domain(text: Column, domains: dict[str, list[str]] | None = None) -> Column:
    """The domain with most words in the text, ties the first listed; general without any, also for null."""
    domains = domains or DOMAINS
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.array(*(F.struct(F.size(F.filter(F.array(*map(F.lit, ws)), lambda w: F.contains(low, w))).alias("n"), F.lit(-k).alias("o"), F.lit(d).alias("d")) for k, (d, ws) in enumerate(domains.items())))
    best = F.array_max(hits)
    return F.when(best["n"] > 0, best["d"]).otherwise("general")


def authority_match(claim: Column, speaker: Column, kind: Column) -> Column:
    """domain_match_score, domain_drift, manipulation_risk of a claim's and a speaker's domain and the speaker's kind of authority."""
    met = (claim == speaker) | (speaker == "unknown")
    risk = F.when((kind == "celebrity") & ~met, "high").when((kind == "credential") & met, "low").otherwise("medium")
    return F.when(speaker.isNull(), F.struct(F.lit(0.5).alias("domain_match_score"), F.lit(False).alias("domain_drift"), F.lit("low").alias("manipulation_risk"))).otherwise(F.struct(F.when(met, 1.0).otherwise(0.3).alias("domain_match_score"), (~met).alias("domain_drift"), risk.alias("manipulation_risk")))


def truncate_chain(chain: Column, depth: int = 3) -> Column:
    """The first `depth` links of an attribution chain; null stays null."""
    return F.slice(chain, 1, depth)


def subject_from_path(docs: DataFrame, path: str, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Source path -> path, topic, kind, confidence 0.95, is_primary: every pattern (regex, topic, kind) that the path matches, the first one primary."""
    hits = F.filter(F.array(*(F.when(F.rlike(F.lower(path), F.lit(rx)), F.struct(F.lit(k).alias("o"), F.lit(topic).alias("topic"), F.lit(kind).alias("kind"))) for k, (rx, topic, kind) in enumerate(patterns))), lambda x: x.isNotNull())
    return docs.select(path, F.posexplode(hits).alias("at", "x")).select(path, "x.topic", "x.kind", F.lit(0.95).alias("confidence"), (F.col("at") == 0).alias("is_primary"))


def subject_from_frequency(mentions: DataFrame, least: int = 3, ratio: float = 0.3, top: int = 5) -> DataFrame:
    """Per doc the topics mentioned `least` times or more and at least `ratio` as often as the most mentioned: confidence 0.70 + 0.20 of that share; the `top` first. mentions: doc, topic, a row per mention."""
    n = mentions.groupBy("doc", "topic").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    share = F.col("n") / F.max("n").over(W.partitionBy("doc"))
    kept = n.withColumn("share", share).where(F.col("share") >= ratio).withColumn("rank", F.row_number().over(W.partitionBy("doc").orderBy(F.desc("n"), "topic")))
    return kept.where(F.col("rank") <= top).select("doc", "topic", "n", F.round(0.70 + 0.20 * F.col("share"), 6).alias("confidence"))


def merge_subjects(parts: DataFrame) -> DataFrame:
    """Doc, topic, confidence, is_primary over the rows of all methods: topics in any case are one, the highest confidence counts; where none is primary the best one becomes so."""
    one = parts.groupBy("doc", F.lower("topic").alias("key")).agg(F.max_by("topic", F.struct("confidence", "topic")).alias("topic"), F.max("confidence").alias("confidence"), F.max("is_primary").alias("is_primary"))
    w = W.partitionBy("doc")
    first = F.row_number().over(w.orderBy(F.desc("confidence"), "key")) == 1
    return one.withColumn("none", ~F.max("is_primary").over(w)).withColumn("first", first).select("doc", "topic", "confidence", (F.col("is_primary") | F.col("none") & F.col("first")).alias("is_primary"))
