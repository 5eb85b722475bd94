"""Ingestion transforms: chunks, ids, claims, entities, dates and lexicon scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The indicator words of claims, the word lists of emotion scans, pronouns, and words that start no entity.
CLAIM_INDICATORS = ["shows", "demonstrates", "proves", "indicates", "suggests", "reveals", "confirms", "establishes", "argues", "claims", "proposes", "asserts", "maintains", "contends", "states", "evidence", "research", "study", "findings", "analysis"]
FEAR = ["crisis", "disaster", "emergency", "unprecedented", "catastrophic", "collapse", "destroy", "threaten", "danger", "risk", "fatal", "deadly", "terrifying", "shocking", "horrific", "panic"]
ANGER = ["outrage", "outrageous", "unacceptable", "corrupt", "fraud", "scandal", "betrayal", "lie", "liar", "attack", "assault", "abuse", "violation", "criminal", "traitor"]
URGENCY = ["now", "immediately", "urgent", "act now", "don't wait", "limited time", "before it's too late", "right now", "critical", "must", "need to"]
PRONOUNS = ["he", "him", "his", "himself", "she", "her", "hers", "herself", "they", "them", "their", "theirs", "themselves", "it", "its", "itself", "who", "whom", "whose", "which", "that"]
NOT_ENTITIES = ["The", "This", "That", "These", "Those", "They", "It", "He", "She", "We", "You", "I", "A", "An"]


def chunk_words(docs: DataFrame, size: int = 1000, overlap: int = 200, min_words: int = 50) -> DataFrame:
    """(doc_id, text) -> doc_id, seq, chunk: word windows, up to the first one below min_words."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("ws") - min_words, F.lit(0)), F.lit(size - overlap)), lambda i: F.size("ws") - i >= min_words)
    chunks = F.transform(starts, lambda i: F.array_join(F.slice("ws", i + 1, F.lit(size)), " "))
    return docs.select("doc_id", words.alias("ws")).select("doc_id", F.posexplode(chunks).alias("seq", "chunk"))


def hashed_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first 12 hex digits of the md5 of the parts, joined by underscores."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("_", *parts)), 1, 12))


def sentences(docs: DataFrame, least: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep, seq, sentence: pieces between . ! ? of at least `least` characters. Null texts give none."""
    own = ["doc_id", *keep]
    return docs.select(*own, F.posexplode(F.split("text", "[.!?]+")).alias("seq", "s")).select(*own, "seq", F.trim("s").alias("sentence")).where(F.length("sentence") >= least)


def indicator_claims(docs: DataFrame, indicators: list[str] | None = None, least: int = 20, most: int = 500, per_doc: int = 30) -> DataFrame:
    """Sentences of fitting length with an indicator word, the first per_doc of each document, confidence 0.6."""
    found = F.exists(F.array(*map(F.lit, indicators or CLAIM_INDICATORS)), lambda w: F.contains(F.lower("sentence"), w))
    kept = sentences(docs, least).where((F.length("sentence") <= most) & found)
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy("seq"))).where(F.col("rank") <= per_doc)
    return ranked.select(hashed_id("claim_", F.col("doc_id").cast("string"), F.substring("sentence", 1, 100)).alias("claim_id"), "doc_id", "seq", F.col("sentence").alias("claim_text"), F.lit(0.6).alias("confidence"))


def copula_claims(docs: DataFrame, words: list[str]) -> DataFrame:
    """Sentences between periods with one of words and a capitalised word; confidence min(0.5 + 0.1 n, 0.9), n capitalised words."""
    pieces = docs.select("doc_id", F.posexplode(F.split("text", r"\.")).alias("seq", "s")).select("doc_id", "seq", F.trim("s").alias("sentence"))
    caps = F.size(F.regexp_extract_all("sentence", F.lit(r"\b([A-Z][a-z]+)"), 1))
    has = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.concat(F.lit(" "), F.lower("sentence"), F.lit(" ")), F.concat(F.lit(" "), w, F.lit(" "))))
    return pieces.where(has).withColumn("n_caps", caps).where("n_caps > 0").select("doc_id", "seq", "n_caps", F.round(F.least(0.5 + 0.1 * F.col("n_caps"), F.lit(0.9)), 6).alias("confidence"))


def caps_entities(docs: DataFrame, stop: list[str] | None = None, longest: int = 20) -> DataFrame:
    """Runs of capitalised words longer than 3 letters, each once per document, in order, at most `longest`."""
    runs = F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), 1)
    kept = F.filter(F.array_except(F.array_distinct(runs), F.array(*map(F.lit, stop or NOT_ENTITIES))), lambda e: F.length(e) > 3)
    return docs.select("doc_id", F.posexplode(F.slice(kept, 1, longest)).alias("rank", "entity"))


def needs_coref(docs: DataFrame, pronouns: list[str] | None = None) -> DataFrame:
    """Whether any token between white space is a pronoun, in any case; null for a null text."""
    return docs.select("doc_id", F.arrays_overlap(F.split(F.lower("text"), r"\s+"), F.array(*map(F.lit, pronouns or PRONOUNS))).alias("needs_coref"))


def section_date(text: str = "text") -> Column:
    """T5: the first date of a text written Month D, YYYY (in any case, the comma optional) or YYYY-MM-DD or M/D/YYYY, in this order; null without one."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    named = F.regexp_extract(text, rf"(?i)\b({months})\s+(\d{{1,2}}),?\s+(\d{{4}})\b", 0)
    named = F.initcap(F.regexp_replace(F.regexp_replace(named, ",", " "), r"\s+", " "))
    tries = [(named, "MMMM d yyyy"), (F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"), (F.regexp_extract(text, r"(\d{1,2}/\d{1,2}/\d{4})", 1), "M/d/yyyy")]
    return F.coalesce(*(F.try_to_timestamp(F.nullif(x, F.lit("")), F.lit(f)).cast("date") for x, f in tries))


def keyword_hits(text: Column, words: list[str]) -> Column:
    """The words of a list that occur in a text as substrings, in list order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))


def emotion_scan(df: DataFrame, text: str, fear: list[str] | None = None, anger: list[str] | None = None, urgency: list[str] | None = None) -> DataFrame:
    """Adds n_fear, n_anger, n_urgency, sentiment, intensity = min(1, 0.2 n), triggers and four flags.

    The sentiment is fear where it has more words than anger, else anger where it has any, else neutral.
    A null text has no words.
    """
    parts = {"n_fear": fear or FEAR, "n_anger": anger or ANGER, "n_urgency": urgency or URGENCY}
    hits = [keyword_hits(F.coalesce(F.col(text), F.lit("")), ws) for ws in parts.values()]
    out = df.select("*", *(F.size(h).alias(k) for k, h in zip(parts, hits, strict=True)), F.concat(*hits).alias("triggers"))
    total = F.expr("n_fear + n_anger + n_urgency")
    out = out.withColumn("sentiment", F.expr("case when n_fear > n_anger then 'fear' when n_anger > 0 then 'anger' else 'neutral' end")).withColumn("intensity", F.round(F.least(F.lit(1.0), total * 0.2), 6))
    flags = {"appeals_to_fear": "n_fear > 0", "appeals_to_anger": "n_anger > 0", "urgency_without_evidence": "n_urgency > 0", "loaded_language": "n_fear + n_anger + n_urgency > 2"}
    return out.select("*", *(F.expr(e).alias(k) for k, e in flags.items()))


def normalize_topic(raw: Column) -> Column:
    """Lower case, . , ; : ! ? and quotes trimmed at the ends, a light plural stripped: ies to y over 4 letters, es kept, s unless ss over 3."""
    t = F.regexp_replace(F.trim(F.lower(raw)), "^[.,;:!?\"']+|[.,;:!?\"']+$", "")
    n = F.length(t)
    return F.when(t.endswith("ies") & (n > 4), F.regexp_replace(t, "ies$", "y")).when(t.endswith("es") & (n > 4), t).when(t.endswith("s") & ~t.endswith("ss") & (n > 3), F.regexp_replace(t, "s$", "")).otherwise(t)


# The verbs of each relation type.
VERBS = {"CLAIMS": ["say", "tell", "claim", "state", "mention", "write", "publish"], "SUPPORTS": ["support", "agree", "confirm", "verify", "endorse"], "CONTRADICTS": ["contradict", "oppose", "deny", "refute", "criticize"]}


def map_relation(verb: Column) -> Column:
    """The relation type that a verb stands for, in any case; null and other verbs: RELATED_TO."""
    out, v = F.lit("RELATED_TO"), F.lower(verb)
    for kind, verbs in VERBS.items():
        out = F.when(v.isin(verbs), kind).otherwise(out)
    return out


def chunk_sentences(docs: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """(doc_id, text) -> doc_id, seq, chunk: whole sentences packed up to `size` characters, trailing ones of up to `overlap` carried over.

    A sentence longer than size is a chunk of its own. Null texts give none, an empty text one empty chunk.
    """
    kept = "aggregate(reverse(s.now), named_struct('on', true, 'n', 0, 'out', cast(array() as array<string>)), (k, x) -> if(k.on and k.n + length(x) <= {o}, named_struct('on', true, 'n', k.n + length(x), 'out', concat(array(x), k.out)), named_struct('on', false, 'n', k.n, 'out', k.out)), k -> named_struct('n', k.n, 'out', k.out))".format(o=overlap)
    # the carry is bound by a one-element transform, so that it is computed once
    cut = f"element_at(transform(array({kept}), c -> named_struct('done', concat(s.done, array(array_join(s.now, ' '))), 'now', concat(c.out, array(w)), 'n', c.n + length(w))), 1)"
    go = f"if(s.n + length(w) > {size} and size(s.now) > 0, {cut}, named_struct('done', s.done, 'now', concat(s.now, array(w)), 'n', s.n + length(w)))"
    fold = f"aggregate(split(text, '(?<=[.!?])\\\\s+'), named_struct('done', cast(array() as array<string>), 'now', cast(array() as array<string>), 'n', 0), (s, w) -> {go}, s -> concat(s.done, array(array_join(s.now, ' '))))"
    return docs.where("text is not null").selectExpr("doc_id", f"posexplode({fold}) as (seq, chunk)")


def basename(path: Column) -> Column:
    """T4: the last component of a path, either slash."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def shorten_path(path: Column, keep: int = 3) -> Column:
    """T4: the last `keep` components of a path."""
    parts = F.split(path, r"[/\\]")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - keep + 1, F.lit(1)), F.lit(keep)), "/")


# The forms of claims.
CLAIM_PATTERNS = [
    r"(?:shows?|demonstrates?|proves?|indicates?|suggests?|reveals?) that .{20,200}[.!]",
    r"(?:according to|based on|research shows|studies indicate) .{20,200}[.!]",
    r"(?:found|discovered|observed|concluded) that .{20,200}[.!]",
    r"(?:is|are|was|were) (?:significantly|dramatically|substantially) .{20,150}[.!]",
    r"(?:can|could|may|might) (?:result in|lead to|cause) .{20,150}[.!]",
    r"(?:effective|ineffective) (?:in|for|at) .{20,150}[.!]",
    r"(?:associated with|correlated with|linked to) .{20,150}[.!]",
]


def regex_claims(docs: DataFrame, patterns: list[str] | None = None, least: int = 30, per_doc: int = 20) -> DataFrame:
    """doc_id, rank, claim_text, confidence 0.5: the first match of each claim form in each sentence, by form, then sentence, the first per_doc.

    Sentences keep their end mark, which the forms ask for; a match has at least `least` characters.
    """
    forms = F.array(*(F.struct(F.lit(k).alias("form"), F.nullif(F.regexp_extract("s", f"(?is){p}", 0), F.lit("")).alias("hit")) for k, p in enumerate(patterns or CLAIM_PATTERNS)))
    pieces = docs.select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?])")).alias("seq", "s"))
    hits = pieces.select("doc_id", "seq", F.explode(forms).alias("x")).select("doc_id", "seq", "x.form", F.trim("x.hit").alias("claim_text")).where(F.length("claim_text") >= least)
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy("form", "seq"))).where(F.col("rank") <= per_doc)
    return ranked.select("doc_id", "rank", "claim_text", F.lit(0.5).alias("confidence"))


def parse_model_json(raw: Column, schema: str = "array<struct<claim_text: string, claim_type: string, confidence: double>>") -> Column:
    """The payload in a model's text: code fences and words around the outermost brackets go, trailing commas too.

    Where that is no JSON of the schema, the claim_text fields found in the text are recovered; null if there are none.
    """
    body = F.regexp_extract(F.regexp_replace(raw, r"```(?:json)?", ""), r"(?s)(\[.*\]|\{.*\})", 1)
    body = F.regexp_replace(body, r",\s*([\]}])", "$1")
    body = F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    got = F.from_json(body, schema)
    good = F.filter(got, lambda x: x["claim_text"].isNotNull())
    saved = F.transform(F.regexp_extract_all(raw, F.lit(r'"claim_text"\s*:\s*"((?:[^"\\]|\\.)*)"'), 1), lambda t: F.struct(t.alias("claim_text"), F.lit(None).cast("string").alias("claim_type"), F.lit(None).cast("double").alias("confidence")))
    return F.when(F.size(good) > 0, good).when(F.size(saved) > 0, saved)


def resolve_date(day: Column, year: Column, name: Column, text: Column, created: Column) -> Column:
    """The year of a claim: that of its own date, else its year (BCE negative), else one in the file's name, else one in its text, else that of its record.

    Dates are ISO text, a year alone or `n BCE`. Years in names and texts are 1800 to 2029; one after $ or before troops,
    men, people, soldiers or dollars is a number.
    """
    bce = -F.nullif(F.regexp_extract(day, r"(?i)^\s*(\d{1,5})\s*BCE?", 1), F.lit("")).cast("int")
    plain = F.nullif(F.regexp_extract(day, r"^\s*(-?\d{4})(?:$|-|/|\s)", 1), F.lit("")).cast("int")
    named = F.nullif(F.regexp_extract(name, r"(?<!\d)(1[89]\d\d|20[012]\d)(?!\d)", 1), F.lit("")).cast("int")
    said = F.nullif(F.regexp_extract(text, r"(?i)(?<![\d$,.])(1[89]\d\d|20[012]\d)(?![\d,])(?!\s*(?:troops|men|people|soldiers|dollars))", 1), F.lit("")).cast("int")
    return F.coalesce(bce, plain, year.cast("int"), named, said, F.year(created))


def propagate_soft_date(claims: DataFrame, dates: str = "dates", chunk_date: str = "chunk_date") -> DataFrame:
    """Claims without a date of their own take their chunk's, as soft_date and as a date of type document_context, confidence 0.8.

    dates: array<struct<date, confidence, type>>; a null array counts as empty. Without a chunk date nothing changes.
    """
    own = F.coalesce(F.size(dates), F.lit(0)) > 0
    given = F.array(F.struct(F.col(chunk_date).cast("string").alias("date"), F.lit(0.8).alias("confidence"), F.lit("document_context").alias("type")))
    lent = ~own & F.col(chunk_date).isNotNull()
    return claims.withColumn("soft_date", F.when(lent, F.col(chunk_date).cast("string"))).withColumn(dates, F.when(lent, given).otherwise(F.col(dates)))


def has_payload(payload: Column) -> Column:
    """Whether a JSON text holds anything: not null, blank, {} or null."""
    return F.coalesce(~F.trim(payload).isin("", "{}", "null"), F.lit(False))


def temporal_context(docs: DataFrame, eras: list[tuple[str, str]], known: DataFrame | None = None) -> DataFrame:
    """(doc_id, path, text) -> doc_id, publication_year, confidence, method, era, soft_date.

    The publication year is that of a known document (doc_id, year; 0.98), else one after "published", "copyright" or (c)
    in the text (0.9), else one in the path (0.7). era: the period of eras (name, regex) most often in the text, ties the
    first; else the decade of the publication year. soft_date is the publication year, else null.
    """
    k = docs.join(known.select("doc_id", F.col("year").alias("known")), "doc_id", "left") if known is not None else docs.withColumn("known", F.lit(None).cast("int"))
    said = F.nullif(F.regexp_extract("text", r"(?i)(?:published|copyright|©|\(c\))\D{0,12}(1[5-9]\d\d|20[012]\d)", 1), F.lit("")).cast("int")
    named = F.nullif(F.regexp_extract("path", r"(?<!\d)(1[5-9]\d\d|20[012]\d)(?!\d)", 1), F.lit("")).cast("int")
    counts = F.array(*(F.struct(F.size(F.regexp_extract_all("text", F.lit(f"(?i){rx}"), 0)).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("era")) for i, (name, rx) in enumerate(eras))) if eras else F.array(F.struct(F.lit(0).alias("n"), F.lit(0).alias("o"), F.lit("").alias("era")))
    best = F.array_max(counts)
    out = k.select("doc_id", F.coalesce("known", said, named).alias("publication_year"), F.when(F.col("known").isNotNull(), 0.98).when(said.isNotNull(), 0.9).when(named.isNotNull(), 0.7).alias("confidence"), F.when(F.col("known").isNotNull(), "known").when(said.isNotNull(), "text").when(named.isNotNull(), "filename").alias("method"), best.alias("b"))
    era = F.when(F.col("b.n") > 0, F.col("b.era")).otherwise(F.concat((F.floor(F.col("publication_year") / 10) * 10).cast("string"), F.lit("s")))
    return out.select("doc_id", "publication_year", "confidence", "method", era.alias("era"), F.col("publication_year").cast("string").alias("soft_date"))
