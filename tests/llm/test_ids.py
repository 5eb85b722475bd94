"""Null and repeated ids on both sides, repeated rows, and bounds that hold whatever the ids are."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from claimweave.llm import decontam, quality_rules, token_files, toxicity
from claimweave.llm.queries import vocabulary

ROWS, ITEMS = "doc_id long, text string", "item_id long, text string"


def prose(rng, n, words=3000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def shingles(words):
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def plain_leaks(docs, items, threshold=0.75):
    """Best similarity per (doc_id, text) and (item_id, words), by the operator's own weighted measure, over every window."""
    known = {(i, tuple((t or "").lower().split())) for i, t in items}
    known = {x for x in known if x[1]}
    texts = {w for _, w in known}
    df = Counter(h for w in texts for h in shingles(w))
    weight = lambda c: {h: n * (math.log((1 + len(texts)) / (1 + df[h])) + 1) for h, n in c.items()}
    out = {}
    for doc_id, text in set(docs):
        w = (text or "").lower().split()
        for item_id, q in known:
            iw, best = weight(shingles(q)), 0.0
            for s in range(max(0, len(w) - len(q)) + 1):
                ww = weight(shingles(w[s : s + len(q)])) if w else {}
                low = sum(min(x, ww.get(h, 0)) for h, x in iw.items())
                best = max(best, low / (sum(iw.values()) + sum(ww.values()) - low) if ww else 0.0)
            if best >= threshold - 5e-7:
                out[doc_id, text, item_id, q] = round(best, 6)
    return out


def leaky(rng, items, n, ids):
    rows = []
    for i in range(n):
        text = prose(rng, rng.randint(30, 90))
        if i % 2:
            item = items[i % len(items)][1].split()
            if rng.random() < 0.5:
                item[rng.choice([1, len(item) // 2, len(item) - 2])] = "changed"
            text = prose(rng, 20) + " " + " ".join(item) + " " + text
        rows.append((ids(i), text))
    return rows


def test_leaks_with_any_ids_equal_brute_force(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(12, 50)) for _ in range(12)]
    template = prose(rng, 40)
    texts += [f"{template} rare{k}" for k in range(4)] + ["only four words here"]
    items = [(rng.choice([None, 7, k]), t) for k, t in enumerate(texts)] + [(3, None), (None, "")]
    docs = leaky(rng, items[:12], 60, lambda i: [None, 5, i][i % 3]) + [(5, f"a {template} other"), (None, "so only four words here ends"), (None, None)]
    docs += docs[:7]
    items += items[:3]
    want = plain_leaks(docs, items)
    got = decontam.leaks(spark.createDataFrame(docs, ROWS).repartition(3), spark.createDataFrame(items, ITEMS)).collect()
    a, b = Counter((r.doc_id, r.item_id, round(r.similarity, 4)) for r in got), Counter((d, i, round(x, 4)) for (d, _, i, _), x in want.items())
    assert not a - b and not b - a, (a - b, b - a)
    bad = {t for _, t, _, _ in want}
    left = decontam.without_leaks(spark.createDataFrame(docs, ROWS), spark.createDataFrame(items, ITEMS)).collect()
    assert Counter(r.text for r in left) == Counter(t for _, t in docs if t not in bad) and len(bad) >= 25


def test_leaks_by_shuffle_are_those_by_broadcast(spark, monkeypatch):
    rng = random.Random(12)
    items = [(k, prose(rng, 30)) for k in range(20)]
    docs = leaky(rng, items, 40, lambda i: i)
    got = lambda: sorted(map(tuple, decontam.leaks(spark.createDataFrame(docs, ROWS), spark.createDataFrame(items, ITEMS)).collect()))
    want = got()
    for name in ("HITS", "SHINGLES", "LEAKY", "INDEX"):
        monkeypatch.setattr(decontam, f"BROADCAST_{name}", -1)
    assert got() == want and len(want) >= 14


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.75 to 0.8 alone: random words changed in items of 100 words."""
    rng = random.Random(13)
    items = [(k, prose(rng, 100, 10**6)) for k in range(400)]
    docs = []
    for k, t in items:
        w = t.split()
        for at in (20, 60) if k % 2 else (15, 50, 51):  # 10, or 11, of 96 shingles change: 86/106 = 0.811, 85/107 = 0.794
            w[at] = "changed"
        w[90] = "more"  # 5 more: 0.729, 0.714 of counts; weights are equal
        w[90] = t.split()[90]
        w[85] = "x" if k % 3 == 0 else w[85]
        docs.append((k, " ".join(w)))
    want = plain = set()
    for (k, t), (_, d) in zip(items, docs, strict=True):
        a, b = shingles(t.split()), shingles(d.split())
        both = sum((a & b).values())
        if both >= 0.75 * (192 - both):
            want.add(k)
    got = {r.doc_id for r in decontam.leaks(spark.createDataFrame(docs, ROWS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got <= plain and len(got) >= 0.99 * len(want) and len(want) >= 200


def test_repeated_rows_certify_nothing(spark):
    good, bad = [(i, " ".join(f"g{i}w{k}" for k in range(60)), "en") for i in range(20)], [(50 + i, " ".join(f"b{i}w{k}#" for k in range(60)), "en") for i in range(5)]
    rows = good + bad
    labels = [(i, int(i < 50)) for i, *_ in rows]
    for copies in (1, 60):
        docs = spark.createDataFrame(rows * copies, "doc_id long, text string, lang string")
        assert quality_rules.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int")).where("not kept").count() == 0


def test_toxicity_keeps_its_bound(spark, monkeypatch):
    rows = [(i % 40, f"text {i} of many", "en", "s") for i in range(4000)] + [(None, "x", "en", "s")] * 5
    labels = [(i, i % 2) for i in range(40)] * 2 + [(None, 1)]
    seen = []
    real = toxicity._train
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    told = spark.createDataFrame(labels, "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "written", lambda df, label: (seen.append((label, df.count())), df)[1])
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    out = toxicity.classify(docs, told, F.lit(False), most_rows=40)
    assert dict(seen)["labelled"] == 40 and out.count() == len(rows) and real is toxicity._train
    seen.clear()
    toxicity.classify(docs.limit(30).union(docs.limit(30)), told, F.lit(False), most_rows=40)
    assert dict(seen)["labelled"] == docs.limit(30).join(told, "doc_id").select("doc_id", "text").distinct().count()


def test_token_files_part_null_and_repeated_ids(spark):
    rows = [([None, 5, i][i % 3], f"text number {i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, ROWS).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = token_files.write_tokens(docs, vocabulary())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.docs for r in parts.collect()]
    assert sum(sizes) == 6000 and max(sizes) < 2000 and sum(r.nulls > 0 for r in parts.collect()) >= 2
    got = token_files.read_tokens(parts).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist() == [r.start for r in got]
    assert len({r.ids_crc32 for r in got}) == 6000


def test_stages_keep_odd_rows_and_clashing_columns(spark, sf):
    import corpus_pipeline

    names = ["row", "copy", "copies", "key", "kept", "leaky", "own", "x1", "d1", "c", "component", "stratum", "hash", "o1"]
    rng = random.Random(21)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(None, prose(rng, 60), None, None, None), (None, prose(rng, 60), "en", "a", 1), (5, prose(rng, 60), "en", "a", 2), (5, prose(rng, 60), "xx", None, 3), (6, None, "en", "a", 4), (7, "", None, "b", 5), (8, " \n\t ", "en", "b", 6), (9, f"{prose(rng, 30)} {item}", "en", "a", 7)]
    rows += rows[2:4] + [(10, prose(rng, 30_000), "en", "b", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    words = lambda t: len((t or "").split())
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, now.limit(0), sf).count() == 0, name
        out = spark.createDataFrame(stage(spark, now, sf).collect(), now.schema)
        assert out.columns == docs.columns and out.where(" or ".join(f"{n} <> 'own {n}'" for n in names)).count() == 0, name
        now = out
        if name == "quality_rules":
            assert sorted(map(words, (r.text for r in now.collect()))) == sorted(words(r[1]) for r in rows if words(r[1]) >= 10)
        if name == "ngram_jaccard":
            assert now.count() == len({r[1] for r in rows if words(r[1]) >= 10})
        if name == "decontamination":
            assert not [r for r in now.collect() if item in r.text] and now.count() == 5
    assert 3 <= now.count() <= 10
    got = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert len(got) == now.count() and sum(r.doc_id is None for r in got) == now.where("doc_id is null").count()
    assert corpus_pipeline.STAGES[-1][1](spark, now.limit(0), sf).count() == 0


def test_leaks_that_no_fingerprint_finds(spark, monkeypatch):
    """With fingerprints that never meet, every window that reaches the threshold is found all the same."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    items = [(i, [rng.choice(words) for _ in range(30)]) for i in range(20)]
    docs = []
    for i, ws in items:
        for changed in (0, 1, 2):
            own = list(ws)
            for k in rng.sample(range(30), changed):
                own[k] = "other"
            docs.append((len(docs), " ".join(["before"] * 7 + own + ["after"] * 9)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")
    rows = lambda: {(r.doc_id, r.item_id, r.start_word, r.similarity) for r in decontam.leaks(d, t, threshold=0.5).collect()}
    want = rows()
    monkeypatch.setattr(decontam, "RADIUS", -1)
    assert rows() == want and len(want) >= 40
