"""The training-data operators on small fixtures, against brute force, round trips and held-out accuracy."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import decontam, langid, licenses, line_dedup, mixing, ngram_join, quality_rules, queries, token_files, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(3)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def texts():
    base = prose(300)
    words = base.split()
    near = [" ".join(prose(1) if rng.random() < 0.02 else w for w in words) for _ in range(12)]
    shared = prose(60)
    out = [None, "", "  \n ", "one", "One", "a b c d", "A b c d", "a b c d e", *near, base, base]
    out += [prose(100) + " " + shared + " " + prose(100) for _ in range(8)]
    for n in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16):  # light sets and the boundary
        long = prose(n + 4)
        out += [long, long.rsplit(" ", 1)[0], long.split(" ", 1)[1], long + " " + prose(1)]
    return out + [prose(rng.randint(1, 400)) for _ in range(30)] + [prose(30_000)]


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], [f"s{i % 4}", None][i % 9 == 8], None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOC).withColumn("taken", F.lit(-1)).withColumn("component", F.lit("x")).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def shingles(t):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    at = {i: i for i in sets}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                at[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_jaccard_equals_brute_force(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(docs).collect()}
    assert got == brute_components(list(enumerate(TEXTS)))
    assert len({c for _, c in got.values()}) < len(got) - 30


def test_jaccard_repeated_rows_and_nulls(spark, empty):
    rows = [(1, "x y z"), (1, "x y z"), (None, "x y z"), (1, "p q"), (None, None)]
    got = sorted(map(tuple, ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (None, 1, 1), (1, 1, 1), (None, 0, None)], key=str)
    assert ngram_join.jaccard_classes(empty).count() == 0


def test_light_boundary_follows_cost():
    from fractions import Fraction

    t = Fraction("0.75")
    assert ngram_join.light_boundary({3: 1000, 4: 1000}, t) >= 3
    assert ngram_join.light_boundary({12: 1000}, t) < 12


def brute_repeats(w):
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(cover)


def test_base_counts(spark, docs, empty):
    extra = ["a b c d e f a b c d e g\n\n#x$\n#x$ \n#x$", "q w e r t y " * 40, "é ü x y", "\t\n"]
    rows = [(1000 + i, t, "en", "s", 1) for i, t in enumerate(extra)]
    both = docs.select(*DOC.replace(" long", "").replace(" string", "").split(", ")).union(spark.createDataFrame(rows, DOC))
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0)], "doc_id long, quality int")
    known = {**dict(enumerate(TEXTS)), **{1000 + i: t for i, t in enumerate(extra)}}
    for r in quality_rules.judged(both, labels).collect():
        t = known[r.doc_id] or ""
        w = WORDS.findall(t)
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), brute_repeats(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = len(w) < 10 or 100 * want[4] > 20 * len(w)
        assert r.base_failed == failed and r.kept == (not failed)
    assert quality_rules.judged(empty, labels).count() == 0


def test_binomial_tail_is_exact(spark):
    from math import comb

    for k, n, p in [(0, 50, 0.05), (3, 100, 0.05), (12, 400, 0.01), (40, 1200, 0.05)]:
        got = spark.sql(f"select {quality_rules.binomial_tail('k', 'n', p)} as x from values (bigint({k}), bigint({n})) as t(k, n)").first().x
        assert abs(got - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9


def test_cutoffs_keep_their_promise(spark):
    good = [(i, " ".join(VOCAB[j] for j in range(i % 7, i % 7 + 60)), "en") for i in range(4000)]
    bad = [(5000 + i, " ".join(w + "#" for w in prose(60).split()), "en") for i in range(200)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_rules.judged(docs, labels).collect()}
    assert not any(got[i] for i, *_ in bad) and sum(got[i] for i, *_ in good) >= 0.95 * len(good)
    assert {r.doc_id for r in quality_rules.kept_only(docs, labels).select("doc_id").collect()} == {i for i, k in got.items() if k}


def test_leaks_equal_brute_force(spark, empty):
    items = [(i, prose(rng.randint(20, 60))) for i in range(12)] + [(12, "four words only here"), (13, ""), (14, None)]
    rows = []
    for i in range(60):
        text, item = prose(rng.randint(50, 200)), items[i % 12][1].split()
        if i % 3 == 0:
            item = item if i % 2 else item[: len(item) // 2] + ["changed"] + item[len(item) // 2 + 1 :]
            text = prose(30) + " " + " ".join(item).upper() + " " + text
        rows.append((i, text))
    rows += [(60, "so four words only here ends"), (61, None), (62, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    want = set()
    for i, t in rows:
        w = (t or "").lower().split()
        for j, q in items:
            v = (q or "").lower().split()
            for s in range(max(0, len(w) - len(v) + 1)) if v else ():
                a, b = ({tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} for x in (w[s : s + len(v)], v))
                if len(a & b) >= 0.75 * len(a | b):
                    want.add((i, j))
    assert got == want and len(want) >= 15
    assert decontam.leaks(empty, bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0
    assert decontam.without_leaks(docs, bench).count() == len(rows) - len({i for i, _ in want})


def test_mixing(docs, empty):
    got = mixing.mixed(docs).collect()
    src = {r.doc_id: r.source for r in docs.collect()}
    size = {i: len(WORDS.findall(t or "")) for i, t in enumerate(TEXTS)}
    names = sorted({s for s in src.values() if s}) + [None]
    sums = [sum(size[i] for i in size if src[i] == s) for s in names]
    want = dict(zip(names, mixing.fair_targets(sums), strict=True))
    assert len(got) == len(TEXTS) and abs(sum(want.values()) - 1.5 * sum(sums)) < 1e-6
    taken = Counter()
    for r in got:
        assert (r["size"], r.source_size) == (size[r.doc_id], sums[names.index(src[r.doc_id])]) and r.taken <= 2 * r["size"]
        assert abs(r.target - want[src[r.doc_id]]) < 1e-6
        taken[src[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed(docs.repartition(3)).collect()), key=str)
    assert mixing.mixed(empty).count() == 0


def test_token_round_trip(docs, empty):
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(queries.vocabulary()), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_digest(docs, queries.vocabulary()).collect()}
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.token_digest(empty, queries.vocabulary()).count() == 0


def test_encoder_cuts_like_the_library():
    e = token_files.encoder(queries.vocabulary())
    for s in ["It's  a\ttest\x0b\x85x y", "Ünïcode ΑΣ ß ﬁ 12.5%", "a\n\n b's <|endoftext|>\nx", "́ é 가"]:
        got = np.frombuffer(b"".join(e.encode(s)), e.dtype).tolist()
        assert got == e.tokenizer.encode(s, add_special_tokens=False).ids


def test_line_dedup(spark, empty):
    rows = [(2, "a\nb\nc\nd"), (1, "x\n a\n\nb \nc\nd2"), (3, "p\nb\nc\nd\nq"), (4, "r\nr\nr\nr\nr\nr\nr"), (5, None), (6, "a\nb"), (7, "z\na\nb\nc\nd")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (6, 0, "x\n a\n\nb \nc\nd2") and got[2] == (4, 3, "d") and got[3] == (5, 3, "p\nq")
    assert got[4] == (7, 4, "r\nr\nr") and got[5] == (0, 0, None) and got[6] == (2, 0, "a\nb") and got[7] == (5, 4, "z")
    assert line_dedup.repeated_lines(empty).count() == 0


def test_warc_round_trip(spark, tmp_path):
    noise = bytes(rng.randrange(256) for _ in range(30_000)).decode("latin-1")
    html = [None, "", "<p>ü</p>", "<p>ü</p>", "\x1f\u008b\x08" * 500, noise, noise, *(f"<p>{prose(50)}</p>" for _ in range(30))]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\n", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    archives = warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/warc")
    for split in (777, 5000, 1 << 20):
        got = sorted(warc.read_archives(spark, archives, split).collect())
        assert [r.page_id for r in got] == list(range(len(html)))
        first = {}
        for r, h in zip(got, html, strict=True):
            data = (h or "").encode()
            lead = first.setdefault(data, r.page_id)
            assert (r.payload_bytes, r.payload_digest) == (len(data), warc.payload_digest(data))
            assert (r.record_type, r.refers_to) == (("response", None) if lead == r.page_id else ("revisit", lead))
            assert r.payload == (data if lead == r.page_id else None)
    assert warc.archived(pages.limit(0)).count() == 0


def test_language_id(spark, sf, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(docs, queries.held_out(4, 2)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 !?", "en"), (None, "the", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(odd, queries.held_out(4, 2)).collect()}[2] == "und"
    assert langid.identify(empty, queries.held_out(4, 2)).count() == 0


def test_toxicity(spark, empty):
    rows = [(i, prose(40) + (" you idiot worthless scum " if i % 5 == 0 else " ") + prose(40), "en", "s", 1) for i in range(600)] + [(600, None, "en", "s", 1), (601, "", "en", "s", 1)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in toxicity.classify(docs, labels, queries.held_out(5, 0)).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 600]
    assert len(got) == 602 and all(0 <= r.score <= 1 for r in got.values()) and got[600].predicted == got[601].predicted
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.9 * len(held)
    none = toxicity.classify(docs, labels.limit(0), queries.held_out(5, 0)).collect()
    assert all(r.score == 0.5 for r in none)
    assert toxicity.classify(empty, labels, queries.held_out(5, 0)).count() == 0


def test_licenses(spark, empty):
    mit = " ".join(licenses.SENTENCES[k][0] for k in ("mit-grant", "mit-notice-kept", "as-is"))
    wrapped = re.sub(r"(.{40,60}) ", r"\1\n", mit)
    rows = [(1, "Some words\nReleased under the MIT License."), (2, "x. " + mit), (3, "Code.\n\n" + wrapped), (4, licenses.SENTENCES["mit-grant"][0]), (5, None), (6, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (7, "no license here")]
    got = {(r.doc_id, r.rule) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT/notice"), (2, "MIT/full"), (3, "MIT/full"), (6, "CC-BY-NC-4.0/notice"), (6, "Apache-2.0/notice")}
    assert licenses.scan(empty).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline
    from claimweave.llm.common import table

    docs = table(spark, sf, "documents")
    kept = corpus_pipeline.quality(spark, docs, sf)
    good = {r.doc_id for r in quality_rules.judged(docs, table(spark, sf, "labels")).where("kept").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good
    single = corpus_pipeline.near_duplicates(spark, kept, sf)
    left = {r.doc_id for r in single.collect()}
    texts_ = [(r.doc_id, r.text) for r in kept.collect()]
    assert left == {c for _, c in brute_components(texts_).values()} | {i for i, t in texts_ if not shingles(t)}
    clean = corpus_pipeline.decontaminate(spark, single, sf)
    mix = corpus_pipeline.mix(spark, clean, sf)
    assert mix.columns == docs.columns and max(Counter(r.doc_id for r in mix.collect()).values()) <= 2
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == mix.count() and [n for n, _ in corpus_pipeline.STAGES][-1] == "token_files"
