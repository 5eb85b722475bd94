"""Cases in which an operator once did less than the whole job."""

import numpy as np

from pyspark.sql import functions as F

from claimweave.llm import decontam, langid, licenses, line_dedup, mixing, ngram_join, quality_rules, queries, textkeys, token_files, toxicity, warc


def test_leaks_of_items_that_share_a_template(spark):
    template = " ".join(f"word{i}" for i in range(54))
    items = spark.createDataFrame([(i, f"{template} rare{i}") for i in range(1000)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{template} other{i}") for i in range(20)], "doc_id long, text string")
    got = decontam.leaks(docs, items)  # 50 shared shingles of weight 1 and two single ones: similarity 0.77 for every pair
    assert got.count() >= 0.99 * 20 * 1000 and got.where("similarity < 0.76 or similarity > 0.78").count() == 0


def test_word_hashes_of_long_texts():
    def plain(text):
        words = text.split()
        known = {w: textkeys.word_hashes(w)[0] for w in set(words)}
        return [known[w] for w in words]

    blob = "a" * 3_000_000
    for text in (" " + blob + " b c", "x " + blob + " b c", blob, blob + " ", " " * 3_000_000 + "a", "x " * 900_000 + blob + " y", ("q" * ((1 << 20) - 1) + " ") * 3 + "z", "日本語" * 500_000 + " b " + "日本語" * 500_000):
        assert np.array_equal(textkeys.word_hashes(text), np.array(plain(text), np.uint64))


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


def test_license_headers_as_they_are_written(spark):
    want = {GPL: {"GPL-3.0/header"}, MPL: {"MPL-2.0/notice"}, APACHE: {"Apache-2.0/header", "Apache-2.0/header-run-on"}, BSD: {"BSD-3-Clause/full"}}
    forms = [
        lambda t: "Copyright 2020 Someone\n\n" + t + "\n\ncode()",
        lambda t: "\n".join(("# " + x).rstrip() for x in t.split("\n")) + "\nimport x\n",
        lambda t: "/*\n" + "\n".join((" * " + x).rstrip() for x in t.split("\n")) + "\n */\nint x;\n",
        lambda t: "\r\n".join(("// " + x).rstrip() for x in t.split("\n")),
        lambda t: " ".join(t.split()),
    ]
    cases = [(f(t), rules) for t, rules in want.items() for f in forms]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, []).append(r.rule)
    assert all(len(got.get(i, [])) == 1 and got[i][0] in rules for i, (_, rules) in enumerate(cases)), got


def test_a_piece_alone_is_no_sentence(spark):
    mit = [licenses.SENTENCES[k][0] for k in ("mit-grant", "mit-notice-kept", "as-is")]
    docs = spark.createDataFrame([(1, "\n\n".join([mit[0], "2.0.", *mit[1:]])), (2, "This program is free software: take it.")], "doc_id long, text string")
    assert [(r.doc_id, r.rule, r.n_sentences) for r in licenses.scan(docs).collect()] == [(1, "MIT/full", 3)]


ROWS = "doc_id long, text string, lang string"


def spell(seed, n):
    return " ".join(f"{seed}{i:04d}" for i in range(n))


def test_stages_keep_clean_rows_of_null_and_repeated_ids(spark):
    clean = [(i, spell(s, 60), "en") for i, s in ((None, "a"), (None, "b"), (7, "c"), (7, "d"), (None, "e"))]
    poor = [(i, " ".join(["p0001 p0002 p0003 p0004 p0005"] * 12), "en") for i in (None, 7)]  # same id, language and characters
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame(clean + poor + clean[:1], ROWS)
    assert sorted(map(str, quality_rules.kept_only(docs, labels).collect())) == sorted(map(str, spark.createDataFrame(clean + clean[:1], ROWS).collect()))

    near = [(3, clean[0][1] + " z", "en"), (None, clean[1][1] + " z", "en"), (None, "", "en"), (None, None, "en"), (7, " ", "de")]
    single = ngram_join.one_per_component(spark.createDataFrame(clean + near + clean, ROWS)).collect()
    got = sorted(str(tuple(r)) for r in single)
    either = {str(clean[1]), str(near[1])}  # both without an id
    assert len(got) == 8 and len(either & set(got)) == 1
    assert sorted(set(got) - either) == sorted(map(str, [near[0], *clean[2:], *near[2:]]))

    item = spark.createDataFrame([(1, spell("q", 30))], "item_id long, text string")
    leaky = [(i, spell("r", 20) + " " + spell("q", 30) + " " + spell("t", 20), "en") for i in (None, 7)]
    left = decontam.without_leaks(spark.createDataFrame(clean + leaky + near[2:], ROWS), item).collect()
    assert sorted(str(tuple(r)) for r in left) == sorted(map(str, clean + near[2:]))


def test_toxicity_trains_when_the_first_hash_range_overflows(spark):
    first = F.shiftright(F.xxhash64("id"), 52) == -2048  # the first of 4096 ranges
    ids = [r.id for r in spark.range(1_000_000).where(first).limit(160).collect()]
    docs = spark.createDataFrame([(i, spell("w", 40) + (" idiot scum" if k % 2 else " fine day")) for k, i in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    known = labels.select(F.xxhash64("doc_id").alias("o"))
    hashes = sorted(r.o for r in known.collect())
    for most in (1, 40, 120, 159):
        assert hashes[most - 1] < toxicity.hash_bound(known, most) <= hashes[most]
    got = toxicity.classify(docs, labels, F.lit(False), most_rows=120).collect()
    assert sum(r.predicted == ids.index(r.doc_id) % 2 for r in got) > 150


BIG = 1 << 53


def test_ids_above_2_to_53_next_to_nulls(spark):
    ids = [BIG + 1, None, BIG + 3, None, BIG + 7]
    docs = spark.createDataFrame([(i, f"text {'same' if k < 3 else k}") for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in token_files.token_digest(docs, queries.vocabulary()).collect()} == set(ids)
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.jaccard_classes(docs).collect()), key=str)
    assert got == sorted([(BIG + 1, BIG + 1), (None, BIG + 1), (BIG + 3, BIG + 1), (None, None), (BIG + 7, BIG + 7)], key=str)
    pages = docs.selectExpr("doc_id as page_id", "'u' as url", "text as html")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.archived(pages).collect()), key=str)
    assert got == sorted([(BIG + 1, "response", None), (None, "revisit", BIG + 1), (BIG + 3, "revisit", BIG + 1), (None, "response", None), (BIG + 7, "response", None)], key=str)


def test_reader_has_a_task_for_each_range(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", spell(f"h{i}x", 50)) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(pages, f"file://{tmp_path}/warc")
    ranges = sum(-(-r.bytes // 5000) for r in archives.collect())
    read = warc.read_archives(spark, archives, 5000, payloads=False)
    assert ranges > 4 and read.rdd.getNumPartitions() == ranges and read.count() == 200


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    bsd = [licenses.SENTENCES[k][0] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")]
    docs = spark.createDataFrame([(1, " ".join(bsd)), (None, " ".join(bsd)), (None, " ".join(bsd[:3])), (1, "Licensed under CC BY 4.0."), (1, " ".join(bsd))], "doc_id long, text string").withColumn("way", F.lit(5))
    got = sorted(((r.doc_id, r.license) for r in licenses.scan(docs).collect()), key=str)
    assert got == sorted([(1, "BSD-3-Clause"), (None, "BSD-3-Clause"), (None, "BSD-2-Clause"), (1, "CC-BY-4.0")], key=str)

    a, b = "p\nq\nr\nown1", "s\np\nq\nr"
    docs = spark.createDataFrame([(None, a), (None, b), (7, a), (7, a), (7, "x\ny\nz")], "doc_id long, text string").withColumn("k", F.lit(1))
    got = sorted((r.doc_id, r.n_removed, r.kept_text) for r in line_dedup.repeated_lines(docs).collect() if r.doc_id)
    assert got == [(7, 0, "x\ny\nz"), (7, 4, ""), (7, 4, "")]
    assert sorted(r.n_removed for r in line_dedup.repeated_lines(docs).collect() if r.doc_id is None) == [0, 3]


def brute_lines(rows, window=3):
    """Kept texts of rows (doc_id, text) with distinct ids, by the rule as stated."""
    places, spans = {}, {}
    for i, text in sorted(rows):
        lines = [(k, x.strip("\t\x0b\f\r ")) for k, x in enumerate(text.split("\n"))]
        worded = [(k, x) for k, x in lines if x]
        for j in range(len(worded) - window + 1):
            places.setdefault(tuple(x for _, x in worded[j : j + window]), []).append((i, j, [k for k, _ in worded]))
    for found in places.values():
        for i, j, at in found[1:]:
            lo = max(j, found[0][1] + window) if i == found[0][0] else j
            spans.setdefault(i, set()).update(at[lo : j + window])
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in spans.get(i, ())) for i, t in rows}


def test_line_dedup_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["a", "b", " a ", "", "c", "d\t"]) for _ in range(rng.randint(0, 14)))) for i in range(80)]
    got = {r.doc_id: r.kept_text for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_lines(rows)
    removed = {i for i, t in rows if want[i] != t}
    assert got == want and 10 < len(removed) < 80


def test_line_dedup_of_very_long_texts(spark):
    text = "\n".join(f"line {k}" for k in range(100_000))
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.repeated_lines(spark.createDataFrame([(1, text), (2, text + "\nmore")], "doc_id long, text string")).collect()}
    assert got == {1: (100_000, 0), 2: (100_001, 100_000)}


def test_language_profiles_of_long_texts_have_no_borders(monkeypatch):
    text = "der Hund und die Katze über Äpfel 12 " * 300 + "q" * 5000 + " the end"
    whole = langid.grams(text)
    for segment in (100, 997, 4000):
        monkeypatch.setattr(langid, "SEGMENT", segment)
        assert all(np.array_equal(a, b) for a, b in zip(langid.grams(text), whole, strict=True))


def test_language_by_brute_force(spark):
    import random

    rng, rows = random.Random(2), []
    for i in range(60):
        lang = ["en", "de", "xx", None][i % 4]
        letters = {"en": "abcde", "de": "cdefgä", "xx": "klmn", None: "abk"}[lang]
        rows.append((i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 30))), lang))
    profiles = {}
    for lang in ("en", "de", "xx"):
        n = {}
        for _, t, own in rows:
            for g, k in zip(*langid.grams(t if own == lang else None), strict=True):
                n[g] = n.get(g, 0) + k
        profiles[lang] = sorted(n, key=lambda g: (-n[g], g))[:50]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(False), 50).collect()}
    for i, t, _ in rows:
        own = langid.profile(*langid.grams(t), 50)
        away = {lang: sum(abs(r - p.index(g)) if g in p else 50 for r, g in enumerate(own)) for lang, p in profiles.items()}
        assert got[i] == (min(sorted(away), key=away.get) if len(own) else "und")


def test_mixing_of_many_sources(spark):
    docs = spark.createDataFrame([(i, spell("w", 5 + i % 7), f"s{i % 400:03d}") for i in range(4000)], "doc_id long, text string, source string")
    per = mixing.mixed(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert per.count() == 400 and per.where("abs(taken - target) > 1").count() == 0


def test_mix_of_null_and_repeated_ids(spark):
    rows = [(None, spell(f"a{i}x", 40), "s") for i in range(30)] + [(7, spell(f"b{i}x", 40), None) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(9)).withColumn("row", F.lit(3))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and max(out.groupBy("text").count().toPandas()["count"]) <= 2
    assert out.groupBy("source").agg(F.count_distinct("text").alias("n")).where("n >= 15").count() == 2


def test_near_leaks_are_found_after_edits(spark):
    import random

    rng, rows, items = random.Random(9), [], []
    for i in range(60):
        words = [f"i{i}w{k}" for k in range(80)]
        items.append((i, " ".join(words)))
        for kind in range(3):
            w = list(words)
            at = rng.randint(20, 60)
            if kind == 0:
                w[at] = "other"
            elif kind == 1:
                w.insert(at, "other")
            else:
                del w[at]
            rows.append((3 * i + kind, f"before {' '.join(w)} after all"))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got) >= 0.99 * len(rows) and all(d // 3 == i for d, i in got)


def test_a_star_of_many_near_copies_is_one_component(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base[:30] + [f"x{i}"] + base[31:])) for i in range(3000)] + [(5000 + i, spell(f"c{i}x", 20)) for i in range(50)]
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert {r.component_id for r in got if r.doc_id < 3000} == {0} and all(r.component_id == r.doc_id for r in got if r.doc_id >= 5000)


def test_null_language_is_a_stratum_of_its_own(spark):
    rows = [(i, spell("g", 60), [None, "-"][i % 2]) for i in range(3000)]
    rows += [(9000 + i, " ".join(w + "#" for w in spell("g", 60).split()), None) for i in range(100)]
    labels = spark.createDataFrame([(i, int(i < 9000)) for i, *_ in rows], "doc_id long, quality int")
    stats = quality_rules.base_counts(spark.createDataFrame(rows, ROWS).select("doc_id", F.col("lang").alias("stratum"), "text"))
    assert {r.stratum for r in quality_rules.cutoffs(stats, labels).collect()} == {None}
