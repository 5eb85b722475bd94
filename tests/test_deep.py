"""Pruned mining, the anomaly detector, data management and readers on known and odd cases."""

import datetime
import json
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from claimweave.operators import anomaly, manage, mining
from claimweave.sources import io


def test_frequent_pairs_equal_all_pairs(spark):
    rng = random.Random(1)
    docs = {d: set(rng.sample("abcdefghijklmnop", rng.randint(1, 8))) for d in range(120)}
    docs[500] = set("abcdefghijklmnop")
    rows = [(d, e) for d, es in docs.items() for e in es]
    rows += rows[:20] + [(None, "a"), (3, None)]
    df = spark.createDataFrame(rows, "doc long, entity string").repartition(4)
    c, co = Counter(e for es in docs.values() for e in es), Counter(p for es in docs.values() for p in combinations(sorted(es), 2))
    for least, share in ((3, 0.6), (3, 0.3), (10, 0.4), (1, 0.01)):
        got = {(r.e1, r.e2): (r.co, r.c1, r.c2) for r in mining.frequent_pairs(df, least, share).collect()}
        want = {p: (n, c[p[0]], c[p[1]]) for p, n in co.items() if n >= least and min(c[x] for x in p) >= least and n >= share * min(c[x] for x in p) - 1e-9}
        assert got == want
    assert len(want) == 120  # at the last, laxest bounds all pairs
    assert mining.correlations(df.limit(0)).count() == 0


@pytest.mark.parametrize("heavy, few, split", [(3, 2_000, 50_000), (5, 0, 4), (256, 0, 7), (0, 0, 50_000)])
def test_frequent_pairs_in_light_and_heavy_documents(spark, monkeypatch, heavy, few, split):
    for name, value in (("HEAVY", heavy), ("FEW", few), ("SPLIT", split)):
        monkeypatch.setattr(mining, name, value)
    rng = random.Random(heavy)
    docs = {d: set(rng.sample("abcdefghijklmnop", rng.randint(1, 8))) for d in range(80)}
    docs[500] = set("abcdefghijklmnop")
    c, co = Counter(e for es in docs.values() for e in es), Counter(p for es in docs.values() for p in combinations(sorted(es), 2))
    df = spark.createDataFrame([(d, e) for d, es in docs.items() for e in es], "doc long, entity string")
    got = {(r.e1, r.e2): (r.co, r.c1, r.c2) for r in mining.frequent_pairs(df, 3, 0.3).collect()}
    assert got == {p: (n, c[p[0]], c[p[1]]) for p, n in co.items() if n >= 3 and n >= 0.3 * min(c[x] for x in p) - 1e-9}



def test_a_document_of_very_many_entities(spark):
    many = spark.range(50_000).selectExpr("-1 as doc", "id as entity")
    others = spark.range(40_000).selectExpr("id div 2 as doc", "id div 8 * 2 + id % 2 as entity")  # 5,000 pairs, four times each
    got = mining.frequent_pairs(many.union(others), 3, 0.6)
    assert tuple(got.agg(F.count("*"), F.min("co"), F.max("c1")).first()) == (5000, 5, 5)


def test_significance(spark):
    got = spark.createDataFrame([(20, 100, 100, 1000), (11, 100, 100, 1000), (5, 10, 10, 1000), (0, 0, 5, 10), (60, 100, 100, 1000)], "co int, c1 int, c2 int, n int").select(F.round(mining.significance(*map(F.col, ("co", "c1", "c2", "n"))), 6).alias("s"))
    assert [r.s for r in got.collect()] == [0.5, 0.005, 0.1, 0.0, 1.0]


def test_sequences_block_by_block(spark, monkeypatch):
    rng = random.Random(5)
    start = datetime.date(2020, 1, 1)
    rows = [(rng.randrange(40), i, start + datetime.timedelta(rng.randrange(90))) for i in range(500)]
    seen = lambda: mining.sequences(spark.createDataFrame(rows, "entity long, doc long, day date"), days=7, share=0.4, top=5000).collect()
    whole = seen()
    for name, value in (("BLOCK", 7), ("SPOTS", 5)):
        monkeypatch.setattr(mining, name, value)
    assert len(whole) > 50 and seen() == whole
    best = mining.sequences(spark.createDataFrame(rows, "entity long, doc long, day date"), days=7, share=0.4, top=9).collect()
    assert best == whole[:9]


@pytest.mark.parametrize("days", [1, 7, 30])
def test_sequences_equal_plain_version(spark, days):
    rng = random.Random(days)
    start = datetime.date(2020, 1, 1)
    rows = [(rng.choice("abcdef"), i, start + datetime.timedelta(rng.randrange(200))) for i in range(120)]
    rows += [(e, i, d) for e, i, d in rows[:15]] + [(rng.choice("abcdef"), i, d) for _, i, d in rows[15:30]]
    odd = [(None, 1, start), ("a", None, start), ("a", 900, None)]
    got = mining.sequences(spark.createDataFrame(rows + odd, "entity string, doc long, day date").repartition(3), days=days, share=0.3, top=1000).collect()
    by = {}
    for e, i, d in set(rows):
        by.setdefault(e, []).append((i, d))
    want = {}
    for a in by:
        for b in by:
            if a == b or min(len(by[a]), len(by[b])) < 3:
                continue
            one = {i for i, d in by[a] if any(0 < (x - d).days <= days for _, x in by[b])}
            two = {j for j, x in by[b] if any(0 < (x - d).days <= days for _, d in by[a])}
            if len(one) >= 3 and len(two) >= 3 and len(one) >= 0.3 * len(by[a]) - 1e-9:
                want[a, b] = (len(one), len(two), len(by[a]))
    assert {(r.e1, r.e2): (r.count1, r.count2, r.c1) for r in got} == want
    assert [(-r.share, -r.count1, r.e1, r.e2) for r in got] == sorted((-r.share, -r.count1, r.e1, r.e2) for r in got)


CLAIMS = "claim_id long, topic string, claim_text string, ts timestamp, locations array<struct<name: string, lat: double, lon: double>>"
DAY = datetime.datetime(2020, 1, 1)


def some_claims():
    spots = {"Cairo": (30.0, 31.0), "Athens": (38.0, 23.7), "Cusco": (-13.5, -72.0), "Nowhere": (None, None), "Xi'an": (34.3, 108.9)}
    texts = ["a pyramid of fire", "a calendar", None, "of the yellow river", "seven-element NARRATIVE", "nothing"]
    rng = random.Random(5)
    out = []
    for i in range(80):
        names = rng.sample(sorted(spots), rng.randint(1, 2))
        out.append((i, rng.choice(["t", "u", None]), rng.choice(texts), rng.choice([None, DAY + datetime.timedelta(rng.randrange(900))]), [(n, *spots[n]) for n in names] * rng.randint(1, 2)))
    return out + [(90, "t", "x", DAY, None), (91, "t", "x", DAY, [(None, 1.0, 1.0), ("", 1.0, 1.0)]), (92, "alone", "x", DAY, [("Rome", 42.0, 12.5)])]


def test_pairs_pruned_by_their_bound_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    claims = spark.createDataFrame(some_claims(), CLAIMS)
    vectors = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(0, 90, 2)] + [(1, [0.0] * 4), (3, None)], "claim_id long, embedding array<float>")
    places = anomaly.place_summaries(claims, vectors)
    told = {(r.topic, r.location): r for r in places.collect()}
    assert told["t", "Cairo"].culture == "egyptian" and told["u", "Athens"].culture == "greek" and ("t", "") not in told and told["alone", "Rome"].culture == "roman"
    assert told["t", "Nowhere"].lat is None and {r.complexity for r in told.values()} <= {0.0, 0.2, 0.5, 0.8, 0.95}
    all_ = anomaly.anomalous_pairs(places, floor=-1.0).collect()
    assert len(all_) == 20
    for floor in (0.3, 0.45, 0.6):
        got = {(r.topic, r.location1, r.location2): r.pair_score for r in anomaly.anomalous_pairs(places, floor).collect()}
        assert got == {(r.topic, r.location1, r.location2): r.pair_score for r in all_ if r.pair_score > floor}
    for r in all_:
        assert r.pair_score == pytest.approx(sum(w * r[k] for k, w in anomaly.WEIGHTS.items()), abs=3e-6)
    report = {r.topic: r for r in anomaly.anomaly_report(anomaly.anomalous_pairs(places), claims, limit=20).collect()}
    best = max((r for r in all_ if r.topic == "t"), key=lambda r: (r.pair_score, r.location1))
    assert report["t"].top_score == best.pair_score and len(report["t"].sample_claims) == len(set(report["t"].sample_claims)) <= 20
    assert "alone" not in report and report["t"].confidence == 0.95
    assert anomaly.anomalous_pairs(anomaly.place_summaries(claims.limit(0), vectors)).count() == 0


def test_complexity_words_and_levels(spark):
    texts = ["Precision STONE cutting", "megalith and fire", "calendar", "fire", "none", None]
    got = [r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select(anomaly.complexity(F.col("t")).alias("c")).collect()]
    assert got == [0.95, 0.8, 0.5, 0.2, 0.0, 0.0]


def test_assessments(spark):
    rows = [("a", "PRIMARY", f"s{i % 3}", True, True) for i in range(10)] + [("b", "META", "s", False, False)] * 20 + [("c", None, None, None, None)] + [(None, "META", "s", True, True)]
    df = spark.createDataFrame(rows, "topic string, claim_type string, source string, dated boolean, located boolean")
    got = {r.topic: r for r in manage.assess(df, spark.createDataFrame([("z",), ("a",), (None,)], "topic string")).collect()}
    assert got["a"].sufficient and got["a"].suppression_warnings == ["no_meta"] and got["a"].coordination_warnings == []
    assert got["b"].suppression_sufficient and not got["b"].coordination_sufficient and got["b"].suppression_warnings == ["few_primary", "one_source"] and got["b"].anomaly_warnings == ["few_located"]
    assert got["c"].total_claims == 1 and got["c"].suppression_warnings == ["few_claims", "few_primary", "no_meta", "few_sources"]
    assert set(got) == {"a", "b", "c", "z"} and got["z"].total_claims == 0 and got["z"].anomaly_warnings == ["no_claims"] and not got["z"].sufficient


def test_exclude_restore_active(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False), (None, True), (1, False)], "claim_id long, excluded boolean")
    ids = spark.createDataFrame([(1,), (1,), (None,), (9,)], "claim_id long")
    at = F.lit("2020-05-05").cast("timestamp")
    out = manage.exclude(df, ids, at)
    assert sorted(((r.claim_id, r.excluded, r.excluded_at is not None) for r in out.collect()), key=str) == sorted([(1, True, True), (1, True, True), (2, True, False), (3, False, False), (None, True, False)], key=str)
    back = manage.restore(out, ids, at)
    assert {(r.claim_id, r.excluded) for r in back.collect()} == {(1, False), (2, True), (3, False), (None, True)}
    assert all(r.excluded_at and r.restored_at for r in back.where("claim_id = 1").collect())
    assert manage.active(back).count() == 3 and manage.active(df).count() == 3


def test_cascade(spark):
    f = spark.createDataFrame
    tables = {
        "claims": f([(1, "x/a.txt"), (2, "x/a.txt"), (3, "b.txt"), (None, "x/a.txt"), (4, None)], "claim_id long, source_file string"),
        "chunks": f([(10, "x/a.txt"), (11, "x/a.txt"), (12, "b.txt"), (13, None)], "chunk_id long, source_file string"),
        "contains_claim": f([(10, 1), (11, 2), (11, 3), (12, 3)], "chunk_id long, claim_id long"),
        "documents": f([("A", "x/a.txt"), ("B", "b.txt")], "doc string, source_file string"),
        "about": f([("A", "t1"), ("A", "t2"), ("B", "t2"), ("B", None)], "doc string, topic string"),
        "topics": f([("t1",), ("t2",), ("t3",)], "topic string"), "claim_vectors": f([(1,), (3,), (9,)], "claim_id long"), "topic_vectors": f([("t1",), ("t1",), ("t2",)], "topic string"),
    }
    left, counts = manage.delete_source(tables, "a.txt")
    assert {r.what: r.n for r in counts.collect()} == {"claims": 3, "chunks": 1, "embeddings": 1, "topic_relationships": 2, "orphaned_topics": 2, "topic_embeddings": 2}
    of = lambda t: sorted((tuple(r) for r in left[t].collect()), key=str)
    assert of("claims") == [(3, "b.txt"), (4, None)] and [c for c, _ in of("chunks")] == [11, 12, 13] and of("contains_claim") == [(11, 3), (12, 3)]
    assert of("topics") == [("t2",)] and of("topic_vectors") == [("t2",)] and of("claim_vectors") == [(3,), (9,)] and of("about") == sorted([("B", "t2"), ("B", None)], key=str)
    assert {r.what: r.n for r in manage.delete_source(tables, "zzz")[1].collect()}["orphaned_topics"] == 1  # one that nobody is about
    got, lost = manage.delete_claims(tables, f([(1,), (None,), (77,)], "claim_id long"))
    assert (lost["claims"].count(), lost["contains_claim"].count(), lost["claim_vectors"].count(), got["claims"].count()) == (1, 1, 1, 4)


def test_read_chunks_of_every_shape(spark, tmp_path):
    lines = [{"content": "one", "sequence_num": 3, "context_metadata": {"source_file": "a.txt", "title": "T"}}, {"text": " two ", "metadata": {"source": "b.txt"}}, {"chunk_text": "three", "source_file": "c.txt"}, {"text": "  "}, {"content": "", "text": "four"}]
    (tmp_path / "a.json").write_text("\n".join([*map(json.dumps, lines), "{broken", ""]))
    (tmp_path / "empty.json").write_text("")
    got = {r.text: r for r in io.read_chunks(spark, str(tmp_path)).collect()}
    assert set(got) == {"one", "two", "three", "four"} and (got["one"].source_file, got["two"].source_file, got["three"].source_file, got["four"].source_file) == ("a.txt", "b.txt", "c.txt", "unknown")
    assert got["one"].title == "T" and got["four"].domain == "general"


def test_read_text_corpus_below_folders(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "one.txt").write_text("line\nline two é")
    (tmp_path / "two.txt").write_text("")
    got = {r.source_file.rsplit("/", 1)[1]: r.text for r in io.read_text_corpus(spark, str(tmp_path)).collect()}
    assert got["one.txt"] == "line\nline two é" and got.get("two.txt", "") == ""


def test_extracted_files_come_back(spark, tmp_path):
    schema = "source_file string, seq int, entities array<struct<name: string, type: string>>"
    rows = [("a", 1, [("n", None)]), (None, None, None), ("b", 2, [])]
    df = spark.createDataFrame(rows, schema)
    io.write_extracted(df.coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part*.json"))
    assert '"seq":null' in part.read_text()
    part.write_text(part.read_text() + "not json\n")
    (tmp_path / "out" / f".{part.name}.crc").unlink()
    assert sorted(map(str, io.read_extracted(spark, str(tmp_path / "out"), schema).collect())) == sorted(map(str, df.collect()))


def test_export_graph_and_new_files(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "Claim"), (2, "Entity")], "node long, label string")
    edges = spark.createDataFrame([(1, 2, "CITES")], "src long, dst long, rel_type string")
    io.export_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/nodes")).where("label = 'Entity'").first().node == 2 and (tmp_path / "g/edges/rel_type=CITES").is_dir()
    listing = spark.createDataFrame([("/in/a.txt", 1), ("/in/b.txt", 2), ("/other/a.txt", 3)], "path string, length long")
    known = spark.createDataFrame([("/old/a.txt",), (None,), ("/old/a.txt",)], "source_file string")
    assert [r.path for r in io.new_files(listing, known).collect()] == ["/in/b.txt"] and io.new_files(listing.limit(0), known).count() == 0


def test_profiles_and_categories(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"name": "p", "signal_weights": {"a": 0.5}, "min_claims": 3}))
    (tmp_path / "q.json").write_text(json.dumps({"name": "q", "scoring": {"mode": "linear"}}))
    got = {r.name: r for r in io.load_profiles(spark, str(tmp_path)).collect()}
    assert got["p"].signal_weights == {"a": 0.5} and got["p"].scoring is None and got["q"].scoring.mode == "linear" and got["q"].min_claims is None
    rules = [("history", "H"), ("hist", "X")]
    paths = spark.createDataFrame([("/a/History.pdf",), ("/hist/x",), (None,), ("z",)], "p string").select(io.infer_category(F.col("p"), rules).alias("c"))
    assert [r.c for r in paths.collect()] == ["H", "X", "general", "general"]


@pytest.mark.parametrize("top, share, block", [(3, 0.5, 1 << 17), (40, 0.5, 64), (40, 1.0, 7), (100_000, 0.3, 64), (5, 1.1, 64)])
def test_the_best_sequences_of_many_ties(spark, monkeypatch, top, share, block):
    monkeypatch.setattr(mining, "BLOCK", block)
    for name in ("CHUNK", "FIRST"):
        monkeypatch.setattr(mining, name, 20)
    rng = random.Random(top)
    start = datetime.date(2020, 1, 1)
    base = [(rng.randrange(50), start + datetime.timedelta(rng.choice([*range(120), 4000]))) for _ in range(400)]
    rows = [(f"{e}-{k}", i * 3 + k, day) for i, (e, day) in enumerate(base) for k in range(3)] + [("one", 10_000 + i, start + datetime.timedelta(50)) for i in range(9)]
    got = mining.sequences(spark.createDataFrame(rows, "entity string, doc long, day date"), days=9, share=share, top=top).collect()
    by = {}
    for e, _, day in rows:
        by.setdefault(e, []).append((day - start).days)
    want = []
    for a, x in by.items():
        for b, y in by.items():
            if a != b and min(len(x), len(y)) >= 3:
                one, two = sum(any(1 <= q - p <= 9 for q in y) for p in x), sum(any(1 <= q - p <= 9 for p in x) for q in y)
                if one >= 3 and two >= 3 and one >= share * len(x):
                    want.append((-round(one / len(x), 6), -one, a, b, two, len(x)))
    assert [(-r.share, -r.count1, r.e1, r.e2, r.count2, r.c1) for r in got] == sorted(want)[:top]
    assert share > 1 or len(got) == min(top, len(want)) > 0


def test_sequences_judge_few_of_the_pairs(spark, monkeypatch):
    asked = []
    laid = mining._first_rows
    monkeypatch.setattr(mining, "_first_rows", lambda known, key, kind: asked.append((kind, known.count())) or laid(known, key, kind))
    monkeypatch.setattr(mining, "FIRST", 50)
    start = datetime.date(2020, 1, 1)
    many = [(e, e * 100 + i, start + datetime.timedelta(i)) for e in range(60) for i in range(20)]
    few = [(1_000 + e, 100_000 + e * 10 + i, start + datetime.timedelta(i * 5)) for e in range(2_000) for i in range(3)]
    ends = [(e, 900_000 + e, start + datetime.timedelta(20)) for e in range(30)]
    got = mining.sequences(spark.createDataFrame(many + few + ends, "entity long, doc long, day date"), top=10).collect()
    assert [(r.share, r.count1, r.c1) for r in got] == [(1.0, 20, 20)] * 10 and {r.e1 for r in got} == {30}
    assert sum(n for kind, n in asked if kind) < 100
