"""Known inputs with their expected results."""

import math

from pyspark.sql import functions as F

from claimweave.functions.scoring import goldfinger, haversine_km
from claimweave.operators import curate, graph, text
from claimweave.streaming.jobs import burst_counts


def test_goldfinger(spark):
    want = {0: 0, 1: 0.10, 2: 0.20, 3: 0.6386, 4: 0.7197, 5: 0.7773, 10: 0.9394, 11: 0.95}
    got = {r.n: r.s for r in spark.createDataFrame([(n,) for n in want], "n int").select("n", goldfinger(F.col("n")).alias("s")).collect()}
    assert all(math.isclose(got[n], s, abs_tol=1e-4) for n, s in want.items())


def test_haversine(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (0.0, 0.0, 0.0, 10.0)], "a double, b double, c double, d double")
    assert [round(r[0], 1) for r in df.select(haversine_km(*map(F.col, "abcd"))).collect()] == [20015.1, 1111.9]


def test_dates(spark):
    df = spark.createDataFrame([("on February 18, 1898 there",), ("1898-02-18",), ("02/18/1898",), ("1898",), (None,)], "text string")
    assert [str(r[0]) for r in df.select(text.section_date()).collect()] == ["1898-02-18"] * 3 + ["None"] * 2


def test_topics(spark):
    df = spark.createDataFrame([("Stories.",), ("banned books",), ("Press",), ("!War!",)], "t string")
    assert [r[0] for r in df.select(text.normalize_topic(F.col("t"))).collect()] == ["story", "banned book", "press", "war"]


def test_upsert(spark):
    a = spark.createDataFrame([(1, "old", 1), (2, "kept", 5)], "k int, v string, n int")
    b = spark.createDataFrame([(1, "new", 1), (3, "add", 1)], "k int, v string, n int")
    assert {r.k: r.v for r in curate.upsert_latest(a, b, "k", "n").collect()} == {1: "new", 2: "kept", 3: "add"}


def test_chains_have_no_shortcut(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5), (1, 3, 1.0), (3, 4, 1.0)], "src int, dst int, weight double")
    assert {(r.a, r.b, r.c) for r in graph.chains(e).collect()} == {(1, 3, 4), (2, 3, 4)}


def test_stream_replay_equals_batch(spark, sf, tmp_path):
    claims = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_type as topic", "cast(ts as timestamp) as ts")
    claims.write.parquet(str(tmp_path / "in"))
    stream = burst_counts(spark.readStream.schema(claims.schema).parquet(str(tmp_path / "in")), late="30 days")
    q = stream.writeStream.format("memory").queryName("burst").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("burst").collect())) == sorted(map(tuple, burst_counts(claims).collect()))
