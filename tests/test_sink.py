"""Exactly-once upserts: policies, crashes half way, replays; the streaming ingest on them."""

import json
import random

import pytest

from claimweave.streaming import ingest
from claimweave.streaming.sink import UpsertTable

SCHEMA = "k string, a long, b string, c string, d long, e long"
POLICIES = {"a": "first", "b": "last", "c": "coalesce", "d": "max", "e": "sum"}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain(batches):
    """Rows one after another, in the order of a batch's rows."""
    at = {}
    for batch in batches:
        own = {}
        for r in sorted(batch, key=lambda r: tuple((x is not None, x) for x in r)):
            k, a, b, c, d, e = r
            o = own.setdefault(k, [None] * 5)
            o[0] = o[0] if o[0] is not None else a
            o[1] = b
            o[2] = c if c is not None else o[2]
            o[3] = max((x for x in (o[3], d) if x is not None), default=None)
            o[4] = o[4] if e is None else e + (o[4] or 0)
        for k, (a, b, c, d, e) in own.items():
            if k not in at:
                at[k] = [a, b, c, d, e]
                continue
            o = at[k]
            o[0] = o[0] if o[0] is not None else a
            o[1] = b
            o[2] = c if c is not None else o[2]
            o[3] = max((x for x in (o[3], d) if x is not None), default=None)
            o[4] = o[4] if e is None else e + (o[4] or 0)
    return sorted(((k, *v) for k, v in at.items()), key=str)


def batches():
    rng = random.Random(2)
    num = lambda: rng.choice([None, *range(9)])
    one = lambda: (rng.choice([None, *"abcdefghij"]), num(), rng.choice([None, "x", "y"]), rng.choice([None, "u", "v"]), num(), num())
    return [[one() for _ in range(n)] for n in (30, 5, 0, 12)]


def table(spark, path, **more):
    return UpsertTable(spark, f"file://{path}/t", SCHEMA, ["k"], POLICIES, buckets=5, **more)


def test_policies_and_replays(spark, tmp_path):
    t, all_ = table(spark, tmp_path), batches()
    assert t.read().count() == 0
    for n, rows in enumerate(all_):
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        assert t.upsert(df, n) and not t.upsert(df, n)
        assert rows_of(t.read()) == plain(all_[: n + 1])
    before = rows_of(t.read())
    assert t.vacuum() > 0 and t.vacuum() == 0 and rows_of(t.read()) == before
    assert not t.upsert(spark.createDataFrame(all_[0], SCHEMA), 0) and rows_of(t.read()) == before


def test_a_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    t, all_ = table(spark, tmp_path), batches()
    t.upsert(spark.createDataFrame(all_[0], SCHEMA), 0)

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(t, "_commit", crash)
        with pytest.raises(KeyboardInterrupt):
            t.upsert(spark.createDataFrame(all_[3], SCHEMA), 1)
    assert rows_of(t.read()) == plain(all_[:1])  # what was written isn't seen
    again = table(spark, tmp_path)
    assert again.vacuum() == 0 and again.upsert(spark.createDataFrame(all_[3], SCHEMA), 1)
    assert rows_of(again.read()) == plain([all_[0], all_[3]])


def test_wrong_tables_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        UpsertTable(spark, str(tmp_path), "k long, a long", ["k"], {"a": "newest"})
    with pytest.raises(ValueError):
        UpsertTable(spark, str(tmp_path), "k long, a long", ["k"], {})


TEXT = "Dr. John Smith of Stanford University shows that stress causes trauma in 40 percent of cases. The study found evidence that {} therefore matters. Nothing else."


def write_files(folder, some):
    folder.mkdir(exist_ok=True)
    for i in some:
        lines = [json.dumps({"source_file": f"f{i % 3}", "seq": i, "text": TEXT.format(f"case {i}")}), json.dumps({"source_file": "f", "seq": i, "text": " "}), json.dumps({"source_file": None, "seq": 1, "text": None}), "not json"]
        (folder / f"{i}.json").write_text("\n".join(lines))


def state(spark, root):
    return {k: rows_of(t.read()) for k, t in ingest.graph_tables(spark, root, 4).items()}


def test_ingest_killed_half_way_equals_one_run(spark, tmp_path):
    inbox, once, twice = tmp_path / "in", f"file://{tmp_path}/once", f"file://{tmp_path}/twice"
    write_files(inbox, range(6))
    ingest.stream_ingest(spark, str(inbox), once, 4).awaitTermination()
    want = state(spark, once)
    assert len(want["chunks"]) == 6 and len(want["claims"]) >= 6 and want["entities"] and len(want["mentions"]) >= 6

    tables, calls = ingest.graph_tables(spark, twice, 4), []

    def dies(chunks, batch):  # in the second batch, after two of four tables
        calls.append(batch)
        if batch < 1:
            return ingest.ingest_batch(tables, chunks, batch)
        found = ingest.extracted(chunks)
        tables["chunks"].upsert(found["chunks"], batch)
        tables["claims"].upsert(found["claims"], batch)
        raise RuntimeError("killed")

    query = ingest.stream_ingest(spark, str(inbox), twice, 4, each=dies, files=2)
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination()
    ingest.stream_ingest(spark, str(inbox), twice, 4, files=2).awaitTermination()
    assert calls[-1] == 1 and state(spark, twice) == want
    write_files(inbox, range(6, 8))
    ingest.stream_ingest(spark, str(inbox), twice, 4, files=2).awaitTermination()
    assert len(state(spark, twice)["chunks"]) == 8


def test_claims_sent_again_get_one_vector(spark, tmp_path):
    folder, root = tmp_path / "claims", f"file://{tmp_path}/v"
    folder.mkdir()
    line = lambda *r: json.dumps(dict(zip(("claim_id", "claim_text"), r, strict=True)))
    (folder / "1.json").write_text("\n".join([line("a", "one two"), line("b", "three"), line("a", "one two"), line(None, "x"), line("c", " ")]))
    read = lambda: spark.readStream.schema("claim_id string, claim_text string").json(str(folder))
    ingest.stream_embed(spark, read(), root, buckets=3).awaitTermination()
    first = {r.claim_id: r.embedding for r in ingest.vector_table(spark, root, 3).read().collect()}
    assert set(first) == {"a", "b"}
    (folder / "2.json").write_text("\n".join([line("a", "another text"), line("d", "four")]))
    seen = []
    ingest.stream_embed(spark, read(), root, encoder=lambda texts: [[1.0] for _ in texts], buckets=3).awaitTermination()
    got = ingest.vector_table(spark, root, 3).read()
    again = {r.claim_id: r.embedding for r in got.collect()}
    assert got.count() == 3 and again == {**first, "d": [1.0]} and not seen
    table = ingest.vector_table(spark, root, 3)
    ingest.embed_batch(table, spark.createDataFrame([("e", "five")], "claim_id string, claim_text string"), 1)  # batch 1 was committed: a replay
    assert table.read().count() == 3
