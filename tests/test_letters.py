"""Names alike by the prefix filter, against all pairs; clusters that take in new names."""

import random
from collections import Counter
from math import sqrt

import pytest
from pyspark.sql import functions as F

from claimweave.functions.letters import alike
from claimweave.operators import entities


def vector(name):
    c = Counter(f" {w} "[i : i + 3] for w in name.lower().split() for i in range(len(w)))
    size = sqrt(sum(x * x for x in c.values()))
    return {p: x / size for p, x in c.items()}


def cosine(a, b):
    return sum(x * b.get(p, 0) for p, x in a.items())


def some_names(seed, n):
    rng = random.Random(seed)
    first, last = ["john", "johan", "jon", "maria", "marie", "anna", "ann", "peter"], ["smith", "smyth", "smithson", "meyer", "meier", "mayer", "of the north", "of the south"]
    out = [f"{rng.choice(first)} {rng.choice(last)}{rng.choice(['', '', 's', ' jr', ' 2'])}" for _ in range(n)]
    return out + ["", " ", "x", "X", "Ünder Öl", "ünder öl", "a b c", "a  b c"]


@pytest.mark.parametrize("floor", [0.7, 0.8, 0.85, 1.0])
def test_alike_equals_all_pairs(spark, floor):
    names = some_names(1, 150)
    df = spark.createDataFrame([(n,) for n in [*names, None]], "name string")
    got = {(r.a, r.b): r.similarity for r in alike(df, floor).collect()}
    v = {n: vector(n) for n in set(names) if n.strip()}
    sims = {(a, b): round(cosine(v[a], v[b]), 12) for a in v for b in v if a < b}
    assert got.keys() == {k for k, s in sims.items() if s >= floor} and all(abs(got[k] - sims[k]) < 1e-9 for k in got)
    part = df.withColumn("fresh", F.coalesce(F.col("name").startswith("j"), F.lit(False)))
    assert {(r.a, r.b) for r in alike(part, floor).collect()} == {k for k in got if k[0].startswith("j") or k[1].startswith("j")}
    assert alike(df.limit(0), floor).count() == 0


def test_clusters_take_in_new_names(spark):
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    names = some_names(2, 60)
    old, new = names[:40], names[40:] + [None, names[0]]
    known = entities.resolve_entities(frame(old))
    got = entities.extend_entities(known.select("name", "canonical"), frame(new)).collect()
    whole = {r.name: r.canonical for r in entities.resolve_entities(frame(names)).collect()}
    assert {r.name: r.canonical for r in got} == whole  # links of any two names are seen once, when the later comes
    assert len(got) == len({n for n in names if n.strip()}) and {r.tier for r in got} >= {None, "MAYBE_SAME_AS"}
    assert all((r.similarity or 0) >= 0.95 for r in got if r.tier == "SAME_AS")
    for r in got:
        if r.tier == "MAYBE_SAME_AS":
            assert r.similarity is None or 0.80 <= r.similarity < 0.95
    assert entities.extend_entities(known.select("name", "canonical").limit(0), frame([])).count() == 0
