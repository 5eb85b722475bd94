"""Merkle manifest and periodic runs against plain versions."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from claimweave.llm import merkle, runs

DOC = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
rng = random.Random(5)


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    for x in tree[:-1]:
        a = i // 8 * 8
        yield x[a:i], x[i + 1 : a + 8]
        i //= 8


def plain_manifest(rows):
    leaf = lambda r, t: H(map(said, (r[0], r[3], r[2], r[4], t)))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: levels([x[2] for x in sorted(langs[k], key=lambda x: x[:3])]) for k in names}
    top = levels([trees[k][-1][0] for k in names])
    for k, name in enumerate(names):
        for i, (_, _, h, r) in enumerate(sorted(langs[name], key=lambda x: x[:3])):
            steps = [*path(trees[name], i), *path(top, k)]
            now = h if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 else leaf(r, r[1] and r[1].translate(lower))
            for a, b in steps:
                now = H([*a, now, *b])
            yield r[0], h, trees[name][-1][0], top[-1][0], H(x for a, b in steps for x in a + b), now, now == top[-1][0]


def sample(n):
    langs = [None, "", "a", "é", "Z", "zz", *(f"l{i}" for i in range(12))]
    out = []
    for i in range(n):
        lang = "hot" if i % 3 == 0 else rng.choice(langs)
        doc_id = rng.choice([None, 7, i, i, i, -i])
        out.append((doc_id, rng.choice([None, "", "Ab É c" * rng.randint(1, 9), "x"]), lang, rng.choice([None, "s", "ü"]), rng.choice([None, i])))
    return out + out[:5]


def manifest_of(docs, **more):
    where = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.manifest(docs, COLUMNS, "lang", "doc_id", {"text": merkle.lower_ascii("text")}, where, **more)


@pytest.mark.parametrize("n", [1, 8, 9, 700])
def test_manifest_equals_plain_version(spark, n):
    rows = sample(n)
    docs = spark.createDataFrame(rows, DOC).withColumn("leaf", F.lit(1)).withColumn("tree", F.lit("x")).withColumn("hash", F.lit(2)).withColumn("key", F.lit(3)).repartition(3)
    got = sorted((tuple(r) for r in manifest_of(docs).collect()), key=str)
    assert got == sorted(plain_manifest(rows), key=str)


def test_manifest_of_more_than_one_partition(spark):
    rows = [(i, f"T{i}", "hot" if i % 3 else "b", "s", i) for i in range(3 * merkle.CHUNK)]
    got = sorted(tuple(r) for r in manifest_of(spark.createDataFrame(rows, DOC)).collect())
    assert got == sorted(plain_manifest(rows))


def test_manifest_of_nothing_and_whole_proofs(spark):
    assert manifest_of(spark.createDataFrame([], DOC)).count() == 0
    rows = [(i, "T", "a", "s", i) for i in range(20)]
    for r in manifest_of(spark.createDataFrame(rows, DOC), whole_proof=True).collect():
        assert H([r.proof]) == r.proof_sha256 and len(r.proof) % 64 == 0


def test_octopus_lists_the_fewest_nodes():
    for _ in range(200):
        total = rng.randint(1, 700)
        places = sorted(rng.sample(range(total), rng.randint(1, min(total, 20))))
        tree = levels([H([str(i)]) for i in range(total)])
        arms = merkle.missing(places, total)
        held = {(0, i) for i in places}
        for k in range(len(tree) - 1):  # nothing fetched could be derived, and no arm is there twice
            held |= {(k + 1, i // 8) for at, i in held if at == k}
        assert len(set(arms)) == len(arms) and not held & set(arms)
        nodes = merkle.derived({i: tree[0][i].encode() for i in places}, {(k, i): tree[k][i].encode() for k, i in arms}, total)
        for i in places:
            steps = list(merkle.siblings(nodes, i, total))
            assert [([x.decode() for x in a], [x.decode() for x in b]) for a, b in steps] == list(path(tree, i))
            assert merkle.folded(tree[0][i].encode(), steps).decode() == tree[-1][0]


def plain_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.add((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words():
    n, k = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 5])
    w = [str(rng.randrange(k)) for _ in range(n)]
    for _ in range(rng.randint(0, 2)):
        p, a = rng.randint(1, max(1, n // 4)), rng.randrange(n + 1)
        w = w[:a] + (w[a : a + p] * n)[: rng.randint(0, n)] + w[a + p :]
    return w


def test_text_runs_equal_plain_version():
    for _ in range(1500):
        w = some_words()
        assert list(map(tuple, runs.text_runs(w).tolist())) == plain_runs(w), w


def test_extensions_equal_plain_version():
    import numpy as np

    for _ in range(200):
        w = [int(x) + 1 for x in some_words()] or [1]
        x, n = runs.Extensions(w), len(w)
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j][:500]
        if pairs:
            i, j = map(np.array, zip(*pairs, strict=True))
            want = [next((k for k in range(n) if max(a, b) + k >= n or w[a + k] != w[b + k]), 0) for a, b in pairs]
            assert x.agree(i, j).tolist() == want
        lyndon = lambda u: all(u < u[k:] for k in range(1, len(u)))
        for inverse in (False, True):
            own = [-v for v in w] if inverse else w
            assert x.lyndon(inverse).tolist() == [max(k for k in range(1, n - a + 1) if lyndon(own[a : a + k])) for a in range(n)]


def plain_row(doc_id, text, tails):
    w = [x for x in (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if x]
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if tails and h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    drop = {i for s, l, q in found for i in range(s + q, s + l)}
    best = sorted(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    s, l, q = best[0] if best else (None, None, None)
    return (doc_id, len(found), s, l, q, best and 1000 * l // q or None, H(f"{a},{b},{c}\n" for a, b, c in found), H(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_periodic_runs_equal_plain_version(spark):
    texts = [None, "", " \t\n", "x", "x y z " * 9, "a b\x1c c " * 7, *(rng.choice([" ", "\n", "\t "]).join(some_words()) for _ in range(150)), "q w e " * 3000 + "end"]
    rows = [(rng.choice([None, 5, i, i, i, -i]), t) for i, t in enumerate(texts)]
    rows += rows[:6]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(9)).withColumn("n_runs", F.lit("x")).repartition(3)
    for tails in (False, True):
        got = sorted((tuple(r) for r in runs.periodic_runs(docs, tails).collect()), key=str)
        assert got == sorted((plain_row(i, t, tails) for i, t in rows), key=str)
    assert runs.periodic_runs(docs.limit(0)).count() == 0
