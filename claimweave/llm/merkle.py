"""Merkle dataset manifest (operator 12): trees of width 8 over each language's documents, and octopus multiproofs.

Leaves are hashed by Spark and dealt into ranges of (group, key); running counts give each leaf its place
in its group, and every CHUNK places in a row are a leaf partition. Each partition builds its part of
the tree, whole levels of it, and writes the nodes; what is left, one node a partition, is built the
same way until each group has one node. The groups' nodes are the leaves of one more such tree.

Proofs go by partition, too. For the places it holds, a partition lists the fewest nodes that it can't
derive from its own leaves (`missing`, the arms of the octopus), fetches these once in one join, derives
the interiors that its proofs share, and expands each leaf's own proof from them. So what is fetched
grows with partitions, not with leaves, and the root travels once a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimweave.llm.common import ready, written

WIDTH = 8
LEVELS = 4  #: levels of the tree that one partition builds
CHUNK = WIDTH**LEVELS  #: leaves of a partition
ABOVE = -1  #: the number of the tree over all trees
FEW = 100_000  #: groups, or their parts, sent to every task; more are joined as the planner sees fit
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: Iterable[bytes]) -> bytes:
    """Lowercase hex sha256 of the parts, one after another."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def depth(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // WIDTH), levels + 1
    return levels


def missing(places: Iterable[int], leaves: int) -> list[tuple[int, int]]:
    """The fewest nodes (level, place) beside the leaves at these places that lead to the root of a tree of so many leaves."""
    out, known, level = [], sorted(set(places)), 0
    while leaves > 1:
        have, up = set(known), sorted({i // WIDTH for i in known})
        out += [(level, i) for u in up for i in range(u * WIDTH, min((u + 1) * WIDTH, leaves)) if i not in have]
        known, leaves, level = up, -(-leaves // WIDTH), level + 1
    return out


def derived(leaves: dict[int, bytes], fetched: dict[tuple[int, int], bytes], total: int) -> dict[tuple[int, int], bytes]:
    """All nodes that proofs of these leaves pass or hold: fetched ones, leaves and the interiors derived from both, each once."""
    nodes = {**fetched, **{(0, i): h for i, h in leaves.items()}}
    known, level = sorted(leaves), 0
    while total > 1:
        up = sorted({i // WIDTH for i in known})
        for u in up:
            nodes[level + 1, u] = digest(nodes[level, i] for i in range(u * WIDTH, min((u + 1) * WIDTH, total)))
        known, total, level = up, -(-total // WIDTH), level + 1
    return nodes


def siblings(nodes: dict[tuple[int, int], bytes], place: int, total: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Level by level, the nodes left and right of the one above a leaf's place, in its own run."""
    level = 0
    while total > 1:
        first, end = place // WIDTH * WIDTH, min(place // WIDTH * WIDTH + WIDTH, total)
        yield [nodes[level, i] for i in range(first, place)], [nodes[level, i] for i in range(place + 1, end)]
        place, total, level = place // WIDTH, -(-total // WIDTH), level + 1


def folded(leaf: bytes, path: Iterable[tuple[list[bytes], list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        leaf = digest([*left, leaf, *right])
    return leaf


def leaf_hash(columns: list[str], changed: dict[str, F.Column] | None = None) -> F.Column:
    """H of a row's columns in order: `-` for null, else UTF-8 byte count, colon and value."""
    parts = []
    for c in columns:
        v = (changed or {}).get(c, F.col(c)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def placed(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds place, a row's number within its group by order, chunk and total, the group's rows. Nulls go first; no group is gathered."""
    dealt = leaves.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema]

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, now, last = TaskContext.get().partitionId(), 0, (False, None)
        for pdf in batches:
            spots = []
            for v in pdf[group]:
                here = (True, None if pd.isna(v) else v)
                now, last = (now + 1 if here == last else 0), here
                spots.append(now)
            yield pdf.assign(part=part, spot=spots)

    rows = written(dealt.mapInPandas(number, ", ".join([*kinds, "part int", "spot long"])), "placed")
    parts = rows.groupBy(F.col(group).alias("of"), F.col("part").alias("at")).agg(F.count("*").alias("n"))
    by = W.partitionBy("of")
    bases = written(parts.select("of", "at", F.coalesce(F.sum("n").over(by.orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(by).alias("total")), "bases")
    few = F.broadcast(bases) if bases.count() <= FEW else bases
    met = rows.join(few, F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    return met.withColumn("place", F.col("spot") + F.col("base")).withColumn("chunk", F.expr(f"place div {CHUNK}")).drop("of", "at", "part", "spot", "base")


def _built(batches: Iterator[pd.DataFrame], level: int) -> Iterator[pd.DataFrame]:
    """The levels above rows that come by tree and place."""
    rows = chain.from_iterable(zip(pdf["tree"], pdf["chunk"], pdf["place"], pdf["total"], pdf["hash"], strict=True) for pdf in batches)
    out = []
    for (tree, part), own in groupby(rows, key=lambda r: r[:2]):
        now, total = [], 0
        for _, _, i, total, h in own:
            now.append((i, h.encode()))
        for up in range(1, min(LEVELS, depth(total)) + 1):
            now = [(u, digest(h for _, h in run)) for u, run in groupby(now, key=lambda x: x[0] // WIDTH)]
            out += [(tree, level + up, u, -(-total // WIDTH**up), h.decode()) for u, h in now]
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=["tree", "level", "place", "total", "hash"])
            out = []
    yield pd.DataFrame(out, columns=["tree", "level", "place", "total", "hash"])


def nodes_above(leaves: DataFrame) -> DataFrame:
    """The nodes above leaves (tree, place, total, hash): tree, level, place, total (nodes of the level), hash. Each round builds LEVELS levels."""
    now, level, found = leaves.selectExpr("tree", "place", "total", "hash"), 0, None
    most = depth(int(leaves.agg(F.max("total")).first()[0] or 0))
    while level < most:
        dealt = now.where("total > 1").withColumn("chunk", F.expr(f"place div {CHUNK}")).repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "place")
        got = written(dealt.mapInPandas(lambda it, at=level: _built(it, at), "tree long, level int, place long, total long, hash string"), "nodes")
        found, level = got if found is None else found.union(got), level + LEVELS
        now = got.where(F.col("level") == level).select("tree", "place", "total", "hash")
    return found if found is not None else leaves.selectExpr("tree", "1 as level", "place", "total", "hash").limit(0)


def _needed(batches: Iterator[pd.DataFrame], trees: int) -> Iterator[pd.DataFrame]:
    """The nodes that the leaves of each partition lack, in their own tree and in the one above all; rows come by tree and chunk."""
    rows = chain.from_iterable(zip(pdf["tree"], pdf["chunk"], pdf["place"], pdf["total"], strict=True) for pdf in batches)
    out = []
    for (tree, part), own in groupby(rows, key=lambda r: r[:2]):
        held = list(own)
        out += [(tree, part, tree, level, i) for level, i in missing((r[2] for r in held), held[0][3])]
        out += [(tree, part, ABOVE, level, i) for level, i in missing([tree], trees)]
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=["tree", "chunk", "of", "level", "place"])
            out = []
    yield pd.DataFrame(out, columns=["tree", "chunk", "of", "level", "place"])


def _proofs(batches: Iterator[pd.DataFrame], trees: int, whole_proof: bool) -> Iterator[pd.DataFrame]:
    """Proofs of leaves that come by tree and chunk, with what was fetched for them."""
    columns = ["key", "key_null", "leaf", "subroot", "root", "proof_sha256", "folded_root", *["proof"] * whole_proof]
    rows = chain.from_iterable(zip(*(pdf[c] for c in ("tree", "chunk", "of", "level", "place", "total", "hash", "other", "key", "key_null")), strict=True) for pdf in batches)
    out = []
    for (tree, _), own in groupby(rows, key=lambda r: r[:2]):
        fetched, top, leaves, told, total = {}, {}, {}, {}, 0
        for _, _, of, level, place, n, h, *rest in own:
            if level >= 0:
                (top if of == ABOVE else fetched)[level, place] = h.encode()
            else:
                leaves[place], told[place], total = h.encode(), rest, n
        nodes = derived(leaves, fetched, total)
        subroot = nodes[depth(total), 0]
        top = derived({tree: subroot}, top, trees)
        root, rest = top[depth(trees), 0], list(siblings(top, tree, trees))
        for place, leaf in leaves.items():
            path, (other, key, key_null) = [*siblings(nodes, place, total), *rest], told[place]
            proof = b"".join(chain.from_iterable(left + right for left, right in path))
            fold = folded(leaf if other is None else other.encode(), path)
            out.append((key, key_null, *(x.decode() for x in (leaf, subroot, root, digest([proof]), fold)), *[proof.decode()] * whole_proof))
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=columns)
                out = []
    yield pd.DataFrame(out, columns=columns)


def proofs(wanted: DataFrame, leaves: DataFrame, nodes: DataFrame, trees: int, whole_proof: bool = False) -> DataFrame:
    """key, key_null, leaf, subroot, root, proof_sha256, folded_root and, if asked for, proof (the siblings up to the root as one string).

    wanted: tree, place, total, hash, other (the leaf to fold, null: hash), key, key_null: any leaves of any trees. leaves:
    tree, place, hash of all; nodes: tree, level, place, hash, with the tree ABOVE over all. The leaves wanted of one CHUNK of places
    are a partition.
    """
    own = wanted.selectExpr("tree", f"place div {CHUNK} as chunk", "-1L as of", "-1 as level", "place", "total", "hash", "other", "key", "key_null")
    sorted_ = own.select("tree", "chunk", "place", "total").repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "place")
    lack = written(sorted_.mapInPandas(lambda it: _needed(it, trees), "tree long, chunk long, of long, level int, place long"), "lacking")
    lowest = lack.where(F.col("of") != ABOVE).agg(F.min("level")).first()[0]
    there = nodes.where((F.col("tree") == ABOVE) | (F.col("level") >= (99 if lowest is None else lowest))).select("tree", "level", "place", "hash")
    if lowest == 0:
        there = there.union(leaves.selectExpr("tree", "0 as level", "place", "hash"))
    arms = lack.join(there.withColumnRenamed("tree", "of"), ["of", "level", "place"]).selectExpr("tree", "chunk", "of", "level", "place", "0L as total", "hash", "cast(null as string) as other", "0L as key", "true as key_null")
    dealt = arms.union(own).repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "level", "place")
    schema = "key long, key_null boolean, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + ", proof string" * whole_proof
    return dealt.mapInPandas(lambda it: _proofs(it, trees, whole_proof), schema)


def manifest(docs: DataFrame, columns: list[str], group: str, key: str, tampered: dict[str, F.Column] | None = None, where: F.Column | None = None, whole_proof: bool = False) -> DataFrame:
    """Rows of docs -> key (a whole number), leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of a row's columns. Leaves of a group ascend by key (null keys first, equal keys by leaf) and their
    tree's one remaining node is the group's subroot; subroots by group (null first, else by bytes) lead to the root in
    the same way. proof_sha256 is of all siblings on the way to the root. folded_root is recomputed from the leaf and
    the proof; rows that meet `where` are first changed by tampered, a column expression for each column's name, and verified says
    whether the root comes out. Repeated rows are leaves of their own; nulls and empty texts hash as such; other columns
    are ignored; an empty table gives no rows.
    """
    ready(docs.sparkSession)
    other = F.when(where, leaf_hash(columns, tampered)) if where is not None else F.lit(None).cast("string")
    ids = docs.select(*(docs[c] for c in dict.fromkeys([*columns, group, key])))
    rows = ids.select(F.col(group).cast("string").alias("grp"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("key"), F.col(key).isNull().alias("key_null"), leaf_hash(columns).alias("hash"), other.alias("other"))
    at = placed(written(rows.withColumn("keyed", ~F.col("key_null")), "hashes"), "grp", ["keyed", "key", "hash"])
    # a tree's number is its group's place among all groups
    groups = at.groupBy("grp").agg(F.max("total").alias("leaves")).withColumn("whole", F.lit(0))
    named = written(placed(groups, "whole", ["grp"]).select(F.col("grp").alias("of"), F.col("place").alias("tree")), "trees")
    trees = named.count()
    leaves = at.join(F.broadcast(named) if trees <= FEW else named, F.col("grp").eqNullSafe(F.col("of")))
    leaves = written(leaves.select("tree", "place", "total", "key", "key_null", "hash", "other"), "leaves")
    nodes = nodes_above(leaves)
    tops = nodes.where("total = 1").select("tree", "hash").union(leaves.where("total = 1").select("tree", "hash"))
    subroots = written(tops.selectExpr(f"{ABOVE}L as tree", "tree as place", f"{trees}L as total", "hash"), "subroots")
    both = nodes.union(subroots.selectExpr("tree", "0 as level", "place", "total", "hash")).union(nodes_above(subroots))
    got = proofs(leaves, leaves, both, trees, whole_proof)
    back = F.when(~F.col("key_null"), F.col("key")).alias(key)
    return got.select(back, "leaf", "subroot", "root", "proof_sha256", "folded_root", F.expr("folded_root = root").alias("verified"), *["proof"] * whole_proof)


def lower_ascii(c: str) -> F.Column:
    """A column with A-Z lower-cased and nothing else."""
    return F.translate(c, _UPPER, _LOWER)
