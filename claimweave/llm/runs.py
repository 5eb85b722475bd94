"""Periodic run detection (operator 13): suffix-tree LCE and Lyndon roots, in tasks.

A run of period q holds at least 3 q words in a row that each occurred within the q words before it. So
a text is first screened for stretches of words that recur within 2**k, k = 0, 1, ...: every run, with
what it could be extended by, lies inside one of them. Each stretch then goes through the whole method:

* Ukkonen's suffix trees of the stretch and of its reversal, over word numbers;
* a tour of each tree gives the leaves in order and the depth of the turning point between neighbours;
  the longest common extension of two places is a range minimum over these, by a sparse table in
  constant time;
* the longest Lyndon word at each place, under the order of the words and under its inverse, is the
  place's candidate root; every run has such a root with its smallest period;
* each root is extended to both sides by one extension query per tree.

Texts never leave their task, so there is no shuffle. Memory is linear in the longest stretch, about 300
bytes a word and tree.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import nulled, ready, whole

LEAST = 6  #: words of the shortest run
TIMES = 4  #: periods of the shortest run


def suffix_tree(s: list[int], sigma: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Ukkonen's tree of s, which ends in a symbol of its own: where each node's edge starts and ends, and children by node * sigma + symbol.

    Node 0 is the root. Leaves end at len(s) and were made in the order of their suffixes.
    """
    n = len(s)
    start, end, link, child = [0], [0], [0], {}
    node = edge = length = left = 0
    for i, c in enumerate(s):
        left += 1
        pending = 0
        while left:
            if not length:
                edge = i
            key = node * sigma + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if pending:
                    link[pending] = node
                pending = node
            else:
                at = start[below]
                size = end[below] - at
                if length >= size:
                    edge += size
                    length -= size
                    node = below
                    continue
                if s[at + length] == c:
                    length += 1
                    if pending:
                        link[pending] = node
                    break
                middle = len(start)
                start += (at, i)
                end += (at + length, n)
                link += (0, 0)
                child[key] = middle
                child[middle * sigma + c] = middle + 1
                start[below] = at + length
                child[middle * sigma + s[at + length]] = below
                if pending:
                    link[pending] = middle
                pending = middle
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    return start, end, child


class Extensions:
    """The order of the suffixes of a list of word numbers (1, 2, ...), and how far two of them agree."""

    def __init__(self, words: list[int]) -> None:
        s = [*words, 0]
        self.n, self.sigma = len(words), max(s) + 1
        self.start, end, child = suffix_tree(s, self.sigma)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        self.parent, self.symbol, self.child = keys // self.sigma, keys % self.sigma, np.fromiter(child.values(), np.int64, len(child))
        self.end = end
        self.rank, turns = self.tour(self.symbol)
        self.table = [np.array(turns, np.int32)]
        while 2 ** len(self.table) <= len(turns):
            low, step = self.table[-1], 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(low[:-step], low[step:]))

    def tour(self, order: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Ranks of the suffixes and, for each leaf of the tour, the depth at which it turned since the last one; children go by order."""
        by = np.lexsort((-order, self.parent))  # the last child first, as a stack is popped from its end
        kids, first = self.child[by].tolist(), np.searchsorted(self.parent[by], np.arange(len(self.start) + 1)).tolist()
        start, end, depth = self.start, self.end, [0] * len(self.start)
        above = [0] * len(start)
        for p, c in zip(self.parent.tolist(), self.child.tolist(), strict=True):
            above[c] = p
        last, turns, leaves, stack, turn = self.n + 1, [], [], [0], -1
        while stack:
            v = stack.pop()
            here = depth[above[v]]
            if turn < 0:
                turn = here
            if v and end[v] == last:
                leaves.append(start[v] - here)
                turns.append(turn)
                turn = -1
            else:
                depth[v] = here + end[v] - start[v]
                stack += kids[first[v] : first[v + 1]]
        ranks = np.empty(len(leaves), np.int64)
        ranks[leaves] = np.arange(len(leaves))
        return ranks, turns

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes at i and j, i <> j, have in common from their start."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.table[k][low[own]], self.table[k][high[own] - (1 << int(k))])
        return out

    def lyndon(self, inverse: bool) -> np.ndarray:
        """Length of the longest Lyndon word at each place, under the order of the words or its inverse; the end is the least in both."""
        order = np.where(self.symbol > 0, self.sigma - self.symbol, 0)
        rank = (self.tour(order)[0] if inverse else self.rank).tolist()
        nxt = [0] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            j, own = i + 1, rank[i]
            while rank[j] > own:
                j = nxt[j]
            nxt[i] = j
        return np.array(nxt[: self.n]) - np.arange(self.n)


def stretch_runs(words: list[int]) -> np.ndarray:
    """All runs of a list of word numbers as rows start, length, period."""
    n, there = len(words), Extensions(words)
    at = np.concatenate([np.arange(n), np.arange(n)])
    q = np.concatenate([there.lyndon(False), there.lyndon(True)])
    fit = (q * TIMES <= n) & (at + q < n)
    at, q = at[fit], q[fit]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    back = Extensions(words[::-1])
    end = at + q + there.agree(at, at + q)
    start = at - np.where(at > 0, back.agree(n - at, n - at - q), 0)
    found = np.unique(np.stack([start, end - start, q], axis=1), axis=0)
    return found[found[:, 1] >= np.maximum(LEAST, TIMES * found[:, 2])]


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Where runs can lie, as [from, to): overlapping ones are one."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    back = np.full(n, n + 1, np.int64)  # how far back a word last occurred
    same = ids[order[1:]] == ids[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    found, reach = [], 1
    while reach // 2 * TIMES < n:
        least = max(LEAST - reach, (TIMES - 1) * (reach // 2 + 1))  # words in a row that a run of period reach/2 + 1 to reach needs
        near = np.concatenate(([False], back <= reach, [False]))
        edges = np.flatnonzero(near[1:] != near[:-1])
        long_ = edges[1::2] - edges[::2] >= least
        found += zip(np.maximum(edges[::2][long_] - reach, 0).tolist(), edges[1::2][long_].tolist(), strict=True)
        reach *= 2
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def text_runs(words: list) -> np.ndarray:
    """All runs of a list of words as rows start, length, period, by start, then period."""
    first: dict = {}
    ids = np.fromiter(map(first.setdefault, words, range(len(words))), np.int64, len(words))
    found = [np.zeros((0, 3), np.int64)]
    for a, b in stretches(ids):
        numbers = np.unique(ids[a:b], return_inverse=True)[1] + 1
        found.append(stretch_runs(numbers.tolist()) + (a, 0, 0))
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def repeated_tail(words: list, doc_id: int | None) -> list:
    """The words of a text; one text of ten has its tail replaced by repetitions of the tail's first words."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def _rows(batches: Iterator[pd.DataFrame], tails: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc_id, idless, text in zip(pdf["doc_id"], pdf["doc_id_null"], pdf["text"], strict=True):
            words = (text or "").encode("utf-8", "replace").split()  # bytes are split at space and 9 to 13 alone
            if tails:
                words = repeated_tail(words, None if idless else doc_id)
            runs = text_runs(words)
            told = hashlib.sha256("".join(f"{s},{l},{q}\n" for s, l, q in runs.tolist()).encode())
            best = max(runs.tolist(), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
            if len(runs):
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
                np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
            s, l, q = best or (0, 0, 1)
            out.append((doc_id, idless, len(runs), s, l, q, 1000 * l // q, told.hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "doc_id_null", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def periodic_runs(docs: DataFrame, tails: bool = False) -> DataFrame:
    """Documents (doc_id, text, ...) -> doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    A run is a stretch of consecutive words with smallest period q, of at least max(6, 4 q) words, that can't be
    extended. start, length and period are those of the run with the greatest length / period, ties the smallest start,
    then period; null where there is none. The hashes are of all runs by start and period, and of the text without what
    its runs repeat. tails replaces the tails of some texts first, so that there is something to find. Words are compared
    byte by byte. Null and empty texts have no words, so no runs; a null doc_id keeps its tail; repeated rows each have
    their row; other columns are ignored; an empty table gives no rows; texts are taken whole, however long.
    """
    ready(docs.sparkSession)
    schema = "doc_id long, doc_id_null boolean, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    got = docs.select(*whole("doc_id"), "text").mapInPandas(lambda it: _rows(it, tails), schema)
    some = lambda c: F.when(F.col("n_runs") > 0, F.col(c)).alias(c)
    return got.select(nulled("doc_id"), "n_runs", *(some(c) for c in ("start", "length", "period", "exponent_milli")), "runs_sha256", "collapsed_sha256")
