"""Language ID by rank-order profiles (operator 4).

A profile is the list of the most frequent character n-grams (1 to 3 letters, words padded by a space).
A text gets the language whose profile lies nearest to its own by the out-of-place distance: the sum
over its n-grams of how far their ranks lie apart, the profile's length for those the language lacks.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimweave.llm.common import ready, written

LENGTH = 300
FLUSH = 200_000
SEGMENT = 1 << 20  #: characters that are counted at a time, or the longest word
MOST_LANGUAGES = 2_000  #: profiles sent to every task: 300 entries of 24 bytes each; more languages are refused
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def _segments(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of a lower-cased text and whether each is a letter, in segments that end where a word ends."""
    at = 0
    while at < len(text):
        step = SEGMENT
        while True:
            raw = text[at : at + step]
            points = np.frombuffer(raw.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
            own = _is_letter()[points]
            if at + step >= len(text):
                yield points, own
                return
            last = next((k for k in range(len(raw) - 1, -1, -1) if not raw[k].isalpha()), -1)
            if last >= 0:
                break
            step *= 2  # one word fills the segment
        points = np.frombuffer(raw[: last + 1].lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        yield points, _is_letter()[points]
        at += last + 1


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text as numbers, in order, and their counts; none without letters."""
    codes, counts = [], []
    for points, own in _segments(text or ""):
        points = np.where(own, points, 32)
        points = np.concatenate(([32], points, [32]))
        points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
        if len(points) < 3:
            continue
        two = points[:-1] << 21 | points[1:]
        three = two[:-1] << 21 | points[2:]
        three = three[points[1:-1] != 32]
        got = np.unique(np.concatenate((points[points != 32], two, three)), return_counts=True)
        codes.append(got[0])
        counts.append(got[1])
    if len(codes) < 2:
        return (codes[0], counts[0]) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    every, back = np.unique(np.concatenate(codes), return_inverse=True)
    return every, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def profile(codes: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by number."""
    return codes[np.argsort(-counts, kind="stable")[:length]]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, list] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            yield pd.DataFrame({"lang": lang, "gram": codes, "n": np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)})

    for pdf in batches:
        for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
            got = grams(text)
            held.setdefault(lang, []).append(got)
            size += len(got[0])
            if size > 10 * FLUSH:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def learn(labelled: DataFrame, length: int = LENGTH) -> DataFrame:
    """Profiles (lang, gram, rank) of all texts (text, lang); rows with null text or lang teach nothing."""
    ready(labelled.sparkSession)
    counts = labelled.where("text is not null and lang is not null").select("text", "lang").mapInPandas(_counted, "lang string, gram long, n long")
    sums = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return sums.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= length).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


def predict(docs: DataFrame, profiles: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds lang_pred and score to docs, whose text alone is looked at.

    Text that is null or has no letter, or no profile at all: `und`, score 0. Of n-grams with equal counts the
    smaller by code points ranks first, of languages at equal distance the first by code point. score is 1 less the distance over the largest possible one.
    """
    spark = docs.sparkSession
    ready(spark)
    rows = profiles.limit(MOST_LANGUAGES * length + 1).collect()  # length rows for each language
    langs = sorted({r.lang for r in rows}, key=lambda x: x.encode())
    if len(langs) > MOST_LANGUAGES or len(rows) > MOST_LANGUAGES * length:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    place = {lang: k for k, lang in enumerate(langs)}
    known = np.array(sorted((r.gram, place[r.lang], r["rank"]) for r in rows), np.int64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast((json.dumps(langs), known.tobytes()))

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        names, table = json.loads(shared.value[0]), np.frombuffer(shared.value[1], np.int64).reshape(-1, 3)
        every, start = np.unique(table[:, 0], return_index=True)
        many = np.diff(np.append(start, len(table)))
        out = []
        for text in texts:
            own = profile(*grams(text), length)
            if not len(own) or not names:
                out.append(("und", 0.0))
                continue
            at = np.minimum(np.searchsorted(every, own), len(every) - 1)
            mine = np.flatnonzero(every[at] == own)  # the text's n-grams that some language has
            n = many[at[mine]]
            rank = np.repeat(mine, n)
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at[mine]], n)
            nearer = length - np.abs(table[entry, 2] - rank)
            away = length * len(own) - np.bincount(table[entry, 1], nearer, len(names))
            best = int(np.argmin(away))
            out.append((names[best], 1 - float(away[best]) / (length * len(own))))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.withColumn("_guess", guess("text")).select(*docs.columns, "_guess.lang_pred", "_guess.score")


def identify(docs: DataFrame, held_out, length: int = LENGTH) -> DataFrame:
    """Documents (doc_id, text, lang, ...) -> doc_id, held_out, lang_pred, score.

    held_out is a condition on doc_id; profiles are learned from all other rows and tell all rows' languages.
    A null doc_id isn't held out. Repeated rows count as often as they are there; other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text", "lang")
    profiles = written(learn(rows.where("not held_out"), length), "profiles")
    return predict(rows.select("doc_id", "held_out", "text"), profiles, length).drop("text")
