"""Line dedup (operator 2): three-line windows, repeated windows found globally, later occurrences removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import may_be_among, ready, text_id, written

WINDOW = 3
_BARE = "trim(both '\t\u000b\f\r ' from {})"


def repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents (doc_id, text, ...) -> doc_id, n_lines, n_removed, kept_text.

    Lines with a word are hashed in overlapping windows of `window` consecutive lines, without spaces at
    their ends. Of each window that occurs again anywhere, the first occurrence (smallest doc_id, null first,
    then text hash, then line) stays; the lines of later ones go, covered positions merged. A later
    occurrence that overlaps the first in the same document leaves the first whole. Lines without a word are
    in no window and stay. Texts with fewer lines than a window, null and empty texts stay as they are (null
    stays null). Rows with equal doc_id and text are one document, treated alike; other rows are documents
    of their own, also where their doc_id is null or repeated. Other columns are ignored; an empty table
    gives no rows. The work grows with a text's lines in proportion; texts that lose nothing aren't shuffled.
    """
    ready(docs.sparkSession)
    rows = docs.select("doc_id", *text_id(), "text")
    lines = rows.where("text is not null").selectExpr("doc_id", "x1", "x2", f"filter(transform(split(text, '\n'), x -> {_BARE.format('x')}), x -> x <> '') as ls").where(f"size(ls) >= {window}")
    parts = lambda salt: f"xxhash64({salt}, l" + "".join(f", ls[k + {j}]" for j in range(1, window)) + ")"
    spots = lines.selectExpr("doc_id", "x1", "x2", f"explode(transform(slice(ls, 1, size(ls) - {window - 1}), (l, k) -> struct({parts(1)} as h1, {parts(2)} as h2, k as k))) as w").select("doc_id", "x1", "x2", "w.*")
    firsts = spots.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "x1", "x2", "k")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = "doc_id <=> first.doc_id and x1 = first.x1 and x2 = first.x2"
    later = spots.join(firsts, ["h1", "h2"]).where(f"not ({own} and k = first.k)")
    gone = later.selectExpr("doc_id", "x1", "x2", f"if({own}, greatest(k, first.k + {window}), k) as lo", f"k + {window - 1} as hi").where("lo <= hi")
    per = gone.groupBy(F.col("doc_id").alias("dup_id"), F.col("x1").alias("d1"), F.col("x2").alias("d2")).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    per = written(per.selectExpr("dup_id", "d1", "d2", "array_distinct(flatten(transform(spans, s -> sequence(s.lo, s.hi)))) as covered"), "covered")

    may_be = may_be_among(docs.sparkSession, per.select(F.xxhash64("dup_id", "d1", "d2").alias("k")))
    touched = may_be(F.xxhash64("doc_id", "x1", "x2"))
    same = F.col("doc_id").eqNullSafe(F.col("dup_id")) & (F.col("x1") == F.col("d1")) & (F.col("x2") == F.col("d2"))
    cut = rows.where(touched).join(per, same, "left").selectExpr("doc_id", "text", "covered", "split(text, '\n') as raw")
    # each array is used twice below, so that it is a column of its own and not made again inside a lambda
    cut = cut.selectExpr("doc_id", "text", "covered", "raw", f"filter(sequence(0, size(raw) - 1), i -> {_BARE.format('raw[i]')} <> '') as worded")
    cut = cut.selectExpr("doc_id", "text", "raw", "if(covered is null or size(worded) = 0, cast(array() as array<int>), transform(covered, k -> worded[k])) as gone")
    kept = "array_join(transform(array_except(sequence(0, size(raw) - 1), gone), i -> raw[i]), '\n')"
    cut = cut.selectExpr("doc_id", "coalesce(cast(size(raw) as long), 0L) as n_lines", "cast(size(gone) as long) as n_removed", f"if(size(gone) = 0, text, {kept}) as kept_text")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    return rows.where(~touched).select("doc_id", n.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept_text")).unionByName(cut)
