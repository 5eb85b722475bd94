"""D6, D11, D12 by profile: modes, weights, levels, excluded claims."""

from math import log

import pytest
from pyspark.sql import functions as F

from claimweave.operators import suppression

CLAIMS = "claim_id long, topic string, claim_text string, claim_type string, n_citations int, excluded boolean"
LEXICON = [("silenced", ["banned"], ["unbanned"]), ("mocked", ["laughed"], [])]


def test_narrative_modes(spark):
    df = spark.range(8)
    of = lambda scoring: [r.x for r in df.select(suppression.narrative(F.col("id"), scoring).alias("x")).collect()]
    assert of({"mode": "linear"}) == pytest.approx([min(0.1 * n, 0.95) for n in range(8)])
    assert of(None) == pytest.approx([0, 0.1, 0.2, *(min(0.5 + 0.2 * log(n - 1), 0.95) for n in range(3, 8))])
    assert of({"coincidence_max": 3, "enemy_action_base": 0.6, "max_score": 0.7}) == pytest.approx([0, 0.1, 0.2, 0.2, *(min(0.6 + 0.2 * log(n - 2), 0.7) for n in range(4, 8))])


def test_weights():
    assert suppression.normalised({"a": 2, "b": 2}) == {"a": 0.5, "b": 0.5} and suppression.normalised({"a": 0.5, "b": 0.495}) == {"a": 0.5, "b": 0.495}
    with pytest.raises(ValueError):
        suppression.normalised({"a": 0})


def test_report(spark):
    rows = [(i, "t", "was banned" if i < 3 else "they laughed" if i == 3 else "unbanned banned", ["META", "PRIMARY"][i % 2], 0, None) for i in range(8)]
    rows += [(99, "t", "banned too", "META", 0, True), (50, "gone", "banned", "META", 0, True), (60, "quiet", None, None, None, False), (None, "t", "banned", "META", 3, False)]
    df = spark.createDataFrame(rows, CLAIMS)
    got = {r.topic: r for r in suppression.report(df, LEXICON, ["crackpot"], samples=2).collect()}
    t = got["t"]
    assert set(got) == {"t", "quiet"} and (t.n, t.n_indicators) == (9, 5) and t.categories == {"mocked": 1, "silenced": 4}
    assert [(s.claim_id, s.category, s.term) for s in t.sample_claims] == [(0, "silenced", "banned"), (1, "silenced", "banned")]
    assert t.contributions[0].signal == "narrative" and len(t.contributions) == 2 and t.contributions[0].contribution == pytest.approx(0.4 * t.narrative, abs=1e-6)
    assert got["quiet"].score <= 0.15 and got["quiet"].categories is None and got["quiet"].sample_claims is None
    low = {r.topic: r.level for r in suppression.report(df, LEXICON, [], {"score_levels": {"critical": 0.0}}).collect()}
    assert low == {"t": "CRITICAL", "quiet": "CRITICAL"}
    with pytest.raises(ValueError):
        suppression.report(df, LEXICON, [], {"signal_weights": {"other": 1}})
    assert suppression.report(df.limit(0), LEXICON, []).count() == 0
