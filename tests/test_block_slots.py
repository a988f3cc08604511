"""Slots over the blocks of notes."""

import datetime

import pytest

from driftnote.plans import relation_queries as Q

NOTES = [
    (1, "v/a.md", datetime.date(2025, 1, 1), "a", "alpha beta gamma delta。\n卡在噪声门限电路。", [], []),
    (2, "v/b.md", datetime.date(2025, 1, 4), "b", "alpha beta gamma delta。", [], []),
    (3, "v/c.md", datetime.date(2025, 1, 5), "c", "-- 12 -- 34 --", [], []),
]


def test_blocks_are_observations(spark, tmp_path):
    spark.createDataFrame(NOTES, "obs_id long, rel_path string, day date, title string, text string, tags array<string>, links array<string>").write.parquet(str(tmp_path / "note_observations.parquet"))
    got = {r["slot"]: r for r in Q.lif13_slots(spark, str(tmp_path)).collect()}
    assert {k: (r["observations"], r["notes"]) for k, r in got.items()} == {0: (2, 2), 1: (1, 1)}  # the second block of note 1 has a slot of its own; note 3 has no terms
    # alpha..: 0.55 + 0.04 * 4 a block, 3 days apart; 卡在噪声门限电路: 8 characters, so 7 + 6 + 5 terms and a blocker word
    x, y = 0.71, 0.55 + 0.04 * 18 + 0.35
    assert got[0]["v_fast"] == pytest.approx(x * 0.84**3 + x) and got[0]["v_slow"] == pytest.approx(0.45 * (x * 0.94**3 + x))
    assert got[1]["v_fast"] == pytest.approx(y * 0.84**3) and got[1]["v"] == pytest.approx(0.72 * y * 0.84**3 + 0.28 * 0.45 * y * 0.94**3)
    assert got[0]["loss_mean"] == pytest.approx(0, abs=1e-9)
    terms = {(r["slot"], r["term"]): r["count"] for r in Q.agg27_slot_terms(spark, str(tmp_path)).collect()}
    assert terms[0, "alpha"] == 2 and terms[1, "噪声"] == 1 and len(terms) == 4 + 18
    assert sorted(r["rank"] for r in Q.top10_high_loss(spark, str(tmp_path)).collect()) == [1, 2, 3]
