"""The salience signals of fragments."""

import math

import pytest

from driftnote.plans import relation_queries as Q

LONG = "Alpha beta gamma delta epsilon zeta theta kappa 今天提交，今天答辩"
ROWS = [(1, LONG, []), (2, "beta gamma delta epsilon zeta theta kappa 新新", None), (3, None, []), (1, LONG, [])]


def test_signals(spark, tmp_path):
    spark.createDataFrame(ROWS, "fragment_id long, text string, terms array<string>").write.parquet(str(tmp_path / "fragments.parquet"))
    got = {r["fragment_id"]: r for r in Q.sco12_signals(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3}  # fragments without terms or text too
    base = lambda n: 0.06 * max(0.15, min(1.0, math.log(n + 1, 500)))
    one, two = base(len(LONG)), base(len(ROWS[1][1]))
    assert got[1]["urgency"] == pytest.approx(4 / 6 + one, abs=1e-4)  # 今天 twice, 提交, 答辩
    assert got[1]["novelty"] == pytest.approx(one + 3 / 30, abs=1e-4)  # alpha, 今天提交, 今天答辩
    assert got[1]["fatigue"] == 0.0 and got[1]["risk"] == pytest.approx(one, abs=1e-4)
    assert got[2]["novelty"] == pytest.approx(2 / 6 + two + 1 / 30, abs=1e-4) and got[2]["fatigue"] == pytest.approx(two, abs=1e-4)
    assert got[3]["fatigue"] == pytest.approx(0.259) and got[3]["value"] == pytest.approx(0.009)
