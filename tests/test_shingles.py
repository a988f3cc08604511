"""Shingles of every frequency."""

import datetime

from driftnote.plans import text_queries as Q

NOTES = [(1, "v/a.md", datetime.date(2025, 1, 1), "a", "阈值阈值 x", [], []), (2, "v/b.md", datetime.date(2025, 1, 2), "b", "阈值 事件率", [], [])]


def test_rare_shingles_come_out(spark, tmp_path):
    spark.createDataFrame(NOTES, "obs_id long, rel_path string, day date, title string, text string, tags array<string>, links array<string>").write.parquet(str(tmp_path / "note_observations.parquet"))
    got = {r["shingle"]: r["notes"] for r in Q.txt11_all_shingles(spark, str(tmp_path)).collect()}
    assert got == {"阈值": 2, "值阈": 1, "阈值阈": 1, "值阈值": 1, "阈值阈值": 1, "事件": 1, "件率": 1, "事件率": 1}
