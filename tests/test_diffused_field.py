"""The field over the graph, against the same steps over dictionaries."""

import datetime
import math

import pytest

from driftnote.operators import vectors as V
from driftnote.plans import field_queries as Q

DAY = datetime.date(2025, 12, 1)
NOTES = [
    (1, "a/one.md", DAY, "one", "LIF 事件率 阈值 的记录", ["x"], ["two"]),
    (2, "b/two.md", DAY, "two", "garden walk", [], []),
    (3, "c/three.md", DAY, "three", "garden tea", [], ["two"]),
    (4, "d/four.md", DAY, "four", "drift of samples", [], []),
    (5, "e/five.md", DAY, "five", "quiet", [], []),
]
EDGES = {1: {2}, 2: {1, 3}, 3: {2}}


def _unit(v):
    n = math.sqrt(sum(x * x for x in v.values())) or 1.0
    return {k: x / n for k, x in v.items()}


def _mix(parts):
    out = {}
    for v, w in parts:
        for k, x in v.items():
            out[k] = out.get(k, 0.0) + x * w
    return _unit(out)


def _diffused(vectors):
    for _ in range(2):
        vectors = {i: _mix([(v, 0.65), (_mix([(vectors[j], 1.0) for j in EDGES[i]]), 0.35)]) if i in EDGES else v for i, v in vectors.items()}
    return vectors


@pytest.fixture
def folder(spark, tmp_path):
    df = spark.createDataFrame(NOTES, "obs_id long, rel_path string, day date, title string, text string, tags array<string>, links array<string>")
    df.write.parquet(str(tmp_path / "note_observations.parquet"))
    return str(tmp_path)


def _vectors(spark, folder):
    out = {}
    for r in V.sparse_vectors(Q.notes(spark, folder).select("note_id", "text", "title", "tags")).collect():
        out.setdefault(r["note_id"], {})[r["feature"]] = r["weight"]
    return out


def test_hits_and_their_sums(spark, folder):
    own = _vectors(spark, folder)
    diffused, q = _diffused(own), {r["feature"]: r["weight"] for r in Q._query_vector(spark).collect()}
    dot = lambda v: sum(x * q.get(k, 0.0) for k, x in v.items())
    time = math.exp(-(30 * 30) / (2 * 365.0**2))
    want = {}
    for i, v in diffused.items():
        s, c = dot(v), len(EDGES.get(i, ())) / 2
        score = s * math.exp(-((1 - s) ** 2) / (2 * 0.75**2)) * time * (1 + 0.25 * c)
        if s > 0 and score > 0.001:
            want[i] = score
    assert dot(own[2]) == dot(own[3]) == 0 and {2, 3} <= set(want)  # similar by the graph alone
    got = {r["note_id"]: r["score"] for r in Q.vec2_diffused_hits(spark, folder).collect()}
    assert got == pytest.approx(want, abs=2e-6)
    assert Q.agg17_diffused_energy(spark, folder).first()["energy"] == pytest.approx(sum(want.values()), abs=1e-5)
    days = Q.agg16_diffused_days(spark, folder).collect()
    assert len(days) == 1 and days[0]["current"] >= sum(want.values()) - 1e-5
    assert Q.lif10_diffused_calendar(spark, folder).count() == 1


def test_whole_vectors(spark, folder):
    want = {(i, k): x for i, v in _diffused(_vectors(spark, folder)).items() for k, x in v.items()}
    got = {(r["note_id"], r["feature"]): r["weight"] for r in Q.lif14_diffused_vectors(spark, folder).collect()}
    assert got == pytest.approx(want, abs=2e-6)
    assert {(4, "drift"), (5, "title:five"), (2, "事件")} <= set(got)  # words and titles, and rows of notes without topic and tag
