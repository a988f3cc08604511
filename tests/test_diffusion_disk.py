"""What the diffused field leaves on disk, and notes that arrive twice or without an id."""

import datetime
from pathlib import Path

import pytest

from driftnote.operators import graph as G
from driftnote.operators import vectors as V
from driftnote.plans import field_queries as Q
from driftnote.session import shared_dir

SCHEMA = "obs_id long, rel_path string, day date, title string, text string, tags array<string>, links array<string>"
LEAVES, WORDS = 60, 100


def _left(spark):
    return sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet"))


def _note(k, text, links, title=None):
    return (k, f"f{k}/n.md", datetime.date(2025, 12, 1), title or f"t{k}", text, ["x"] if k == 1 else [], links)


@pytest.mark.parametrize("name", ["vec2_diffused_hits", "agg16_diffused_days", "agg17_diffused_energy", "lif10_diffused_calendar", "lif14_diffused_vectors"])
def test_a_hub_leaves_no_vectors_of_its_neighbours_on_disk(spark, tmp_path, name):
    rows = [_note(k, " ".join(f"w{k}x{i}" for i in range(WORDS)) + " drift", ["hub"]) for k in range(1, LEAVES + 1)]
    spark.createDataFrame([*rows, _note(99, "drift", [], "hub")], SCHEMA).write.parquet(str(tmp_path / "note_observations.parquet"))
    before = _left(spark)
    count = Q.QUERIES[name](spark, str(tmp_path)).count()
    assert count >= (LEAVES * LEAVES * WORDS if name == "lif14_diffused_vectors" else 1)  # every leaf has every leaf's words
    assert _left(spark) - before < 400_000


def test_notes_that_arrive_twice_or_without_an_id(spark, tmp_path):
    rows = [_note(1, "drift of samples", ["t2"]), _note(2, "garden walk", []), _note(2, "garden walk", []), _note(None, "lone drift", [])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "note_observations.parquet"))
    folder = str(tmp_path)
    want = G.diffuse(V.sparse_vectors(Q.notes(spark, folder).select("note_id", "text", "title", "tags")), Q._neighbours(spark, folder)).collect()
    got = Q.lif14_diffused_vectors(spark, folder).collect()
    assert len(got) == len(want)
    assert {(r["note_id"], r["feature"]): r["weight"] for r in got} == pytest.approx({(r["note_id"], r["feature"]): r["weight"] for r in want}, abs=2e-6)
