"""The field over whole groups: every two notes of a tag or folder are neighbours, against the same steps over a matrix of all pairs."""

import datetime
import math
import random

import numpy as np
import pytest

from driftnote.operators import groups as W
from driftnote.operators import vectors as V
from driftnote.plans import field_queries as Q

SCHEMA = "obs_id long, rel_path string, day date, title string, text string, tags array<string>, links array<string>"
TODAY = datetime.date(2025, 12, 31)


def _field(spark, folder):
    """note_id to score, over dense vectors and a matrix of neighbours."""
    notes = Q.notes(spark, folder).where("note_id is not null").collect()
    ids = sorted(r["note_id"] for r in notes)
    at = {i: k for k, i in enumerate(ids)}
    rows = V.sparse_vectors(Q.notes(spark, folder).select("note_id", "text", "title", "tags")).where("note_id is not null").collect()
    names = {f: k for k, f in enumerate({r["feature"] for r in rows})}  # null among them, of a null tag
    v = np.zeros((len(ids), len(names)))
    for r in rows:
        v[at[r["note_id"]], names[r["feature"]]] = r["weight"]
    key, groups, near = {}, {}, np.zeros((len(ids), len(ids)))
    for r in notes:
        key.setdefault("".join(r["title"].split()).lower(), []).append(at[r["note_id"]])
        for g in {"/" + r["vault"], *("#" + t for t in r["tags"] or [] if t is not None)}:
            groups.setdefault(g, []).append(at[r["note_id"]])
    for r in notes:
        for link in r["links"] or []:
            for k in key.get(link.lower(), []):
                near[at[r["note_id"]], k] = near[k, at[r["note_id"]]] = 1
    for g in groups.values():
        near[np.ix_(g, g)] = 1
    np.fill_diagonal(near, 0)
    unit = lambda m: m / np.where((n := np.sqrt((m * m).sum(1, keepdims=True))) > 0, n, 1)
    degree = near.sum(1)
    for _ in range(2):
        v = np.where(degree[:, None] > 0, unit(0.65 * v + 0.35 * unit(near @ v)), v)
    q = np.zeros(len(names))
    for r in Q._query_vector(spark).collect():
        if r["feature"] in names:
            q[names[r["feature"]]] = r["weight"]
    out = {}
    for r in notes:
        k = at[r["note_id"]]
        s, days = v[k] @ q, (TODAY - r["day"]).days
        out[r["note_id"]] = s * math.exp(-((1 - min(s, 1)) ** 2) / (2 * 0.75**2)) * math.exp(-(days**2) / (2 * 365.0**2)) * (1 + 0.25 * degree[k] / max(degree.max(), 1))
    return {i: s for i, s in out.items() if s > 0.001}


def _notes(count, tags, seed):
    pick = random.Random(seed)
    words = [f"word{k}" for k in range(60)] + ["drift", "LIF", "事件率", "阈值", "频谱"]
    rows = []
    for k in range(1, count + 1):
        text = " ".join([*pick.choices(words, k=pick.randrange(9)), *([f"own{k}", f"12{k}"] if k % 3 else [])])
        links = [f"t{pick.randrange(1, count + 1)}" for _ in range(pick.randrange(3))] + ["t1"] * (k % 9 == 0)
        some = pick.sample(tags, min(len(tags), pick.choice([0, 1, 2, 3]))) + [None] * (k % 11 == 0)
        rows.append((k, f"f{pick.randrange(4)}/n.md", datetime.date(2025, 6, 1) + datetime.timedelta(k % 90), f"t{k // 2 * 2 if k % 10 == 0 else k}", text, some if k % 7 else None, links))
    rows.append((count + 1, "far/n.md", TODAY, "lone", "LIF of its own", [], []))  # no neighbours
    rows += [(count + 2, "nil/n.md", TODAY, "nil", "LIF 阈值 alone", ["none"], []), (count + 3, "nil/m.md", TODAY, "!", "-", ["none"], [])]  # a neighbour without a feature but its tag
    return [*rows, rows[3], (None, "f1/n.md", TODAY, "none", "LIF", ["a"], ["t1"])]


@pytest.mark.parametrize("count, tags, sets", [(40, ["a"], 255), (150, ["a", "b", "c", "ｄ", "e"], 255), (150, ["a", "b", "c", "ｄ", "e"], 1)])
def test_every_note_of_a_group_is_a_neighbour(spark, tmp_path, monkeypatch, count, tags, sets):
    monkeypatch.setattr(W, "SETS", sets)
    spark.createDataFrame(_notes(count, tags, count), SCHEMA).write.parquet(str(tmp_path / "note_observations.parquet"))
    want = _field(spark, str(tmp_path))
    got = {r["note_id"]: r["score"] for r in Q._diffused_hits(spark, str(tmp_path)).collect()}
    assert len(want) > count / 2
    assert got == pytest.approx(want, abs=1e-9)


def test_days_of_more_notes_than_25_in_a_folder(spark, tmp_path):
    rows = [(k, "f/n.md", datetime.date(2025, 12, 1) + datetime.timedelta(min(k, 25)), f"t{k}", "LIF 阈值" if k == 60 else "garden", [], []) for k in range(1, 61)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "note_observations.parquet"))
    assert Q.QUERIES["agg16_diffused_days"](spark, str(tmp_path)).count() == 25  # with the 25 newest alone, older days are without a hit


@pytest.mark.parametrize("sets", [1, 255])
def test_sums_around_classes(monkeypatch, sets):
    monkeypatch.setattr(W, "SETS", sets)
    pick = random.Random(5)
    for most in (2, 5, 9):
        of = sorted({tuple(sorted(pick.sample(range(12), pick.randrange(most + 1)))) for _ in range(6 if sets == 1 else 40)})
        c = W.Classes(np.cumsum([0, *map(len, of)]), np.array([g for s in of for g in s], np.int64))
        w = np.array([pick.random() for _ in of])
        assert c.around(w) == pytest.approx([sum(x for x, t in zip(w, of, strict=True) if set(s) & set(t)) for s in of])
        a, b = np.divmod(np.arange(len(of) ** 2), len(of))
        assert c.share(a, b).tolist() == [bool(set(of[x]) & set(of[y])) for x, y in zip(a, b, strict=True)]
