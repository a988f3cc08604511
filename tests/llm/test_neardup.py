from functools import cache
from random import Random

import numpy as np
import pytest

from driftnote.functions.keys import text_key
from driftnote.llm import neardup as N


@cache
def grams(k):
    return {k[i : i + 3] for i in range(max(1, len(k) - 2))}


def brute(rows, threshold=0.65, least=20):
    rows = sorted({(s, i, k) for s, i, k in rows if i is not None and k and len(k) >= least}, key=str)
    out = set()
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            (s, i, k), (t, j, m) = rows[a], rows[b]
            if s == t and i != j and len(grams(k) & grams(m)) / len(grams(k) | grams(m)) >= threshold:
                out.add((min(i, j), max(i, j)))
    return out


def texts(seed=5, n=120):
    r = Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rows = []
    for i in range(n):
        base = [word() for _ in range(10)]
        rows.append(("s", 10 * i, "".join(base)))
        for k in range(r.randrange(3)):
            new = list(base)
            new[r.randrange(10)] = word()
            if k:
                new[2], new[7] = new[7], new[2]
            rows.append((r.choice(["s", "s", None]), 10 * i + k + 1, "".join(new)))
    return rows


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "scope string, id long, key string")
    pairs = N.NearDuplicates(df, **kw).all_pairs()
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_all_pairs(spark):
    rows = texts()
    rows += [("s", 5001, "x" * 30), ("s", 5002, "x" * 30), ("s", 5003, "x" * 30), ("s", 5003, "x" * 30), ("s", 5004, "short"), ("s", 5005, None), ("s", None, "y" * 40), ("s", 5006, ""), ("s", 5007, "long text " * 20000), ("s", 5008, "long text " * 20000)]
    want = brute(rows)
    assert len(want) > 60 and found(spark, rows) == want


def test_nothing(spark):
    assert found(spark, [("s", 1, "only one text that is long enough")]) == set()
    assert N.NearDuplicates(spark.createDataFrame([], "scope string, id long, key string")).all_pairs().count() == 0


def test_hot_signatures(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 4)
    monkeypatch.setattr(N, "DEPTH", 1)
    rows = [("s", i, "the same boilerplate for every single record of this feed " + c * 3) for i, c in enumerate("abcdefghijklmnop")]
    assert found(spark, [(s, i, text_key(k)) for s, i, k in rows]) == brute([(s, i, text_key(k)) for s, i, k in rows])


def test_frequent_signatures(spark, monkeypatch):
    """Signatures of very many records stay out of the buckets; their records are found all the same."""
    monkeypatch.setattr(N, "HOT", 4)
    monkeypatch.setattr(N, "OFTEN", 4)
    monkeypatch.setattr(N, "FEW", 2)
    monkeypatch.setattr(N, "DEPTH", 0)
    monkeypatch.setattr(N, "BLOCK", 7)
    r = Random(8)
    rows = texts(9, 30) + [("s", 9000 + i, "the same boilerplate for every single record of this feed" + "".join(r.choice("abcdefgh") for _ in range(4))) for i in range(60)]
    reps = spark.createDataFrame([(i, 0, k) for i, (_, _, k) in enumerate(rows)], "rec long, scope long, key string")
    plan = N.planned(reps, 0.65, 1e-3, 8, 5)
    assert len(plan.often) > 0
    assert found(spark, rows) == brute(rows)


def test_blocks(spark):
    rows = [(i, s, f"text number {s} and some more words of it {i % 9}") for s in (1, 2) for i in range(40)]
    df = spark.createDataFrame([(100 * s + i, s, k) for i, s, k in rows], "rec long, scope long, key string")
    got = {(r[0], r[1]) for r in N._by_blocks(df, 0.65, block=6).collect()}
    want = {(100 * s + i, 100 * s + j) for i, s, k in rows for j, t, m in rows if s == t and i < j and len(grams(k) & grams(m)) / len(grams(k) | grams(m)) >= 0.65}
    assert got == want


def test_allocation():
    # one budget, unequal costs: the dear partitions are left out, the cheap ones probed with one value less, those between with all
    t = N.allocate([[1e6, 1e7]] * 10 + [[5e3, 1e5]] * 20 + [[10.0, 200.0]] * 10, 5, 0.65, 1e-3, 1000.0)
    assert t[:10] == [-1] * 10 and set(t[10:30]) == {-1, 0} and t[30:] == [1] * 10
    with pytest.raises(ValueError):
        N.allocate([[1.0, 1.0]], 5, 0.65, 1e-3, 1.0)
    assert N.functions_for(5, 0.3, 1e-3, 6) > 6  # a lower threshold takes more of them


def test_grouping():
    """Values that agree together come into one partition."""
    r = np.random.default_rng(1)
    shared = r.normal(size=(500, 3))
    x = np.stack([shared[:, c % 3] + 0.1 * r.normal(size=500) for c in range(15)], axis=1)
    parts = N.grouped(np.corrcoef(x.T), x.mean(axis=0), 5)
    assert sorted(c for p in parts for c in p) == list(range(15)) and all(len({c % 3 for c in p}) == 1 for p in parts)


def test_bound():
    a, b = "thisisonetextwithsomecontent", "thisisanothertextwithcontent"
    g, h = grams(a), grams(b)
    assert N._most_similar([a], [b])[0] >= len(g & h) / len(g | h)
