from random import Random

import numpy as np

from driftnote.llm import leakage as L

R = Random(4)
ITEMS = [(i, "".join(R.choice("abcdefghijklmnop") for _ in range(150))) for i in range(6)]


def noise(n):
    return "".join(R.choice("qrstuvwxyz0123456789") for _ in range(n))


def test_found(spark):
    t = dict(ITEMS)
    edited = t[2][:20] + "Q" + t[2][21:60] + t[2][61:]
    docs = [(1, noise(300) + t[0][30:75] + noise(50)), (2, noise(100) + t[0][30:69] + noise(9)), (3, t[1] + noise(10) + t[3][:40]), (4, None), (5, ""), (6, noise(40) + edited), (7, noise(400_000) + t[5]), (3, t[1] + noise(10) + t[3][:40])]
    docs = [(i, None if d is None else " - ".join(d[k : k + 50].upper() for k in range(0, len(d), 50))) for i, d in docs]
    df = spark.createDataFrame([(i, d, 5) for i, d in docs], "doc_id long, text string, item_id int")
    rows = L.leaked_passages(df, "doc_id", "text", ITEMS).collect()
    exact = sorted((r["id"], r["item_id"]) for r in rows if r["exact_run"] >= 40)
    assert exact == sorted([(1, 0), (3, 1), (3, 1), (3, 3), (3, 3), (6, 2), (7, 5)])
    six = next(r for r in rows if r["id"] == 6)
    assert six["edits"] == 2 and six["item_start"] <= 1 and six["item_end"] >= 148
    assert {r["item_id"] for r in rows if r["id"] == 2} <= {0}


def test_edges(spark):
    df = spark.createDataFrame([(1, "x" * 500), (2, None)], "doc_id long, text string")
    assert L.leaked_passages(df, "doc_id", "text", []).count() == 0
    assert L.leaked_passages(df, "doc_id", "text", [(1, "short"), (2, None)]).count() == 0
    assert L.leaked_passages(df.limit(0), "doc_id", "text", ITEMS).count() == 0
    assert {r["item_id"] for r in L.leaked_passages(df, "doc_id", "text", [(1, "x" * 60)]).collect()} == {1}


def test_banded():
    code = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    got = L.banded([(code("kitten"), code("xxsitteny"), 0, 4), (code("abc"), code("abc"), 0, 0), (code("abcdef"), code("abdef"), -2, 1)])
    assert got[0].sum() == 1 and got[0][0] and got[1].sum() == 0 and got[2].sum() == 1 and got[2][2]


def test_rolling():
    c = np.arange(50, dtype=np.uint32) % 7
    for q in (1, 2, 3, 5, 8, 13):
        h = L.rolling(c, q)
        assert len(h) == 50 - q + 1 and h[0] == h[7] and (q == 1 or len(set(h.tolist())) == 7)
