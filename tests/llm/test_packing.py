from collections import Counter
from random import Random

import numpy as np
import pytest

from driftnote.llm import packing as P


def check(groups, histogram, capacity):
    have = Counter()
    for sizes, n in groups:
        assert n > 0 and sum(sizes) <= capacity
        for s in sizes:
            have[s] += n
    assert have == Counter({s: n for s, n in histogram.items() if n})
    return sum(n for _, n in groups)


def test_plans():
    r = Random(1)
    for capacity in (64, 256, 2048):
        h = Counter(min(capacity, max(1, int(r.lognormvariate(np.log(capacity / 5), 1)))) for _ in range(4000))
        n = check(P.plan(h, capacity), h, capacity)
        assert n <= 1.02 * -(-sum(s * c for s, c in h.items()) // capacity)
    check(P.plan({}, 10), {}, 10)
    check(P.plan({10: 7, 3: 1}, 10), {10: 7, 3: 1}, 10)
    check(P.plan({6: 9}, 10), {6: 9}, 10)


def test_no_more_than_best_fit():
    r = Random(3)
    for repeat in (1, 10):
        for draw in (lambda: int(r.lognormvariate(6, 1)), lambda: r.randint(400, 2048), lambda: r.choice([700, 650, 33, 5])):
            h = Counter(min(2048, max(1, draw())) for _ in range(3000))
            h = Counter({s: n * repeat for s, n in h.items()})
            alone = P._best_fit([], {s: n for s, n in h.items()}, 2048)
            assert check(P.plan(h, 2048), h, 2048) <= check(alone, h, 2048)


def test_nnls():
    a, x = np.array([[1.0, 0, 1], [0, 1, 1]]), np.array([2.0, 0, 3])
    got = P.nnls(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)


def test_frames(spark):
    texts = ["word " * n for n in (0, 1, 3, 3, 3, 10, 40, 41)] + [None, "", "a longer text " * 3000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0)], "id long, text string, size int")
    pieces = P.token_pieces(df, "id", "text", 64)
    rows = P.pack(pieces, 64, rows_a_salt=2).collect()
    encode = P.tokenizer(P.TOKENIZER).encode_ordinary
    total = Counter()
    for r in rows:
        total[r["id"]] += r["size"]
    assert total == Counter({i: len(encode(t)) * (2 if i == 3 else 1) for i, t in enumerate(texts) if t is not None})
    by = {}
    for r in rows:
        assert (r["container"] is None) == (r["size"] == 0)
        if r["size"]:
            by.setdefault(r["container"], []).append((r["position"], r["start"], r["size"], r["unused"]))
    for c in by.values():
        c.sort()
        assert [p for p, *_ in c] == list(range(len(c))) and all(s == sum(x[2] for x in c[:k]) for k, (_, s, _, _) in enumerate(c))
        assert {u for *_, u in c} == {64 - sum(x[2] for x in c)}
    assert sorted(by) == list(range(len(by)))
    assert P.pack(pieces.limit(0), 64).count() == 0
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([(1, 0, 99)], "id long, piece int, size int"), 64)
