import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from driftnote.lexicon import NEURONS, Neuron
from driftnote.operators import recurrence as R


def series(seed, n=60):
    r, day, out = random.Random(seed), date(2024, 1, 1), []
    for _ in range(n):
        day += timedelta(days=r.choice([1, 1, 2, 5]))
        out.append((day, r.random() * 4, r.random() * 2 if r.random() < 0.4 else 0.0))
    return out


def fold(rows, p: Neuron):
    f = s = 0.0
    last = fired_on = None
    out = []
    for day, e, c in rows:
        gap = 1 if last is None else (day - last).days
        last = day
        f = max(0.0, p.decay**gap * f + e - c)
        s = max(0.0, p.slow_decay**gap * s + e * p.slow_input - c * p.slow_completion)
        v = 0.7 * f + 0.3 * s
        hit = v >= p.theta and (fired_on is None or (day - fired_on).days >= p.cooldown_days)
        out.append((day, v, hit))
        if hit:
            fired_on, f, s = day, p.theta * p.reset_ratio, min(s, p.theta * 0.6)
    return out


def frame(spark):
    rows = [("v", s, d, e, c) for i, s in enumerate(NEURONS) for d, e, c in series(i)]
    return spark.createDataFrame(rows, "vault string, state string, day date, evidence double, completion double")


def parameters(spark):
    from driftnote.plans.evidence_queries import _parameters

    return _parameters(spark)


def test_closed_form_is_the_fold_without_resets(spark):
    got = {(r["state"], r["day"]): r["v"] for r in R.two_timescale(frame(spark), ["vault"], parameters(spark)).collect()}
    for i, (s, p) in enumerate(NEURONS.items()):
        free = Neuron(**{**p.__dict__, "theta": 1e9})
        for day, v, _ in fold(series(i), free):
            assert abs(got[s, day] - v) < 1e-8


def test_resets(spark):
    got = {(r["state"], r["day"]): (r["v"], r["fired"]) for r in R.spiking(frame(spark), ["vault"], parameters(spark)).collect()}
    fired = 0
    for i, (s, p) in enumerate(NEURONS.items()):
        for day, v, hit in fold(series(i), p):
            assert abs(got[s, day][0] - v) < 1e-8 and got[s, day][1] == hit
            fired += hit
    assert fired > 3


def test_budget(spark):
    rows = R.budgeted(frame(spark), "vault", NEURONS, 1).where("fired").groupBy("day").count().collect()
    assert rows and max(r["count"] for r in rows) == 1


def test_calendar_and_empty(spark):
    df = spark.createDataFrame([("k", date(2024, 1, 1), 2.0, 0.0), ("k", date(2024, 1, 5), 0.0, 0.45)], "key string, day date, current double, completion double")
    out = R.calendar_field(df, ["key"]).orderBy("day").collect()
    assert len(out) == 5 and out[0]["fired"] and abs(out[0]["v"] - (8 * 0.65 + 8 * 0.42 * 0.35)) < 1e-9
    assert R.calendar_field(df.limit(0), ["key"]).count() == 0
    assert R.spiking(frame(spark).limit(0), ["vault"], parameters(spark)).count() == 0


def test_twelve_years_equal_the_fold(spark):
    """A decay that would overflow as one closed form, gaps of years and same-day rows; a null key is a key."""
    r = random.Random(2)
    rows, day = [], date(2010, 1, 1)
    for i in range(900):
        day += timedelta(days=r.choice([0, 1, 1, 2, 9, 900 if i % 100 == 7 else 24]))
        rows += [(k, day, i, r.uniform(-2, 3)) for k in ("a", None)]
    df = spark.createDataFrame(rows, "k string, day date, i int, x double")
    got = {(x["k"], x["i"]): x["v"] for x in R.leaky_closed(df, ["k"], F.col("x"), 0.4, "v", ["i"]).collect()}
    for key in ("a", None):
        v, last = 0.0, None
        for k, d, i, x in rows:
            if k == key:
                v = max(0.0, 0.4 ** ((d - last).days if last else 0) * v + x)
                last = d
                assert abs(got[key, i] - v) < 1e-9
    assert (last - rows[0][1]).days > 12 * 365
