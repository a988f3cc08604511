"""Feedback, closures and what the memory of them still holds."""

from datetime import date

from pyspark.sql import functions as F

from driftnote.operators import policy as P

DAY = date(2026, 5, 20)


def rows(df, key="topic"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_labels_in_both_languages_and_explicit_fields(spark):
    items = [(1, "a", "太晚", None, None), (2, "a", "没用", None, None), (3, "a", "Helpful", None, None), (4, "b", "不要再提醒", None, None), (5, "b", "seen", None, None), (6, "c", "raise p0", 0.5, 9), (7, "c", "有用", None, None), (8, " ", "done", None, None)]
    got = rows(P.folded_feedback(spark.createDataFrame(items, "seq int, topic string, label string, threshold_delta double, cooldown_days int")))
    assert set(got) == {"a", "b", "c"}
    # late: -0.75 and P1; useless: +1 and P2, at least 3 days; helpful: -0.25 and a day less
    assert (got["a"]["threshold_delta"], got["a"]["priority"], got["a"]["cooldown_days"], got["a"]["feedback_count"]) == (0.0, "P2", 2, 3)
    assert (got["b"]["muted"], got["b"]["priority"], got["b"]["action"], got["b"]["cooldown_days"]) == (True, "P2", "stop", 30)
    assert (got["c"]["priority"], got["c"]["threshold_delta"], got["c"]["cooldown_days"]) == ("P0", 0.25, 8)


def test_done_stops_without_muting(spark):
    got = rows(P.folded_feedback(spark.createDataFrame([(1, "a", "已完成")], "seq int, topic string, label string")))["a"]
    assert (got["muted"], got["priority"], got["action"], got["cooldown_days"]) == (False, "P2", "stop", 7)


def closures(spark):
    rows = [(1, "a", "id-1", "done", None, DAY), (2, "a", "id-2", "downgraded", "太晚", DAY), (3, "b", "id-3", "done", None, date(2026, 5, 18)), (4, "c", "id-4", "open", None, DAY), (5, "d", "id-5", "ignored", "有用", None), (6, None, "id-6", "done", None, DAY)]
    return spark.createDataFrame(rows, "seq int, topic string, spike_id string, status string, feedback string, closed_on date")


def test_status_spellings(spark):
    df = spark.createDataFrame([(1, " 已完成 ", False), (2, "Downgraded", False), (3, None, True), (4, "nonsense", False), (5, "推迟", True)], "i int, s string, c boolean")
    got = {r["i"]: r["o"] for r in df.select("i", P.closure_status(F.col("s"), F.col("c")).alias("o")).collect()}
    assert got == {1: "done", 2: "downgraded", 3: "done", 4: "open", 5: "postponed"}


def test_memory_and_its_expiry(spark):
    memory = P.remembered(closures(spark), F.lit(DAY))
    got = rows(memory)
    assert set(got) == {"a", "b", "d"}
    assert got["a"]["spike_ids"] == ["id-1", "id-2"] and got["a"]["status"] == "downgraded"
    assert (got["a"]["threshold_delta"], got["a"]["priority"], got["a"]["action"], got["a"]["cooldown_until"]) == (0.25, "P2", "downgrade", date(2026, 5, 27))
    assert got["d"]["cooldown_until"] == date(2026, 5, 23)
    before, after = rows(P.recalled(memory, F.lit(date(2026, 5, 19)))), rows(P.recalled(memory, F.lit(date(2026, 5, 25))))
    assert (before["b"]["cooldown_days"], before["b"]["action"], before["b"]["priority"]) == (1, "stop", "P2")
    assert after["b"]["cooldown_days"] == 0 and after["d"]["cooldown_days"] == 0
    # downgraded stays, with its least threshold
    assert (after["a"]["action"], after["a"]["threshold_delta"], after["a"]["cooldown_days"]) == ("downgrade", 1.0, 2)


def test_merged(spark):
    made = P.closed_policies(closures(spark))
    got = rows(P.merged_policies(made))
    assert (got["a"]["threshold_delta"], got["a"]["priority"], got["a"]["action"], got["a"]["feedback_count"]) == (0.75, "P2", "downgrade", 2)


def days(n):
    from datetime import timedelta

    return [DAY + timedelta(days=k) for k in range(n)]


def test_replay_with_policies(spark):
    """A topic that feedback calls useless needs more to fire, a muted one never fires though it charges; the budget goes to the others."""
    from driftnote.lexicon import NEURONS
    from driftnote.operators import recurrence as R

    names = list(NEURONS)[:2]
    neurons = {n: NEURONS[n] for n in names}
    rows = [("v", n, d, 9.0, 0.0, topic) for d in days(3) for n, topic in zip(names, ("loud", "quiet"))]
    daily = spark.createDataFrame(rows, "vault string, state string, day date, evidence double, completion double, topic string")
    parameters = spark.createDataFrame([(n, p.theta) for n, p in neurons.items()], "state string, theta double")
    fired = lambda policies, budget=2: sum(
        r["fired"] for r in R.budgeted(R.with_policies(daily, parameters, spark.createDataFrame(policies, "topic string, threshold_delta double, cooldown_days int, muted boolean")), "vault", neurons, budget).collect()
    )
    free = fired([("other", 0.0, 0, False)])
    muted = R.budgeted(R.with_policies(daily, parameters, spark.createDataFrame([("quiet", 0.0, 30, True)], "topic string, threshold_delta double, cooldown_days int, muted boolean")), "vault", neurons, 2).collect()
    assert not any(r["fired"] for r in muted if r["state"] == names[1]) and max(r["v"] for r in muted if r["state"] == names[1]) > NEURONS[names[1]].theta
    assert any(r["fired"] for r in muted if r["state"] == names[0])
    assert fired([("loud", 50.0, 0, False), ("quiet", 50.0, 0, False)]) == 0 < fired([("x", 0.0, 0, False)], 1) <= free
    levels = {r["state"]: r["threshold"] for r in R.with_policies(daily, parameters, spark.createDataFrame([("loud", 1.0, 3, False)], "topic string, threshold_delta double, cooldown_days int, muted boolean")).collect()}
    assert abs(levels[names[0]] - (NEURONS[names[0]].theta + 1.0 + 0.45)) < 1e-9 and levels[names[1]] == NEURONS[names[1]].theta


def test_resumed_run_is_the_whole(spark, tmp_path):
    from random import Random

    from driftnote.lexicon import NEURONS
    from driftnote.operators import recurrence as R
    from driftnote.sources.sinks import load_state, save_state

    r = Random(6)
    rows = [("v", n, d, r.uniform(0, 6), r.choice([0.0, 1.0])) for d in days(20) for n in NEURONS]
    daily = spark.createDataFrame(rows, "vault string, state string, day date, evidence double, completion double")
    key = lambda df: sorted((x["state"], x["day"], round(x["v"], 9), x["fired"]) for x in df.collect())
    whole = key(R.budgeted(daily, "vault", NEURONS, 2))
    middle = F.lit(days(9)[-1])
    assert load_state(spark, str(tmp_path / "none")) is None
    first = R.budgeted(daily.where(F.col("day") < middle), "vault", NEURONS, 2)
    save_state(R.final_states(first, "vault"), str(tmp_path / "state"))
    second = R.budgeted(R.with_saved(daily.where(F.col("day") >= middle), "vault", load_state(spark, str(tmp_path / "state"))), "vault", NEURONS, 2)
    assert sorted(key(first) + key(second)) == whole and any(x[3] for x in whole)
