"""Leaky recurrences over dated rows, in two forms.

* ``leaky_closed``: without resets V_t = max(0, d**gap * V + x) is two running window functions a segment of the calendar, and a fold of the segments.
* ``leaky_fold``: with resets, cooldowns or averages, an ``aggregate`` over a key's rows in day order, all in the JVM.

Either way the input is one row a key and day, so a key's series is as long as the calendar, however many notes a day has:
the notes are added up (map-side first) before any series is put in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leaky_closed(df: DataFrame, keys: list[str], x: Column, decay: Column | float, out: str, order: list[str] | None = None, day: str = "day", segment: int = 32) -> DataFrame:
    """The trace ``out`` of V_t = max(0, decay**(days since the last row) * V + x), from V = 0, as a window closed form.

    A key's calendar is cut into segments of so many days, each a group of its own. With S_t the running sum of x * decay**-tau in a segment (tau: days since it began) and V_0 the trace at its
    beginning, V_t = decay**tau * (S_t + max(V_0, -(the least S so far))). So a whole segment is a step V_0 -> decay**segment * (S + max(V_0, -least)), and those steps, one row a segment
    however many rows it has, are folded along the calendar. Nothing overflows however long the series is, for decay**-tau stays within a segment; a hot key is as many groups as it has segments.
    """
    d = F.lit(float(decay)) if isinstance(decay, int | float) else decay
    tau = F.datediff(day, F.min(day).over(Window.partitionBy(*keys)))
    rows = df.withColumn("_tau", tau).withColumn("_seg", F.floor(F.col("_tau") / segment).cast("int")).withColumn("_tau", F.col("_tau") - F.col("_seg") * segment).withColumn("_x", x * F.pow(d, -F.col("_tau")))
    run = Window.partitionBy(*keys, "_seg").orderBy(day, *(order or [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_s", F.sum("_x").over(run)).withColumn("_low", F.min("_s").over(run)).withColumn("_decay", d)
    ends = rows.groupBy(*keys, "_seg").agg(F.sum("_x").alias("s"), F.min("_low").alias("low"), F.max("_decay").alias("d"))
    steps = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("_seg").alias("seg"), "s", "low", "d"))).alias("_steps"))
    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("seg"), F.expr("cast(array() as array<struct<seg:int,v:double>>)").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        start = acc["v"] * F.pow(e["d"], (e["seg"] - acc["seg"]) * segment)  # segments without rows decay too
        return F.transform(
            F.array(start), lambda v: F.struct((F.pow(e["d"], F.lit(segment)) * (e["s"] + F.greatest(v, -e["low"]))).alias("v"), (e["seg"] + 1).alias("seg"), F.concat(acc["out"], F.array(F.struct(e["seg"].alias("seg"), v.alias("v")))).alias("out"))
        )[0]

    starts = steps.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.explode(F.aggregate("_steps", zero, step, lambda acc: acc["out"])).alias("_o"))
    starts = starts.select(*[f"_k{i}" for i in range(len(keys))], F.col("_o.seg").alias("_own"), F.col("_o.v").alias("_v0"))
    same = F.col("_seg") == F.col("_own")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = rows.join(starts, same)
    value = F.pow(F.col("_decay"), F.col("_tau")) * (F.col("_s") + F.greatest("_v0", -F.col("_low")))
    return met.withColumn(out, value).drop("_tau", "_seg", "_x", "_s", "_low", "_decay", "_own", "_v0", *[f"_k{i}" for i in range(len(keys))])


def leaky_fold(df: DataFrame, keys: list[str], start: Column, step: Callable[[Column, Column], Column], day: str = "day") -> DataFrame:
    """Fold each key's rows in day order: ``step(state, row)`` gives the next state, a struct like ``start``; the result has keys, day and the states' fields.

    ``start`` holds the zero state; its fields come out once a row. The rows of a key travel as one array, so a key's series has to be bounded (by the calendar).
    """
    inputs = [c for c in df.columns if c not in (*keys, day)]
    series = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(day, *inputs))).alias("_rows"))
    zero = F.struct(start.alias("s"), F.array().cast(f"array<struct<day:date,s:{_type(df, start)}>>").alias("out"))

    def advance(acc: Column, row: Column) -> Column:
        # bind the new state once
        return F.transform(F.array(step(acc["s"], row)), lambda s: F.struct(s.alias("s"), F.concat(acc["out"], F.array(F.struct(row[day].alias("day"), s.alias("s")))).alias("out")))[0]

    folded = series.select(*keys, F.explode(F.aggregate("_rows", zero, advance, lambda acc: acc["out"])).alias("_o"))
    return folded.select(*keys, F.col("_o.day").alias(day), "_o.s.*")


def _type(df: DataFrame, column: Column) -> str:
    return df.limit(0).select(column.alias("c")).schema["c"].dataType.simpleString()


def two_timescale(daily: DataFrame, keys: list[str], parameters: DataFrame) -> DataFrame:
    """Fast and slow traces and their voltage without resets. daily: keys, state, day, evidence, completion. parameters: a row for each state."""
    rows = daily.join(F.broadcast(parameters), "state")  # one row a state, of a fixed list
    fast = leaky_closed(rows, [*keys, "state"], F.col("evidence") - F.col("completion"), F.col("decay"), "v_fast")
    slow = leaky_closed(fast, [*keys, "state"], F.col("evidence") * F.col("slow_input") - F.col("completion") * F.col("slow_completion"), F.col("slow_decay"), "v_slow")
    v = (F.col("fast_weight") * F.col("v_fast") + F.col("slow_weight") * F.col("v_slow")) / (F.col("fast_weight") + F.col("slow_weight"))
    return slow.withColumn("v", v).withColumn("ratio", F.col("v") / F.col("theta"))


def spiking(daily: DataFrame, keys: list[str], parameters: DataFrame) -> DataFrame:
    """The two-timescale recurrence with threshold, cooldown and reset, each state by itself (a daily budget of at least the number of states).

    Comes out: keys, state, day, v_fast, v_slow, v (before the reset), fired.
    """
    names = ["theta", "decay", "slow_decay", "slow_input", "slow_completion", "fast_weight", "slow_weight", "reset_ratio", "cooldown_days"]
    rows = daily.join(F.broadcast(parameters), "state").select(*keys, "state", "day", "evidence", "completion", *names)
    start = F.struct(
        F.lit(0.0).alias("fast"), F.lit(0.0).alias("slow"), F.lit(None).cast("date").alias("last"), F.lit(None).cast("date").alias("fired_on"),
        F.lit(0.0).alias("v_fast"), F.lit(0.0).alias("v_slow"), F.lit(0.0).alias("v"), F.lit(False).alias("fired"),
    )

    def bind(value: Column, then: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), then)[0]

    def step(s: Column, r: Column) -> Column:
        gap = F.greatest(F.coalesce(F.datediff(r["day"], s["last"]), F.lit(1)), F.lit(1))
        fast = F.greatest(F.lit(0.0), F.pow(r["decay"], gap) * s["fast"] + r["evidence"] - r["completion"])
        slow = F.greatest(F.lit(0.0), F.pow(r["slow_decay"], gap) * s["slow"] + r["evidence"] * r["slow_input"] - r["completion"] * r["slow_completion"])

        def fire(t: Column) -> Column:
            v = (r["fast_weight"] * t["f"] + r["slow_weight"] * t["w"]) / (r["fast_weight"] + r["slow_weight"])
            ready = s["fired_on"].isNull() | (F.datediff(r["day"], s["fired_on"]) >= r["cooldown_days"])

            def settle(u: Column) -> Column:
                return F.struct(
                    F.when(u["hit"], r["theta"] * r["reset_ratio"]).otherwise(t["f"]).alias("fast"),
                    F.when(u["hit"], F.least(t["w"], r["theta"] * 0.60)).otherwise(t["w"]).alias("slow"),
                    r["day"].alias("last"),
                    F.when(u["hit"], r["day"]).otherwise(s["fired_on"]).alias("fired_on"),
                    t["f"].alias("v_fast"), t["w"].alias("v_slow"), u["v"].alias("v"), u["hit"].alias("fired"),
                )

            return bind(F.struct(v.alias("v"), ((v >= r["theta"]) & ready).alias("hit")), settle)

        return bind(F.struct(fast.alias("f"), slow.alias("w")), fire)

    return leaky_fold(rows, [*keys, "state"], start, step).select(*keys, "state", "day", "v_fast", "v_slow", "v", "fired")


def with_policies(daily: DataFrame, parameters: DataFrame, policies: DataFrame) -> DataFrame:
    """daily (..., state, topic) with the threshold and the mute that the policies (topic, threshold_delta, cooldown_days, muted) give the topic: a left join, which Spark sends
    around or shuffles by the size of the policies."""
    from .policy import adjusted_threshold

    p = policies.select("topic", "threshold_delta", "cooldown_days", F.col("muted").alias("_muted"), F.lit(True).alias("_known"))
    rows = daily.join(p, "topic", "left").join(F.broadcast(parameters.select("state", "theta")), "state")  # one row a state
    level = F.when(F.col("_known"), adjusted_threshold(F.col("theta"), F.col("threshold_delta"), F.col("cooldown_days"))).otherwise(F.col("theta"))
    return rows.withColumn("threshold", level).withColumn("muted", F.coalesce("_muted", F.lit(False))).drop("threshold_delta", "cooldown_days", "_muted", "_known", "theta")


def with_saved(daily: DataFrame, key: str, saved: DataFrame) -> DataFrame:
    """daily with what a run before left of each (key, state): the table of ``final_states``."""
    old = saved.select(key, "state", F.col("fast").alias("start_fast"), F.col("slow").alias("start_slow"), F.col("last").alias("start_day"), F.col("fired_on").alias("start_fired"))
    return daily.join(old, [key, "state"], "left")


def budgeted(daily: DataFrame, key: str, neurons: dict, budget: int) -> DataFrame:
    """The recurrence of all states of a key together: of those that could fire on a day only the ``budget`` with the greatest ratio do and are reset.

    daily: key, state, day, evidence, completion; if there: ``threshold`` and ``muted`` (of ``with_policies``; a muted state leaks and charges but can't fire), and the columns of ``with_saved``, from which it goes on.
    Comes out: key, state, day, v_fast, v_slow, v (before the reset), threshold, fired, and fast, slow, fired_on as they are kept. Every state has a row on each of the key's days.
    One series a key, days by states long; the fold couples the states, so it runs in pandas, a key at a time.
    """
    import pandas as pd

    more = [c for c in ("threshold", "muted", "start_fast", "start_slow", "start_day", "start_fired") if c in daily.columns]
    columns = [key, "state", "day", "v_fast", "v_slow", "v", "threshold", "fired", "fast", "slow", "fired_on"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        names = list(neurons)
        none = lambda x: None if x is None or pd.isna(x) else x
        state: dict = {n: [0.0, 0.0, None] for n in names}
        out, last = [], None
        if "start_day" in more:
            for r in pdf.dropna(subset=["start_day"]).drop_duplicates("state").itertuples():
                state[r.state] = [r.start_fast, r.start_slow, none(r.start_fired)]
                last = r.start_day if last is None else max(last, r.start_day)
        for day, rows in pdf.sort_values("day").groupby("day", sort=True):
            got = {r.state: r for r in rows.itertuples()}
            gap = 1 if last is None else max((day - last).days, 1)
            last = day
            able, first = [], len(out)
            for order, n in enumerate(names):
                p, s, r = neurons[n], state[n], got.get(n)
                e, c = (r.evidence, r.completion) if r is not None else (0.0, 0.0)
                theta = none(getattr(r, "threshold", None)) or p.theta
                s[0] = max(0.0, p.decay**gap * s[0] + e - c)
                s[1] = max(0.0, p.slow_decay**gap * s[1] + e * p.slow_input - c * p.slow_completion)
                v = (p.fast_weight * s[0] + p.slow_weight * s[1]) / (p.fast_weight + p.slow_weight)
                out.append([pdf[key].iloc[0], n, day, s[0], s[1], v, theta, False])
                if v >= theta and not getattr(r, "muted", False) and (s[2] is None or (day - s[2]).days >= p.cooldown_days):
                    able.append((-v / theta, order, n))
            for _, order, n in sorted(able)[: max(0, budget)]:
                p, s = neurons[n], state[n]
                s[0], s[1], s[2] = p.theta * p.reset_ratio, min(s[1], p.theta * 0.60), day
                out[first + order][7] = True
            for order, n in enumerate(names):
                out[first + order] += state[n]
        return pd.DataFrame(out, columns=columns)

    kind = daily.schema[key].dataType.simpleString()
    rows = daily.select(key, "state", "day", "evidence", "completion", *more)
    return rows.groupBy(key).applyInPandas(fold, f"{key} {kind}, state string, day date, v_fast double, v_slow double, v double, threshold double, fired boolean, fast double, slow double, fired_on date")


def final_states(run: DataFrame, key: str) -> DataFrame:
    """What the next run goes on from: key, state, fast, slow, last (day) and fired_on of each state."""
    last = F.max_by(F.struct("fast", "slow", F.col("day").alias("last"), "fired_on"), "day").alias("s")
    return run.groupBy(key, "state").agg(last).select(key, "state", "s.*")


def calendar(df: DataFrame, keys: list[str], columns: list[str], day: str = "day") -> DataFrame:
    """Every calendar day of each key from its first to its last, with noughts where it has no row."""
    spans = df.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    grid = spans.select(*keys, F.explode(F.sequence("_a", "_b")).alias(day))
    return grid.join(df.select(*keys, day, *columns), [*keys, day], "left").fillna(0.0, columns)


def calendar_field(daily: DataFrame, keys: list[str], threshold: float = 5.0) -> DataFrame:
    """The field recurrence on every calendar day: input times 4, both traces times 0.4 after firing, no cooldown. daily: keys, day, current, completion."""
    start = F.struct(*[F.lit(0.0).alias(n) for n in ("fast", "slow", "v_fast", "v_slow", "v")], F.lit(False).alias("fired"))

    def step(s: Column, r: Column) -> Column:
        fast = F.greatest(F.lit(0.0), s["fast"] * 0.76 + r["current"] * 4.0 - r["completion"])
        slow = F.greatest(F.lit(0.0), s["slow"] * 0.94 + r["current"] * 4.0 * 0.42 - r["completion"] * 0.30)

        def settle(t: Column) -> Column:
            v = t["f"] * 0.65 + t["w"] * 0.35
            hit = v >= threshold
            return F.struct(
                F.when(hit, t["f"] * 0.40).otherwise(t["f"]).alias("fast"), F.when(hit, t["w"] * 0.40).otherwise(t["w"]).alias("slow"), t["f"].alias("v_fast"), t["w"].alias("v_slow"), v.alias("v"), hit.alias("fired")
            )

        return F.transform(F.array(F.struct(fast.alias("f"), slow.alias("w"))), settle)[0]

    return leaky_fold(calendar(daily, keys, ["current", "completion"]), keys, start, step).drop("fast", "slow")
