"""The recurrence over a stream: state kept between batches, late days dropped."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "vault string, state string, day date, v_fast double, v_slow double, v double, fired boolean"
STATE = "fast double, slow double, last int, fired_on int"


def spiking_stream(daily: DataFrame, neurons: dict) -> DataFrame:
    """As the batch recurrence with resets, for a stream of (vault, state, day, evidence, completion): each (vault, state) keeps its traces, its last day and its last firing.

    A row whose day isn't after the last one is late and dropped. Rows of one batch are put in order of days; batches are the calendar's pieces, so a key has
    few rows in each.
    """

    def advance(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p = neurons[key[1]]
        fast, slow, last, fired_on = state.get if state.exists else (0.0, 0.0, None, None)
        rows, out = pd.concat(list(batches)), []
        rows = rows.assign(n=[(d - pd.Timestamp(0).date()).days for d in rows["day"]]).sort_values("n")
        for r in rows.itertuples(index=False):
            if last is not None and r.n <= last:
                continue
            gap = 1 if last is None else max(r.n - last, 1)
            fast = max(0.0, p.decay**gap * fast + r.evidence - r.completion)
            slow = max(0.0, p.slow_decay**gap * slow + r.evidence * p.slow_input - r.completion * p.slow_completion)
            v = (p.fast_weight * fast + p.slow_weight * slow) / (p.fast_weight + p.slow_weight)
            hit = v >= p.theta and (fired_on is None or r.n - fired_on >= p.cooldown_days)
            out.append((*key, r.day, fast, slow, v, hit))
            last = r.n
            if hit:
                fired_on, fast, slow = r.n, p.theta * p.reset_ratio, min(slow, p.theta * 0.60)
        state.update((fast, slow, last, fired_on))
        yield pd.DataFrame(out, columns=["vault", "state", "day", "v_fast", "v_slow", "v", "fired"])

    return daily.groupBy("vault", "state").applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, length: str = "1 day", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Count and mean value of each event type by event-time window; rows that come ``late`` after the newest are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(w, "event_type").agg(F.count("*").alias("events"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "events", "mean")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events")).select(F.col("session_window.start").alias("start"), "user_id", "events")
