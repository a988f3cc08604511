"""Merging policies of topics from several sources, and feedback folded into them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: spellings of each label of feedback, and what it does: threshold, least cooldown, cooldown step, muted, priority, action
SPELLINGS = {
    "useful": ["有用", "useful", "helpful"],
    "useless": ["没用", "无用", "useless", "not_useful"],
    "too_early": ["太早", "too_early"],
    "too_late": ["太晚", "too_late"],
    "done": ["已完成", "完成", "done", "completed"],
    "mute": ["不要再提醒", "静音", "mute", "muted"],
    "raise_p0": ["升为p0", "p0", "raise_p0"],
    "lower_p2": ["降为p2", "p2", "lower_p2"],
}
LABELS = {
    "useful": (-0.25, 0, -1, False, None, None),
    "useless": (1.0, 3, 0, False, "P2", None),
    "too_early": (0.75, 2, 0, False, None, None),
    "too_late": (-0.75, 0, -1, False, "P1", None),
    "done": (0.0, 7, 0, False, "P2", "stop"),
    "mute": (0.0, 30, 0, True, "P2", "stop"),
    "raise_p0": (0.0, 0, 0, False, "P0", None),
    "lower_p2": (0.0, 0, 0, False, "P2", None),
}
# fixed values: what closing an event does to its topic: threshold, priority, whether it holds against one that is set, action likewise, days of cooldown
CLOSURES = {
    "done": (0.5, "P2", False, "stop", 2),
    "downgraded": (1.0, "P2", True, "downgrade", 7),
    "ignored": (0.75, "P2", True, "stop", 3),
    "postponed": (0.25, None, False, None, 1),
}
STATUS = {"已完成": "done", "完成": "done", "关闭": "done", "降级": "downgraded", "已降级": "downgraded", "忽略": "ignored", "推迟": "postponed", "延期": "postponed"}


def _map(table: dict[str, object], value: Callable[[object], Column]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), value(v))])


def label_effect(label: Column) -> Column:
    """What a label does, in whichever spelling: struct<delta, least, step, mute, priority, action>; null for an unknown one."""
    names = ("delta", "least", "step", "mute", "priority", "action")
    effect = {w: LABELS[k] for k, ws in SPELLINGS.items() for w in ws}
    of = _map(effect, lambda v: F.struct(*[(F.lit(y).cast("string") if y is None else F.lit(y)).alias(n) for n, y in zip(names, v)]))
    return F.try_element_at(of, F.replace(F.lower(F.trim(label)), F.lit(" "), F.lit("_")))


def closure_status(status: Column, checked: Column) -> Column:
    """The status of a closed event, in whichever spelling; a checked box closes one that is open."""
    s = F.replace(F.lower(F.trim(F.coalesce(status, F.lit("")))), F.lit(" "), F.lit("_"))
    s = F.coalesce(F.try_element_at(_map(STATUS, F.lit), s), s)
    s = F.when(s.isin(*CLOSURES), s).otherwise("open")
    return F.when(F.coalesce(checked, F.lit(False)) & (s == "open"), "done").otherwise(s)


def closed_policies(closures: DataFrame) -> DataFrame:
    """The closures (seq, topic, status, feedback, ...) with the policy that each makes: that of its feedback, if it has any, and that of its status. Open ones and those without a topic make none."""
    e = label_effect(F.col("feedback"))
    of = _map(CLOSURES, lambda v: F.struct(F.lit(v[0]).alias("delta"), F.lit(v[1]).cast("string").alias("priority"), F.lit(v[2]).alias("holds"), F.lit(v[3]).cast("string").alias("action"), F.lit(v[4]).alias("cooldown")))
    rows = closures.where("topic is not null and trim(topic) <> ''").withColumn("s", F.try_element_at(of, F.col("status"))).where("s is not null").withColumn("e", e)
    either = lambda n: F.when(F.col("s.holds"), F.coalesce(f"s.{n}", f"e.{n}")).otherwise(F.coalesce(f"e.{n}", f"s.{n}"))
    return rows.select(
        *closures.columns, (F.coalesce("e.delta", F.lit(0.0)) + F.col("s.delta")).alias("threshold_delta"), either("priority").alias("priority"), either("action").alias("action"), F.coalesce("e.mute", F.lit(False)).alias("muted"),
        F.greatest(F.coalesce("e.least", F.lit(0)), F.col("s.cooldown")).alias("cooldown_days"), F.lit(1).alias("feedback_count"),
    )


def remembered(closures: DataFrame, today: Column) -> DataFrame:
    """The memory of each topic after its closures (seq, topic, spike_id, status, feedback, closed_on): the last one's record, and the ids of all events."""
    rows = closed_policies(closures)
    until = F.date_add(F.coalesce("closed_on", today), _map({k: v[4] for k, v in CLOSURES.items()}, F.lit)[F.col("status")])
    rows = rows.withColumn("cooldown_until", until)
    record = F.struct("status", "threshold_delta", "priority", "action", "muted", "cooldown_days", "cooldown_until", "feedback_count")
    return rows.groupBy("topic").agg(F.max_by(record, "seq").alias("r"), F.array_sort(F.collect_set("spike_id")).alias("spike_ids")).select("topic", "r.*", "spike_ids")


def recalled(memory: DataFrame, today: Column) -> DataFrame:
    """The policies that the memory still holds on a day: a cooldown runs out, and with it what ``done`` and ``ignored`` did; ``downgraded`` stays."""
    left = F.greatest(F.datediff("cooldown_until", today), F.lit(0))
    rows = memory.withColumn("cooldown_days", F.when(F.col("cooldown_until").isNull(), F.col("cooldown_days")).otherwise(left))
    down, held = F.col("status") == "downgraded", F.col("cooldown_days") > 0
    ignored, done = (F.col("status") == "ignored") & held, (F.col("status") == "done") & held
    least = F.when(down, 1.0).when(ignored, 0.75).when(done, 0.5)
    return rows.select(
        "topic", F.greatest("threshold_delta", least).alias("threshold_delta"), F.when(down | ignored, "P2").when(done, F.coalesce("priority", F.lit("P2"))).otherwise(F.col("priority")).alias("priority"),
        F.when(down, "downgrade").when(ignored, "stop").when(done, F.coalesce("action", F.lit("stop"))).otherwise(F.col("action")).alias("action"), "muted", "cooldown_days", F.greatest("feedback_count", F.lit(1)).alias("feedback_count"),
    )


def merged_policies(policies: DataFrame) -> DataFrame:
    """One policy a topic from rows (seq, topic, threshold_delta, priority, action, muted, cooldown_days, feedback_count): deltas and counts add up, the last priority and action that aren't null hold,
    any mute mutes, the longest cooldown holds. All of it is combined map-side."""
    if "action" not in policies.columns:
        policies = policies.withColumn("action", F.lit(None).cast("string"))
    return policies.groupBy("topic").agg(
        F.sum("threshold_delta").alias("threshold_delta"),
        F.max_by("priority", F.when(F.col("priority").isNotNull(), F.col("seq"))).alias("priority"),
        F.max_by("action", F.when(F.col("action").isNotNull(), F.col("seq"))).alias("action"),
        F.bool_or("muted").alias("muted"),
        F.max("cooldown_days").alias("cooldown_days"),
        F.sum("feedback_count").alias("feedback_count"),
    )


def adjusted_threshold(theta: Column, delta: Column, cooldown: Column) -> Column:
    return F.greatest(F.lit(0.5), theta + F.coalesce(delta, F.lit(0.0)) + 0.15 * F.least(F.coalesce(cooldown, F.lit(0)), F.lit(7)))


def folded_feedback(feedback: DataFrame) -> DataFrame:
    """The policy of each topic after its feedback (seq, topic, label, and if there: threshold_delta, priority, action, cooldown_days, muted, which are applied after the label) in order.

    A label may lengthen the cooldown or take a day off it, and those don't commute, so each topic's items are folded in an ``aggregate``. Unknown labels only count.
    """
    more = {"threshold_delta": "double", "priority": "string", "action": "string", "cooldown_days": "int", "muted": "boolean"}
    given = [(F.col(n) if n in feedback.columns else F.lit(None)).cast(kind).alias(n) for n, kind in more.items()]
    item = F.struct("seq", label_effect(F.col("label")).alias("e"), *given)
    rows = feedback.where("topic is not null and trim(topic) <> ''").groupBy("topic").agg(F.sort_array(F.collect_list(item)).alias("items"))
    none = F.lit(None).cast("string")
    zero = F.struct(F.lit(0.0).alias("threshold_delta"), F.lit(0).alias("cooldown_days"), F.lit(False).alias("muted"), none.alias("priority"), none.alias("action"), F.lit(0).alias("feedback_count"))

    def step(s: Column, item: Column) -> Column:
        e = item["e"]
        cooldown = F.greatest(F.greatest(s["cooldown_days"] + F.coalesce(e["step"], F.lit(0)), F.lit(0)), F.coalesce(e["least"], F.lit(0)), F.coalesce(item["cooldown_days"], F.lit(0)))
        return F.struct(
            (s["threshold_delta"] + F.coalesce(e["delta"], F.lit(0.0)) + F.coalesce(item["threshold_delta"], F.lit(0.0))).alias("threshold_delta"), cooldown.alias("cooldown_days"),
            F.coalesce(item["muted"], s["muted"] | F.coalesce(e["mute"], F.lit(False))).alias("muted"), F.coalesce(item["priority"], e["priority"], s["priority"]).alias("priority"), F.coalesce(item["action"], e["action"], s["action"]).alias("action"),
            (s["feedback_count"] + 1).alias("feedback_count"),
        )

    return rows.select("topic", F.aggregate("items", zero, step).alias("p")).select("topic", "p.*")
