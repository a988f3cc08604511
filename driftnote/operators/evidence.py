"""Evidence: blocks of notes matched against the states' lexicons, scored, and added up by day and state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T
from ..tables import bound


def note_blocks(notes: DataFrame, least: int = 4) -> DataFrame:
    """The notes' other columns with block_index and block, one row for each sentence-like block of ``text``."""
    rest = [c for c in notes.columns if c != "text"]
    return notes.select(*rest, F.posexplode(T.blocks(T.normalized(F.col("text")), least)).alias("block_index", "block"))


def _weight() -> tuple[Column, Column]:
    """Target weight of a block for its state and what disambiguated it."""
    found, state, keywords = F.col("found"), F.col("state"), F.col("keywords")
    weight = F.least(0.20 + F.least(F.size("keywords"), F.lit(5)) * 0.20 + F.least(F.size("context"), F.lit(4)) * 0.08, F.lit(1.0))
    recovery = F.array_contains("keywords", "恢复") & T.holds(found, L.SIGNAL_RECOVERY)
    why = (
        F.when((state == "Health") & recovery & ~T.holds(found, L.STRONG_HEALTH), "signal_recovery_not_health_recovery")
        .when((state == "Experiment") & recovery, "signal_recovery_as_experiment_evidence")
        .when((state == "Thesis") & (keywords == F.array(F.lit("导师"))), "mentor_without_thesis_context")
    )
    d = F.col("disambiguation")
    changed = (
        F.when(d == "signal_recovery_not_health_recovery", weight * 0.15)
        .when(d == "signal_recovery_as_experiment_evidence", F.least(weight + 0.20, F.lit(1.0)))
        .when(d == "mentor_without_thesis_context", weight * 0.45)
        .otherwise(weight)
    )
    return changed, why


def block_evidence(blocks: DataFrame, states: list[str] | None = None) -> DataFrame:
    """A row for each block and state that it is evidence for, with its vector, score, modifiers and completion.

    Blocks without a keyword and with under two context words of a state are none for it, nor are those of target weight or score under 0.18.
    One scan of a block finds the words of every list; lists and cues are then looked up among them, and everything else is worked out for matching rows only.
    """
    found, states = F.col("found"), states or list(L.KEYWORDS)
    each = [F.struct(F.lit(s).alias("state"), T.held(found, L.KEYWORDS[s]).alias("keywords"), T.held(found, L.CONTEXT[s]).alias("context")) for s in states]
    lists = [x for s in states for x in (L.KEYWORDS[s], L.CONTEXT[s])] + [L.ACTION, L.TIME_PRESSURE, L.BLOCKER, L.COMPLETION, L.INCOMPLETE, L.NOVELTY, L.SIGNAL_RECOVERY, L.STRONG_HEALTH]
    rows = bound(blocks, {"found": T.found(F.lower("block"), *lists)}).where(F.size("found") > 0).withColumn("s", F.explode(F.filter(F.array(*each), lambda s: (F.size(s["keywords"]) > 0) | (F.size(s["context"]) >= 2))))
    rows = rows.select("*", "s.*").drop("s")
    weight, why = _weight()
    rows = bound(bound(rows, {"disambiguation": why}), {"target_weight": weight}).where("target_weight >= 0.18")
    rows = bound(
        rows,
        {
            "actionability": T.holds(found, L.ACTION).cast("double"),
            "urgency": T.holds(found, L.TIME_PRESSURE).cast("double"),
            "blocker": T.holds(found, L.BLOCKER).cast("double"),
            "completion": (T.holds(found, L.COMPLETION) & ~T.holds(found, L.INCOMPLETE)).cast("double"),
            "specificity": T.specificity(F.col("block")),
            "novelty": T.holds(found, L.NOVELTY).cast("double"),
        },
    ).drop("found")
    confidence = F.least(0.42 + F.size("keywords") * 0.10 + F.size("context") * 0.04 + F.col("specificity") * 0.18, F.lit(1.0))
    multiplier = 0.72 + 0.22 * F.col("actionability") + 0.18 * F.col("urgency") + 0.30 * F.col("blocker") + 0.16 * F.col("specificity") + 0.18 * F.col("novelty")
    rows = rows.withColumn("confidence", confidence).withColumn("score", (0.35 + 2.45 * F.col("target_weight")) * multiplier * F.col("confidence")).where("score >= 0.18")
    modifiers = F.array_compact(
        F.array(
            F.lit("vector_scored"),
            F.when(F.col("actionability") > 0, "action"),
            F.when(F.col("blocker") > 0, "blocker"),
            F.when(F.col("urgency") > 0, "time_pressure"),
            F.when(F.col("specificity") >= 0.25, "specific"),
            F.when(F.col("novelty") > 0, "novelty"),
            F.col("disambiguation"),
            F.when(F.col("completion") > 0, "completion_inhibition"),
        )
    )
    return rows.withColumns({"modifiers": modifiers, "words": F.slice(F.array_union("keywords", "context"), 1, 8), "inhibition": F.col("completion") * 0.85})


def daily_evidence(evidence: DataFrame, keys: list[str], order: list[str], top: int = 6) -> DataFrame:
    """evidence (capped by the state), completion (capped) and the ``top`` items (score, snippet, words, modifiers) by score, for each of ``keys`` and state.

    The sums are combined map-side; only the ranked items' rows are sorted, and the window keeps ``top`` of a group before it collects.
    """
    caps = reduce(lambda a, n: a.when(F.col("state") == n, L.NEURONS[n].evidence_cap), L.NEURONS, F.when(F.lit(False), 0.0))
    sums = evidence.groupBy(*keys, "state").agg(
        F.sum("score").alias("_score"), F.sum("inhibition").alias("_completion"), F.count("*").alias("blocks")
    )
    w = Window.partitionBy(*keys, "state").orderBy(F.col("score").desc(), *order)
    best = evidence.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    item = F.struct("rank", F.round("score", 6).alias("score"), "snippet", "words", "modifiers")
    items = best.groupBy(*keys, "state").agg(F.sort_array(F.collect_list(item)).alias("items"))
    joined = sums.join(items, [*keys, "state"])
    return joined.select(*keys, "state", F.least("_score", caps).alias("evidence"), F.least("_completion", F.lit(2.2)).alias("completion"), "blocks", "items")


def item_topics(text: Column) -> Column:
    """The topics whose words a text holds, in the lexicon's order."""
    found = T.found(F.lower(text), *L.TOPICS.values())
    return F.transform(F.array(found), lambda f: F.array_compact(F.array(*[F.when(T.holds(f, ws), F.lit(t)) for t, ws in L.TOPICS.items()])))[0]


def topic_scores(text: Column, score: Column, state: Column) -> Column:
    """map of topic -> match score times the state's prior, of the topics that a text holds."""
    more = {"实验数据模板": ["实验", "跑数据", "记录数据", "数据模板", "数据闭环"], "AI求职转向": ["简历", "实习", "岗位", "大模型", "all in AI"]}
    return F.transform(F.array(T.found(F.lower(text), *L.TOPICS.values(), *more.values())), lambda f: _topic_entries(f, more, score, state))[0]


def _topic_entries(found: Column, more: dict[str, list[str]], score: Column, state: Column) -> Column:
    entries = []
    for topic, ws in L.TOPICS.items():
        value = score * (1.0 + F.least(F.size(T.held(found, ws)), F.lit(4)) * 0.25)
        if topic == "实验数据模板":
            value = F.when(T.holds(found, more[topic]), value * 1.8).otherwise(value)
        if topic == "求职":
            value = F.when(~T.holds(found, L.TOPICS["求职"]), value * 0.1).otherwise(value)
        if topic == "AI求职转向":
            value = F.when(T.holds(found, more[topic]), value * 1.6).otherwise(value)
        prior = reduce(lambda a, n, t=topic: a.when(state == n, L.TOPIC_PRIORS[n].get(t, 1.0)), L.TOPIC_PRIORS, F.when(F.lit(False), 1.0))
        entries.append(F.when(T.holds(found, ws), F.struct(F.lit(topic).alias("key"), (value * prior).alias("value"))))
    return F.array_compact(F.array(*entries))


def inferred_topics(items: DataFrame, keys: list[str]) -> DataFrame:
    """The topic with the greatest sum of scores for each of ``keys`` and state over rows (text, score); ties go to the first in the lexicon, none to the state's own."""
    order = F.array(*map(F.lit, L.TOPICS))
    scored = items.select(*keys, "state", F.explode_outer(topic_scores(F.col("text"), F.col("score"), F.col("state"))).alias("t"))
    sums = scored.groupBy(*keys, "state", F.col("t.key").alias("topic")).agg(F.sum("t.value").alias("score"))
    best = sums.groupBy(*keys, "state").agg(F.max_by("topic", F.struct(F.round("score", 9), -F.array_position(order, F.col("topic")))).alias("topic"), F.round(F.max("score"), 6).alias("score"))
    fallback = reduce(lambda a, n: a.when(F.col("state") == n, L.FALLBACK_TOPIC[n]), L.FALLBACK_TOPIC, F.when(F.lit(False), ""))
    return best.select(*keys, "state", F.coalesce("topic", fallback).alias("topic"), "score")


def relation_evidence(blocks: DataFrame) -> DataFrame:
    """Blocks that hold a topic's word, with topics, roles (``evidence`` where there is none), the number of words and the score. A number with a unit makes a block a metric."""
    topics, found = {**L.TOPICS, **L.MORE_TOPICS}, F.col("_found")
    rows = bound(blocks, {"_found": T.found(F.lower("block"), *topics.values(), *L.RELATION_ROLES.values())})
    measured = F.rlike("block", F.lit(r"[0-9]+(\.[0-9]+)?\s*(Hz|hz|mV|mv|V|Vpp|RMS|uA|μA|ms|s)(?![\p{L}\p{N}_])"))
    roles = F.array_compact(F.array(*[F.when(T.holds(found, ws) | measured if r == "metric" else T.holds(found, ws), F.lit(r)) for r, ws in L.RELATION_ROLES.items()]))
    words = F.size(F.array_distinct(F.concat(*[T.held(found, ws) for ws in topics.values()])))
    rows = bound(rows.where(F.size("_found") > 0), {"topics": F.array_compact(F.array(*[F.when(T.holds(found, ws), F.lit(t)) for t, ws in topics.items()])), "words": words, "_roles": roles}).where(F.size("topics") > 0)
    rows = rows.withColumn("roles", F.when(F.size("_roles") > 0, F.col("_roles")).otherwise(F.array(F.lit("evidence"))))
    has = lambda *rs: F.arrays_overlap("roles", F.array(*map(F.lit, rs)))
    score = F.lit(0.6) + F.least(F.size("topics"), F.lit(4)) * 0.55 + F.least("words", F.lit(8)) * 0.12 + F.least(F.size("roles"), F.lit(5)) * 0.35
    more = F.when(has("conflict", "failure"), 0.35).otherwise(0.0) + F.when(has("metric"), 0.25).otherwise(0.0) + F.when(has("decision"), 0.25).otherwise(0.0) + F.when(F.size("topics") >= 2, 0.55).otherwise(0.0)
    return rows.withColumn("score", score + more).drop("_found", "_roles")
