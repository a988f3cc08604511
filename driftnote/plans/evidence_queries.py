"""Queries over evidence and the voltages it charges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as L
from ..operators import evidence as E
from ..operators import recurrence as R
from ..session import cut, scratch_path
from ..sources.sinks import load_state, save_state
from ..functions import text as T
from ..tables import spread
from .common import NOTES, arrivals, day_as_text, sql_any, sql_list
from .text_queries import _norm, blocks_sql, snippet_sql


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored blocks; notes that came twice are taken once among them, so no text is shuffled."""
    rows = spread(arrivals(spark, sf_dir).select("note_id", "vault", "day", "text"))
    return E.block_evidence(E.note_blocks(rows)).dropDuplicates(["note_id", "block_index", "state"])


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored blocks are written once: sums and ranks both read them, and scoring costs more than they weigh."""
    scored = _evidence(spark, sf_dir).select("note_id", "block_index", "vault", "day", "state", "score", "inhibition", T.snippet(F.col("block")).alias("snippet"), "words", "modifiers")
    return E.daily_evidence(cut(scored, "scored"), ["vault", "day"], ["note_id", "block_index"])


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As _daily, without the items: nothing but sums is shuffled."""
    caps = _parameters(spark).select("state", "evidence_cap")
    sums = _evidence(spark, sf_dir).groupBy("vault", "day", "state").agg(F.sum("score").alias("s"), F.sum("inhibition").alias("c"))
    return sums.join(F.broadcast(caps), "state").select("vault", "day", "state", F.least("s", "evidence_cap").alias("evidence"), F.least("c", F.lit(2.2)).alias("completion"))


def _parameters(spark: SparkSession) -> DataFrame:
    names = ["theta", "decay", "reset_ratio", "evidence_cap", "slow_decay", "slow_input", "slow_completion", "cooldown_days", "fast_weight", "slow_weight"]
    return spark.createDataFrame([(s, *[getattr(n, x) for x in names]) for s, n in L.NEURONS.items()], ["state", *names])


def sco_block_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's evidence vector, score and modifiers for each state."""
    r = lambda c: F.round(c, 6).alias(c)
    return _evidence(spark, sf_dir).select("note_id", "block_index", "state", F.array_join("words", "|").alias("words"), r("target_weight"), r("specificity"), r("confidence"), r("score"), "inhibition", F.array_join("modifiers", "|").alias("modifiers"))


def agg1_daily_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, completion and the six best snippets for each vault, day and state."""
    return _daily(spark, sf_dir).select(
        "vault", "day", "state", F.round("evidence", 6).alias("evidence"), F.round("completion", 6).alias("completion"), "blocks", F.array_join(F.transform("items", lambda i: i["snippet"]), "|").alias("snippets")
    )


def agg4_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic of each vault, day and state, from its four best items."""
    items = _daily(spark, sf_dir).select("vault", "day", "state", F.explode(F.slice("items", 1, 4)).alias("i"))
    text = F.concat_ws(" ", F.col("i.snippet"), F.array_join("i.words", " "))
    return E.inferred_topics(items.select("vault", "day", "state", text.alias("text"), F.col("i.score").alias("score")), ["vault", "day"])


def agg5_topic_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, evidence, blockers and completions of each topic, over the days' best items."""
    items = _daily(spark, sf_dir).select("day", F.explode("items").alias("i"))
    text = F.concat_ws(" ", F.col("i.snippet"), F.array_join("i.words", " "))
    rows = items.select("day", F.explode(E.item_topics(text)).alias("topic"), F.array_contains("i.modifiers", "blocker").alias("b"), F.array_contains("i.modifiers", "completion_inhibition").alias("c"))
    return rows.groupBy("topic").agg(F.countDistinct("day").alias("days_seen"), F.count("*").alias("evidence"), F.count_if("b").alias("blockers"), F.count_if("c").alias("completions"))


def agg8_folder_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders by states: sums of scores, pivoted."""
    p = _evidence(spark, sf_dir).groupBy("vault").pivot("state", list(L.KEYWORDS)).agg(F.round(F.sum("score"), 4))
    return p.select(F.col("vault").alias("folder"), *[F.coalesce(s, F.lit(0.0)).alias(s.lower()) for s in L.KEYWORDS])


def lif2_two_timescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voltages of each vault and state without resets: the window closed form."""
    rows = R.two_timescale(_sums(spark, sf_dir), ["vault"], _parameters(spark))
    return rows.select("vault", "state", "day", *[F.round(c, 6).alias(c) for c in ("v_fast", "v_slow", "v", "ratio")], (F.col("ratio") >= 1).alias("above"))


def lif4_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recurrence with threshold, cooldown and reset."""
    return R.spiking(_sums(spark, sf_dir), ["vault"], _parameters(spark)).select("vault", "state", "day", *[F.round(c, 6).alias(c) for c in ("v_fast", "v_slow", "v")], "fired")


def lif5_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All states of a vault together, at most two spikes a day."""
    return R.budgeted(_sums(spark, sf_dir), "vault", L.NEURONS, 2).select("vault", "state", "day", "v_fast", "v_slow", "v", "fired")


def lif5_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay with policies: each state's topic of the day meets its policy, which moves the threshold or mutes it; at most two spikes a day."""
    from .stream_queries import agg6_merged_policies

    daily = cut(_daily(spark, sf_dir), "daily")
    items = daily.select("vault", "day", "state", F.explode(F.slice("items", 1, 4)).alias("i"))
    text = F.concat_ws(" ", F.col("i.snippet"), F.array_join("i.words", " "))
    topics = E.inferred_topics(items.select("vault", "day", "state", text.alias("text"), F.col("i.score").alias("score")), ["vault", "day"]).select("vault", "day", "state", "topic")
    rows = daily.select("vault", "day", "state", "evidence", "completion").join(topics, ["vault", "day", "state"])
    merged = agg6_merged_policies(spark, sf_dir)
    # the hits' feedback adds up to far more than single reviews would: it is scaled to one review a topic
    policies = merged.select("topic", (F.col("threshold_delta") / F.col("feedback_count")).alias("threshold_delta"), "cooldown_days", "muted")
    run = R.budgeted(R.with_policies(rows, _parameters(spark), policies), "vault", L.NEURONS, 2)
    return run.select("vault", "state", "day", F.round("v", 6).alias("v"), F.round("threshold", 6).alias("threshold"), "fired")


def lif6_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, the second from the state that the first saved, with room for every state in the budget: the same rows as one run of the recurrence with resets."""
    daily = cut(_sums(spark, sf_dir).select("vault", "state", "day", "evidence", "completion"), "daily")
    middle, path = F.lit("2025-01-01").cast("date"), scratch_path(spark, "state")
    first = cut(R.budgeted(daily.where(F.col("day") < middle), "vault", L.NEURONS, len(L.NEURONS)), "run")
    save_state(R.final_states(first, "vault"), path)
    # a state without evidence on a later day still needs what was saved of it
    days = daily.where(F.col("day") >= middle).select("vault", "day").distinct().withColumn("state", F.explode(F.array(*map(F.lit, L.NEURONS))))
    grid = days.join(daily, ["vault", "day", "state"], "left").fillna(0.0, ["evidence", "completion"])
    later = R.budgeted(R.with_saved(grid, "vault", load_state(spark, path)), "vault", L.NEURONS, len(L.NEURONS))
    run = first.unionByName(later).join(daily.select("vault", "state", "day"), ["vault", "state", "day"])
    return run.select("vault", "state", "day", *[F.round(c, 6).alias(c) for c in ("v_fast", "v_slow", "v")], "fired")


def top3_latest_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spikes of each vault's last spiking day, by ratio."""
    fired = R.spiking(_sums(spark, sf_dir), ["vault"], _parameters(spark)).where("fired").join(F.broadcast(_parameters(spark).select("state", "theta")), "state")
    last = fired.groupBy("vault").agg(F.max("day").alias("day"))
    return fired.join(last, ["vault", "day"]).select("vault", "day", "state", F.round("v", 6).alias("v"), F.round(F.col("v") / F.col("theta"), 6).alias("ratio"))


# -- SQL twins

_STATES = ", ".join(f"('{s}', {sql_list(L.KEYWORDS[s])}, {sql_list(L.CONTEXT[s])}, " + ", ".join(f"{x}::double" for x in (n.theta, n.decay, n.reset_ratio, n.evidence_cap, n.slow_decay, n.slow_input, n.slow_completion)) + ")" for s, n in L.NEURONS.items())
EVIDENCE = f"""{NOTES},
states(state, kw, ctx, theta, decay, reset_ratio, cap, slow_decay, slow_input, slow_completion) as (values {_STATES}),
blocks as (select note_id, vault, day, (i - 1)::int as block_index, block, lower(block) as low from (select note_id, vault, day, unnest(x) as block, generate_subscripts(x, 1) as i
  from (select note_id, vault, day, {blocks_sql(_norm('target'))} as x from notes))),
cues as (select *, {sql_any('low', L.ACTION)}::int as a, {sql_any('low', L.TIME_PRESSURE)}::int as u, {sql_any('low', L.BLOCKER)}::int as b, ({sql_any('low', L.COMPLETION)} and not {sql_any('low', L.INCOMPLETE)})::int as c, {sql_any('low', L.NOVELTY)}::int as n,
  least(1.0::double, len(regexp_extract_all(block, '[0-9]+(?:\\.[0-9]+)?')) * 0.12::double + len(list_filter(regexp_split_to_array(block, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}'))) * 0.10::double
   + len(list_filter({sql_list(L.SYMBOLS)}, lambda s: contains(block, s))) * 0.12::double) as specificity from blocks),
hits as (select c.*, s.state, list_filter(s.kw, lambda w: contains(low, lower(w))) as k, list_filter(s.ctx, lambda w: contains(low, lower(w))) as x from cues c, states s),
weighed as (select *, least(1.0::double, 0.20::double + least(len(k), 5) * 0.20::double + least(len(x), 4) * 0.08::double) as w0, list_contains(k, '恢复') and {sql_any('low', L.SIGNAL_RECOVERY)} as rec from hits where len(k) > 0 or len(x) >= 2),
w2 as (select *, case when state = 'Health' and rec and not {sql_any('low', L.STRONG_HEALTH)} then w0 * 0.15::double when state = 'Experiment' and rec then least(1.0::double, w0 + 0.20::double) when state = 'Thesis' and k = ['导师'] then w0 * 0.45::double else w0 end as target_weight,
  case when state = 'Health' and rec and not {sql_any('low', L.STRONG_HEALTH)} then 'signal_recovery_not_health_recovery' when state = 'Experiment' and rec then 'signal_recovery_as_experiment_evidence' when state = 'Thesis' and k = ['导师'] then 'mentor_without_thesis_context' end as why from weighed),
w3 as (select *, least(1.0::double, 0.42::double + len(k) * 0.10::double + len(x) * 0.04::double + specificity * 0.18::double) as confidence from w2 where target_weight >= 0.18),
evidence as (select *, (0.35::double + 2.45::double * target_weight) * (0.72::double + 0.22::double * a + 0.18::double * u + 0.30::double * b + 0.16::double * specificity + 0.18::double * n) * confidence as score, c * 0.85::double as inhibition,
  list_slice(list_concat(k, list_filter(x, lambda y: not list_contains(k, y))), 1, 8) as words,
  list_filter(['vector_scored', case when a > 0 then 'action' end, case when b > 0 then 'blocker' end, case when u > 0 then 'time_pressure' end, case when specificity >= 0.25 then 'specific' end, case when n > 0 then 'novelty' end, why,
   case when c > 0 then 'completion_inhibition' end], lambda m: m is not null) as modifiers from w3 where (0.35::double + 2.45::double * target_weight) * (0.72::double + 0.22::double * a + 0.18::double * u + 0.30::double * b + 0.16::double * specificity + 0.18::double * n) * confidence >= 0.18)"""
DAILY = EVIDENCE + """,
sums as (select e.vault, e.day, e.state, least(sum(score), any_value(cap)) as evidence, least(sum(inhibition), 2.2::double) as completion, count(*)::bigint as blocks from evidence e join states s using (state) group by 1, 2, 3)"""
_RANKED = DAILY + f""",
ranked as (select *, row_number() over (partition by vault, day, state order by score desc, note_id, block_index) as rank, {snippet_sql('block')} as snippet from evidence)"""
_TOPICS = "topics(pos, topic, ws) as (values " + ", ".join(f"({i}, '{t}', {sql_list(ws)})" for i, (t, ws) in enumerate(L.TOPICS.items())) + ")"
_PRIORS = "priors(state, topic, prior) as (values " + ", ".join(f"('{s}', '{t}', {p}::double)" for s, m in L.TOPIC_PRIORS.items() for t, p in m.items()) + ")"
_FALLBACK = "fallback(state, topic) as (values " + ", ".join(f"('{s}', '{t}')" for s, t in L.FALLBACK_TOPIC.items()) + ")"
_TEXT = "lower(snippet || ' ' || array_to_string(words, ' '))"
_FACTOR = f"""(case when topic = '实验数据模板' and {sql_any('t', ['实验', '跑数据', '记录数据', '数据模板', '数据闭环'])} then 1.8::double when topic = '求职' and not {sql_any('t', L.TOPICS['求职'])} then 0.1::double
 when topic = 'AI求职转向' and {sql_any('t', ['简历', '实习', '岗位', '大模型', 'all in AI'])} then 1.6::double else 1.0::double end)"""
_STEP = """, o as (select *, row_number() over (partition by vault, state order by day) as r, greatest(coalesce(date_diff('day', lag(day) over (partition by vault, state order by day), day), 1), 1) as gap from sums join states using (state)), """
_FOLD = "with recursive " + DAILY + _STEP + """w as (
 select vault, state, day, r, greatest(0, evidence - completion) as f, greatest(0, evidence * slow_input - completion * slow_completion) as s, <1> from o where r = 1
 union all select vault, state, day, r, f, s, <2> from (select o.vault, o.state, o.day, o.r, o.theta, o.reset_ratio, w.fired_on, greatest(0, pow(o.decay, o.gap) * <3> + o.evidence - o.completion) as f, greatest(0, pow(o.slow_decay, o.gap) * <4> + o.evidence * o.slow_input - o.completion * o.slow_completion) as s
  from w join o on o.vault = w.vault and o.state = w.state and o.r = w.r + 1 join states p on p.state = w.state))"""


def _fold(*parts: str) -> str:
    sql = _FOLD
    for i, p in enumerate(parts, 1):
        sql = sql.replace(f"<{i}>", p)
    return sql


_FREE = _fold("null::date as fired_on", "null::date", "w.f", "w.s")
_HIT = "(0.7::double * f + 0.3::double * s) / (0.7::double + 0.3::double)"
_RESET = _fold(
    f"case when (0.7::double * greatest(0, evidence - completion) + 0.3::double * greatest(0, evidence * slow_input - completion * slow_completion)) / (0.7::double + 0.3::double) >= theta then day end as fired_on",
    f"case when {_HIT} >= theta then day else fired_on end",
    "(case when w.fired_on = w.day then p.theta * p.reset_ratio else w.f end)",
    "(case when w.fired_on = w.day then least(w.s, p.theta * 0.60::double) else w.s end)",
)
_SPIKES = f"select vault, w.state, day, f as v_fast, s as v_slow, {_HIT} as v, coalesce(fired_on = day, false) as fired, theta from w join states using (state)"

QUERIES = {
    "sco_block_scores": sco_block_scores, "agg1_daily_evidence": agg1_daily_evidence, "agg4_topics": agg4_topics, "agg5_topic_history": agg5_topic_history, "agg8_folder_states": agg8_folder_states,
    "lif2_two_timescale": lif2_two_timescale, "lif4_spikes": lif4_spikes, "lif5_budget": lif5_budget, "lif5_replay": lif5_replay, "lif6_resumed": lif6_resumed, "top3_latest_spikes": top3_latest_spikes,
}
ORACLE = {
    "sco_block_scores": "with " + EVIDENCE + " select note_id, block_index, state, array_to_string(words, '|') as words, round(target_weight, 6) as target_weight, round(specificity, 6) as specificity, round(confidence, 6) as confidence, round(score, 6) as score, inhibition, array_to_string(modifiers, '|') as modifiers from evidence",
    "agg1_daily_evidence": "with " + _RANKED + " select vault, day, state, round(evidence, 6) as evidence, round(completion, 6) as completion, blocks, s as snippets from sums join (select vault, day, state, string_agg(snippet, '|' order by rank) as s from ranked where rank <= 6 group by 1, 2, 3) using (vault, day, state)",
    "agg4_topics": "with " + _RANKED + f""", {_TOPICS}, {_PRIORS}, {_FALLBACK},
i as (select vault, day, state, round(score, 6) as score, {_TEXT} as t from ranked where rank <= 4),
m as (select i.vault, i.day, i.state, pos, topic, sum(score * (1.0::double + least(len(list_filter(ws, lambda w: contains(t, lower(w)))), 4) * 0.25::double) * {_FACTOR} * coalesce(prior, 1.0::double)) as score
  from i join topics on len(list_filter(ws, lambda w: contains(t, lower(w)))) > 0 left join priors using (state, topic) group by 1, 2, 3, 4, 5),
b as (select vault, day, state, first(topic order by round(score, 9) desc, pos) as topic, max(score) as score from m group by 1, 2, 3)
select g.vault, g.day, g.state, coalesce(b.topic, f.topic) as topic, round(b.score, 6) as score from (select distinct vault, day, state from i) g left join b using (vault, day, state) join fallback f on f.state = g.state""",
    "agg5_topic_history": "with " + _RANKED + f""", {_TOPICS}, i as (select day, modifiers, {_TEXT} as t from ranked where rank <= 6)
select topic, count(distinct day)::bigint as days_seen, count(*)::bigint as evidence, count_if(list_contains(modifiers, 'blocker'))::bigint as blockers, count_if(list_contains(modifiers, 'completion_inhibition'))::bigint as completions
from i join topics on len(list_filter(ws, lambda w: contains(t, lower(w)))) > 0 group by 1""",
    "agg8_folder_states": "with " + EVIDENCE + " select vault as folder, " + ", ".join(f"coalesce(round(sum(score) filter (state = '{s}'), 4), 0) as {s.lower()}" for s in L.KEYWORDS) + " from evidence group by 1",
    "lif2_two_timescale": _FREE + f" select vault, state, day, round(f, 6) as v_fast, round(s, 6) as v_slow, round({_HIT}, 6) as v, round({_HIT} / theta, 6) as ratio, {_HIT} / theta >= 1 as above from w join states using (state)",
    "lif4_spikes": _RESET + f" select vault, state, day, round(v_fast, 6) as v_fast, round(v_slow, 6) as v_slow, round(v, 6) as v, fired from ({_SPIKES})",
    "top3_latest_spikes": _RESET + f", f as (select * from ({_SPIKES}) where fired) select vault, day, state, round(v, 6) as v, round(v / theta, 6) as ratio from f where day = (select max(g.day) from f g where g.vault = f.vault)",
}
ORACLE["lif6_resumed"] = ORACLE["lif4_spikes"]
day_as_text(QUERIES, ORACLE, ["lif5_replay", "lif6_resumed", "agg1_daily_evidence", "agg4_topics", "lif2_two_timescale", "lif4_spikes", "lif5_budget", "top3_latest_spikes"])
