"""Queries over relations, topic graphs, memory fields and candidates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keys import term_keys
from ..operators import evidence as E
from ..operators import memory as M
from ..operators import relations as R
from ..operators import vectors as V
from ..operators.recurrence import leaky_fold
from ..tables import once, spread, table
from .common import NOTES, arrivals, notes, sql_any, sql_list
from .orphan_queries import term_key_sql
from .text_queries import _norm, blocks_sql

RULES = [
    ("evidence_gap", ["论文闭环", "LIF链路"], ["claim", "evidence"], ["metric", "conflict"]),
    ("load_and_work", ["健康恢复", "论文闭环"], ["failure"], ["decision", "action"]),
    ("memory_to_career", ["AI记忆", "求职"], ["claim"], ["metric", "method"]),
    ("gain_and_chain", ["负阻", "LIF链路"], ["metric", "conflict"], ["failure", "decision"]),
]


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "evidence_hits"), "hit_id").select("hit_id", "day", "path", "block_index", "snippet", F.coalesce("score", F.lit(0.0)).alias("score"), "topics", "roles", F.split("path", "/")[0].alias("view"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(table(spark, sf_dir, "fragments"), "fragment_id")
    return rows.select("fragment_id", "day", F.explode(term_keys("terms")).alias("term"))


def agg10_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.concept_scores(_terms(spark, sf_dir)).select("term", "count", "days", F.round("score", 5).alias("score"))


def lif15_selected_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concepts taken greedily, and how many fragments hold each."""
    scored = R.concept_scores(_terms(spark, sf_dir))
    return scored.where(F.col("term").isin(R.selected_concepts(scored))).select("term", "count")


def agg11_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of terms that share at least two fragments, with their score; a fragment's pairs come row by row from two explodes."""
    f = once(table(spark, sf_dir, "fragments"), "fragment_id").select("fragment_id", "day", term_keys("terms").alias("terms"))
    counts = f.select(F.explode("terms").alias("term")).groupBy("term").count()
    pairs = f.select("day", "terms", F.posexplode("terms").alias("at", "source")).select("day", "source", F.explode(F.expr("slice(terms, at + 2, size(terms))")).alias("target"))
    # counting by day first keeps the distinct count a sum, combined map-side
    byday = pairs.groupBy("source", "target", "day").count()
    p = byday.groupBy("source", "target").agg(F.sum("count").alias("count"), F.count("day").alias("distinct_days")).where("count >= 2")
    p = p.join(counts.select(F.col("term").alias("source"), F.col("count").alias("n_a")), "source").join(counts.select(F.col("term").alias("target"), F.col("count").alias("n_b")), "target")
    return R.relation_scores(p).select("source", "target", "count", "distinct_days", F.round("score", 5).alias("score"))


def joi11_topic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.topic_edges(_hits(spark, sf_dir)).withColumn("weight", F.round("weight", 4))


def agg13_topic_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.topic_nodes(_hits(spark, sf_dir), ["view"]).select("view", "topic", F.round("voltage", 4).alias("voltage"), "evidence", "dominant_role", F.round("threshold", 4).alias("threshold"), "spike")


def agg15_merged_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view's twelve strongest nodes (the view's size), merged over all views."""
    w = Window.partitionBy("view").orderBy(F.round("voltage", 6).desc(), "topic")
    top = R.topic_nodes(_hits(spark, sf_dir), ["view"]).withColumn("rn", F.row_number().over(w)).where("rn <= 12")
    return top.groupBy("topic").agg(F.round(F.sum("voltage"), 4).alias("voltage"), F.sum("evidence").alias("evidence"), F.round(F.min("threshold"), 4).alias("threshold"), F.bool_or("spike").alias("spike"))


def top7_view_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 best hits of each view (the view's steps)."""
    w = Window.partitionBy("view").orderBy(F.col("score").desc(), "hit_id")
    return _hits(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 24").select("view", "rank", "hit_id", "score")


def sco11_view_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each hit's snippet for a view that prefers two topics."""
    seeds, risks, preferred = ["论文", "证据", "图", "主线", "章节"], ["卡", "缺", "失败", "不稳"], ["论文闭环", "LIF链路"]
    low, none = F.lower("snippet"), F.array().cast("array<string>")
    roles = F.coalesce("roles", none)
    bonus = sum((F.when(F.array_contains(roles, r), b).otherwise(0.0) for r, b in (("blocker", 0.45), ("action", 0.30), ("evidence", 0.25), ("question", 0.18), ("completion", -0.12))), F.lit(0.0))
    liked = F.size(F.filter(F.coalesce("topics", none), lambda t: t.isin(preferred)))
    score = 0.22 * F.size(T.matched(low, seeds)) + 0.34 * liked + 0.18 * F.size(T.matched(low, risks)) + bonus + 0.50 * T.specificity(F.col("snippet"), 0.08, 0.08, 0.12)
    score = score * (1 + F.least(F.lit(0.45), F.log1p(F.length("snippet")) / 20))
    return _hits(spark, sf_dir).where("snippet is not null").select("hit_id", F.round(score, 6).alias("score"))


def agg12_rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "name string, topics array<string>, required array<string>, boost array<string>")
    return R.rule_scores(_hits(spark, sf_dir), rules).select("name", F.round("coverage", 4).alias("coverage"), "bridges", F.round("score", 4).alias("score"))


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that came twice are taken once among the observations."""
    blocks = E.note_blocks(spread(arrivals(spark, sf_dir).select("note_id", "vault", "day", "text")), 6)
    return M.observations(blocks).drop("block").dropDuplicates(["note_id", "block_index"])


def ext1_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observations(spark, sf_dir).select("note_id", "block_index", F.array_join("dimensions", "|").alias("dimensions"), "intensity", "completion")


def lif9_latent_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vault's dimensions after the last observation, their pressure and the gap to full confidence."""
    cells = M.latent_cells(_observations(spark, sf_dir), ["vault"], ["note_id", "block_index"])
    last = cells.groupBy("vault", "dimension").agg(F.max_by(F.struct("v_fast", "v_slow", "v"), F.struct("day", "note_id", "block_index")).alias("s"), F.count("*").alias("observations"))
    theta = F.create_map(*[x for d, (_, _, t, _, _) in M.DIMENSIONS.items() for x in (F.lit(d), F.lit(t))])
    return last.select("vault", "dimension", "observations", *[F.round(f"s.{c}", 5).alias(c) for c in ("v_fast", "v_slow", "v")], F.round(F.col("s.v") / theta[F.col("dimension")], 5).alias("pressure"))


def _slot_rows(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each block of each vault's notes with the slot that it enters."""
    blocks = E.note_blocks(notes(spark, sf_dir).select("note_id", "vault", "day", "path", "text"), 6)
    return M.slots(M.slot_observations(blocks, V.DIMENSIONS), "vault", order=("path", "snippet", "note_id", "block_index"), carry=carry)


def lif13_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots that form over the blocks of each vault's notes, by their hashed vectors: rows and notes, mean loss and similarity, the running loss, and the traces on the vault's last day."""
    last = F.max(F.struct("day", "path", "snippet", "note_id", "block_index", "v_fast", "v_slow", "loss_mean")).alias("s")
    found = _slot_rows(spark, sf_dir).groupBy("vault", "slot").agg(F.count("*").alias("observations"), F.countDistinct("note_id").alias("notes"), F.avg("loss").alias("loss"), F.avg("similarity").alias("similarity"), last)
    gap = F.coalesce(F.datediff(F.max("s.day").over(Window.partitionBy("vault")), "s.day"), F.lit(0))
    rows = found.withColumn("v_fast", F.col("s.v_fast") * F.pow(F.lit(0.84), gap)).withColumn("v_slow", F.col("s.v_slow") * F.pow(F.lit(0.94), gap))
    return rows.select("vault", "slot", "observations", "notes", "loss", "similarity", F.col("s.loss_mean").alias("loss_mean"), "v_fast", "v_slow", (0.72 * F.col("v_fast") + 0.28 * F.col("v_slow")).alias("v"))


def agg27_slot_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each slot's blocks hold each term."""
    return _slot_rows(spark, sf_dir, ("terms",)).select("vault", "slot", F.explode("terms").alias("term")).groupBy("vault", "slot", "term").agg(F.count("*").alias("count"))


def top10_high_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight blocks of each vault with the greatest loss, the first in order on a tie."""
    w = Window.partitionBy("vault").orderBy(F.col("loss").desc(), "day", "path", "snippet", "note_id", "block_index")
    return _slot_rows(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 8").select("vault", "rank", "note_id", "block_index", "slot", "loss")


def agg18_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each topic and role occurs, ranked within its kind."""
    h = _hits(spark, sf_dir)
    rows = h.select(F.lit("topic").alias("kind"), F.explode("topics").alias("value")).unionAll(h.select(F.lit("role").alias("kind"), F.explode("roles").alias("value"))).where("value is not null")
    c = rows.groupBy("kind", "value").agg(F.count("*").alias("uses"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("uses").desc(), "value")))


def lif12_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six leaky units for each user, driven by the user's events in order of days: v * leak + current, no floor, back to 0 on firing.

    current: the day's mean value of the unit's event type, over 100.
    """
    e = table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    daily = e.groupBy("user_id", F.col("event_type").alias("unit"), F.to_date("ts").alias("day")).agg((F.avg("value") / 100).alias("current"))
    start = F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("v"), F.lit(False).alias("fired"))
    step = lambda s, r: F.transform(F.array(s["left"] * 0.82 + r["current"]), lambda v: F.struct(F.when(v >= 0.72, 0.0).otherwise(v).alias("left"), v.alias("v"), (v >= 0.72).alias("fired")))[0]
    out = leaky_fold(daily, ["user_id", "unit"], start, step)
    return out.groupBy("user_id", "unit").agg(F.count("*").alias("days"), F.count_if("fired").alias("fired"), F.round(F.max("v"), 6).alias("greatest"))


def sco12_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each fragment's terms occur once in the whole collection, and how many terms it has. sco12_signals has the score."""
    t = once(table(spark, sf_dir, "fragments"), "fragment_id").select("fragment_id", F.explode(F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda x: x.isNotNull())).alias("term"))
    single = t.groupBy("term").count().where("count = 1").select("term", F.lit(1).alias("rare"))
    return t.join(single, "term", "left").groupBy("fragment_id").agg(F.count("*").alias("terms"), F.count("rare").alias("rare"))


def sco12_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six signals of each fragment's text: word counts with a length factor, novelty from tokens that occur once in the whole collection, fatigue rules. One row for every
    fragment; the table has no metadata columns for the bonus on value."""
    f = once(table(spark, sf_dir, "fragments").select("fragment_id", "text"), "fragment_id").withColumn("text", F.coalesce("text", F.lit("")))
    tokens = F.transform(F.regexp_extract_all("text", F.lit(r"([A-Za-z][A-Za-z0-9_\-]{2,}|[\x{4e00}-\x{9fff}]{2,})"), 1), lambda t: F.lower(t))
    # a token that occurs once has one fragment, so its count needs no join back
    single = f.select("fragment_id", F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.min("fragment_id").alias("owner")).where("n = 1")
    rare = single.groupBy("owner").agg(F.count("*").alias("rare"))
    low, unit = F.lower("text"), lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    factor = F.greatest(F.lit(0.15), F.least(F.lit(1.0), F.log1p(F.length("text")) / math.log(500)))
    times = lambda w: (F.length(low) - F.length(F.replace(low, F.lit(w.lower()), F.lit("")))) / len(w)
    rows = f.select("fragment_id", F.size(F.array_distinct(tokens)).alias("tokens"), *[unit(sum((times(w) for w in words), F.lit(0.0)) / 6.0 + 0.06 * factor).alias(name) for name, words in M.SIGNALS.items()])
    rows = rows.join(rare, F.col("fragment_id").eqNullSafe(F.col("owner")), "left").na.fill(0, ["rare"])
    rows = rows.withColumn("novelty", unit(F.col("novelty") + F.least("rare", F.lit(12)) / 30.0)).withColumn("fatigue", F.when(F.col("tokens") < 8, unit(F.col("fatigue") + 0.25)).otherwise(F.col("fatigue")))
    rows = rows.withColumn("fatigue", F.when((F.col("urgency") > 0.35) | (F.col("risk") > 0.35), F.greatest(F.lit(0.0), F.col("fatigue") - 0.15)).otherwise(F.col("fatigue")))
    return rows.select("fragment_id", *[F.round(F.col(name) + 1e-9, 4).alias(name) for name in M.SIGNALS])


def sco20_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each candidate's text fields of at least four characters, and its rank within its day."""
    rows = once(table(spark, sf_dir, "relation_candidates"), "candidate_id")
    filled = sum((F.when(F.length(F.coalesce(c, F.lit(""))) >= 4, 1.0).otherwise(0.0) for c in ("source", "target", "hypothesis", "next_validation_action")), F.lit(0.0)) / 4
    rows = rows.select("candidate_id", "run_day", filled.alias("quality"), "score")
    w = Window.partitionBy("run_day").orderBy(F.col("quality").desc(), F.col("score").desc_nulls_last(), "candidate_id")
    return rows.select("candidate_id", "quality", F.row_number().over(w).alias("rank"))


_HITS = "hits as (select hit_id, any_value(day) as day, any_value(path) as path, any_value(snippet) as snippet, coalesce(any_value(score), 0) as score, any_value(topics) as topics, any_value(roles) as roles, string_split(any_value(path), '/')[1] as view from evidence_hits group by 1)"
_FRAG = f"fr as (select fragment_id, any_value(day) as day, any_value(terms) as terms from fragments group by 1), tk as (select distinct fragment_id, day, term from (select fragment_id, day, {term_key_sql('t')} as term from (select fragment_id, day, unnest(terms) as t from fr)) where term is not null)"
_NODES = f"""{_HITS}, ea as (select view, unnest(topics) as topic, roles, score from hits), su as (select view, topic, sum(score) as voltage, count(*)::bigint as evidence from ea group by 1, 2),
ro as (select view, topic, first(role order by n desc, role) as role from (select view, topic, role, count(*) as n from (select view, topic, unnest(roles) as role from ea) group by 1, 2, 3) group by 1, 2),
nd as (select view, topic, voltage, evidence, coalesce(role, 'evidence') as dominant_role, 3.0::double * case when coalesce(role, 'evidence') = 'blocker' then 0.88::double else 1 end as threshold from su left join ro using (view, topic))"""
_HAS = lambda r: f"list_contains(coalesce(roles, []), '{r}')"
_WORDS = "list_distinct(list_concat(" * (len(M.DIMENSIONS) - 1) + f"list_filter({sql_list(list(M.DIMENSIONS.values())[0][3])}, lambda w: contains(low, lower(w)))" + "".join(f", list_filter({sql_list(v[3])}, lambda w: contains(low, lower(w)))))" for v in list(M.DIMENSIONS.values())[1:])
_OBS = f"""{NOTES}, bl as (select note_id, vault, day, (i - 1)::int as block_index, b as block, lower(b) as low from (select note_id, vault, day, unnest(x) as b, generate_subscripts(x, 1) as i from (select note_id, vault, day, {blocks_sql(_norm('target'), 6)} as x from notes))),
ob as (select *, list_filter([{', '.join(f"case when {sql_any('low', v[3])} then '{d}' end" for d, v in M.DIMENSIONS.items())}], lambda x: x is not null) as dims,
 case when {' or '.join(f"({sql_any('low', v[3])} and {sql_any('low', v[4])})" for v in M.DIMENSIONS.values())} then 0.75::double else 0 end as completion,
 round(least(2.5::double, least(2.2::double, 0.55::double + 0.28::double * len({_WORDS}) + 0.45::double * least(1.0::double, len(regexp_extract_all(block, '[0-9]+(?:\\.[0-9]+)?')) * 0.10::double + len(list_filter(regexp_split_to_array(block, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}'))) * 0.08::double
  + len(list_filter({sql_list(M.SYMBOLS)}, lambda s: contains(block, s))) * 0.12::double)) + case when {sql_any('low', M.CUES)} then 0.35::double else 0 end), 4) as intensity from bl),
obs as (select * from ob where len(dims) > 0)"""
_CELLS = f"""with recursive {_OBS}, dm(dimension, fast, slow, theta) as (values {', '.join(f"('{d}', {v[0]}::double, {v[1]}::double, {v[2]}::double)" for d, v in M.DIMENSIONS.items())}),
ev as (select vault, dimension, day, note_id, block_index, intensity, completion, row_number() over (partition by vault, dimension order by day, note_id, block_index) as r, coalesce(date_diff('day', lag(day) over (partition by vault, dimension order by day, note_id, block_index), day), 0) as gap from (select *, unnest(dims) as dimension from obs)),
w as (select vault, dimension, r, greatest(0, intensity - completion * 0.65::double) as f, greatest(0, intensity * 0.45::double - completion * 0.65::double * 0.25::double) as s from ev where r = 1
 union all select e.vault, e.dimension, e.r, greatest(0, w.f * pow(dm.fast, e.gap) + e.intensity - e.completion * 0.65::double), greatest(0, w.s * pow(dm.slow, e.gap) + e.intensity * 0.45::double - e.completion * 0.65::double * 0.25::double)
 from w join ev e on e.vault = w.vault and e.dimension = w.dimension and e.r = w.r + 1 join dm on dm.dimension = w.dimension)
select w.vault, w.dimension, w.r as observations, round(f, 5) as v_fast, round(s, 5) as v_slow, round(0.72::double * f + 0.28::double * s, 5) as v, round((0.72::double * f + 0.28::double * s) / theta, 5) as pressure from w join dm using (dimension) qualify row_number() over (partition by w.vault, w.dimension order by w.r desc) = 1"""

QUERIES = {
    "agg10_concepts": agg10_concepts, "lif15_selected_concepts": lif15_selected_concepts, "agg11_relations": agg11_relations, "joi11_topic_edges": joi11_topic_edges, "agg13_topic_nodes": agg13_topic_nodes, "agg15_merged_views": agg15_merged_views,
    "top7_view_evidence": top7_view_evidence, "sco11_view_scores": sco11_view_scores, "agg12_rule_scores": agg12_rule_scores, "ext1_observations": ext1_observations, "lif9_latent_cells": lif9_latent_cells, "lif13_slots": lif13_slots, "agg27_slot_terms": agg27_slot_terms, "top10_high_loss": top10_high_loss,
    "agg18_dominant": agg18_dominant, "lif12_controller": lif12_controller, "sco12_salience": sco12_salience, "sco12_signals": sco12_signals, "sco20_quality": sco20_quality,
}
ORACLE = {
    "agg10_concepts": f"with {_FRAG} select term, count(*)::bigint as count, count(distinct day)::bigint as days, round(count(*) * (1 + ln(1 + count(distinct day))) * (0.7::double + least(length(term), 8) / 8.0::double), 5) as score from tk group by term having count(*) >= 3",
    "agg11_relations": f"""with {_FRAG}, n as (select term, count(*) as n from tk group by 1), p as (select a.term as source, b.term as target, count(*)::bigint as count, count(distinct a.day)::bigint as distinct_days from tk a join tk b on a.fragment_id = b.fragment_id and a.term < b.term group by 1, 2 having count(*) >= 2)
select source, target, count, distinct_days, round(count * (1 + ln(1 + distinct_days)) * (1 + 10 / sqrt(x.n::double * y.n)), 5) as score from p join n x on x.term = source join n y on y.term = target""",
    "joi11_topic_edges": f"""with {_HITS}, r as (select path, score, topics, case when {_HAS('blocker')} then 'blocks' when {_HAS('action')} then 'suggests_action_for' when {_HAS('question')} then 'questions' when {_HAS('completion')} then 'partly_closes' else 'supports' end as relation from hits where len(topics) >= 2),
p as (select path, score, relation, topics, unnest(topics) as source, generate_subscripts(topics, 1) as i from r), q as (select path, score, relation, source, unnest(list_slice(topics, i + 1, len(topics))) as target from p)
select source, target, relation, round(sum(greatest(score, 0.2::double)), 4) as weight, count(distinct path)::bigint as paths from q group by 1, 2, 3""",
    "agg13_topic_nodes": f"with {_NODES} select view, topic, round(voltage, 4) as voltage, evidence, dominant_role, round(threshold, 4) as threshold, voltage >= threshold as spike from nd",
    "agg15_merged_views": f"with {_NODES}, t as (select * from nd qualify row_number() over (partition by view order by round(voltage, 6) desc, topic) <= 12) select topic, round(sum(voltage), 4) as voltage, sum(evidence)::bigint as evidence, round(min(threshold), 4) as threshold, bool_or(voltage >= threshold) as spike from t group by 1",
    "top7_view_evidence": f"with {_HITS} select view, row_number() over (partition by view order by score desc, hit_id)::int as rank, hit_id, score from hits qualify row_number() over (partition by view order by score desc, hit_id) <= 24",
    "sco11_view_scores": f"""with {_HITS} select hit_id, round((0.22::double * len(list_filter({sql_list(['论文', '证据', '图', '主线', '章节'])}, lambda w: contains(lower(snippet), lower(w)))) + 0.34::double * len(list_filter(coalesce(topics, []), lambda t: t in ('论文闭环', 'LIF链路')))
 + 0.18::double * len(list_filter({sql_list(['卡', '缺', '失败', '不稳'])}, lambda w: contains(lower(snippet), lower(w)))) + case when {_HAS('blocker')} then 0.45::double else 0 end + case when {_HAS('action')} then 0.30::double else 0 end + case when {_HAS('evidence')} then 0.25::double else 0 end
 + case when {_HAS('question')} then 0.18::double else 0 end - case when {_HAS('completion')} then 0.12::double else 0 end + 0.5::double * least(1.0::double, len(regexp_extract_all(snippet, '[0-9]+(?:\\.[0-9]+)?')) * 0.08::double
 + len(list_filter(regexp_split_to_array(snippet, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}'))) * 0.08::double + len(list_filter({sql_list(["->", "→", "|", "/", "%", "mV", "Hz"])}, lambda s: contains(snippet, s))) * 0.12::double))
 * (1 + least(0.45::double, ln(1 + length(snippet)) / 20)), 6) as score from hits where snippet is not null""",
    "agg12_rule_scores": f"""with {_HITS}, rules(name, topics, required, boost) as (values {', '.join(f"('{n}', {sql_list(t)}, {sql_list(q)}, {sql_list(b)})" for n, t, q, b in RULES)}),
m as (select r.name, r.topics as rt, required, boost, h.hit_id, coalesce(h.roles, []) as roles, list_intersect(list_distinct(coalesce(h.topics, [])), r.topics) as ov from hits h, rules r where len(list_intersect(coalesce(h.topics, []), r.topics)) > 0),
a as (select name, any_value(len(rt)) as nt, any_value(required) as rq, any_value(boost) as bo, count_if(len(ov) >= 2)::bigint as bridges, list_distinct(flatten(list(ov))) as cv, list_distinct(flatten(list(roles))) as ro from m group by name)
select name, round(len(cv)::double / nt, 4) as coverage, bridges, round(len(cv)::double / nt * 4 + least(bridges, 4) * 0.65::double + len(list_intersect(rq, ro)) * 0.85::double + len(list_intersect(bo, ro)) * 0.35::double
 + case when list_contains(ro, 'conflict') and list_contains(ro, 'decision') then 0.65::double else 0 end + case when list_contains(ro, 'failure') and list_contains(ro, 'claim') then 0.55::double else 0 end + case when list_contains(ro, 'metric') and list_contains(ro, 'claim') then 0.45::double else 0 end, 4) as score from a""",
    "ext1_observations": f"with {_OBS} select note_id, block_index, array_to_string(dims, '|') as dimensions, intensity, completion from obs",
    "lif9_latent_cells": _CELLS,
    "agg18_dominant": f"with {_HITS}, v as (select 'topic' as kind, unnest(topics) as value from hits union all select 'role', unnest(roles) from hits) select kind, value, count(*)::bigint as uses, row_number() over (partition by kind order by count(*) desc, value)::int as rank from v where value is not null group by 1, 2",
    "lif12_controller": """with recursive d as (select user_id, event_type as unit, ts::date as day, avg(value) / 100 as x, row_number() over (partition by user_id, event_type order by ts::date) as r from events where user_id is not null and ts is not null group by 1, 2, 3),
w as (select user_id, unit, r, x as v from d where r = 1 union all select d.user_id, d.unit, d.r, case when w.v >= 0.72 then 0 else w.v end * 0.82::double + d.x from w join d on d.user_id = w.user_id and d.unit = w.unit and d.r = w.r + 1)
select user_id, unit, count(*)::bigint as days, count_if(v >= 0.72)::bigint as fired, round(max(v), 6) as greatest from w group by 1, 2""",
    "sco12_salience": """with fr as (select fragment_id, any_value(terms) as terms from fragments group by 1), t as (select fragment_id, term from (select fragment_id, unnest(terms) as term from fr) where term is not null), c as (select term from t group by 1 having count(*) = 1)
select fragment_id, count(*)::bigint as terms, count(c.term)::bigint as rare from t left join c using (term) group by 1""",
    "sco20_quality": "with r as (select candidate_id, any_value(run_day) as run_day, any_value(score) as score, (" + " + ".join(f"case when length(coalesce(any_value({c}), '')) >= 4 then 1.0::double else 0 end" for c in ("source", "target", "hypothesis", "next_validation_action")) + ") / 4 as quality from relation_candidates group by 1) select candidate_id, quality, row_number() over (partition by run_day order by quality desc, score desc nulls last, candidate_id)::int as rank from r",
}
