"""Queries over latent questions, inspiration, and what is joined to a day's evidence."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T
from ..operators import evidence as E
from ..operators import insight as I
from ..operators import memory as M
from ..sources.vault import file_signals
from ..tables import spread, table
from .common import NOTES, arrivals, day_as_text, notes, sql_any, sql_list
from .evidence_queries import DAILY, _sums
from .stream_queries import ORACLE as STREAM_ORACLE
from .stream_queries import PROJECTS
from .text_queries import _norm, blocks_sql


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.note_blocks(spread(arrivals(spark, sf_dir).select("note_id", "vault", "day", "text")))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that bear on the question; notes that came twice are taken once among them."""
    return I.question_fragments(_blocks(spark, sf_dir)).dropDuplicates(["note_id", "block_index"])


def _inspiration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.inspiration_fragments(_blocks(spark, sf_dir)).dropDuplicates(["note_id", "block_index"])


def mat3_question_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that bear on a latent question, ASCII words at their boundaries only."""
    return _questions(spark, sf_dir).select("note_id", "block_index", F.array_join("hits", "|").alias("hits"), F.round("score", 6).alias("score"), "role", "inhibition")


def agg2_question_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _questions(spark, sf_dir)
    return f.groupBy("vault", "day").agg(F.round(F.least(F.sum("score"), F.lit(I.QUESTION["cap"])), 6).alias("evidence"), F.least(F.sum("inhibition"), F.lit(2.5)).alias("inhibition"), F.count("*").alias("fragments"))


def mat4_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each note holds each of the blocker words."""
    n = notes(spark, sf_dir).select("note_id", F.lower("text").alias("low"))
    words = F.explode(F.expr("array(" + ", ".join(T.quoted(w) for w in L.BLOCKER) + ")"))
    rows = n.select("note_id", "low", words.alias("word"))
    count = ((F.length("low") - F.length(F.replace("low", "word", F.lit("")))) / F.length("word")).cast("int")
    return rows.select("note_id", "word", count.alias("uses")).where("uses > 0")


def sco7_inspiration_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _inspiration(spark, sf_dir)
    return rows.select("note_id", "block_index", F.array_join("roles", "|").alias("roles"), F.array_join("domains", "|").alias("domains"), F.round("score", 6).alias("score"))


def agg3_daily_inspiration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.daily_inspiration(_inspiration(spark, sf_dir), ["vault", "day"])
    return d.select("vault", "day", *[F.round(c, 6).alias(c) for c in ("input", "tension", "bridge", "spark", "validation")], "fragments")


def lif8_inspiration_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four traces and the material that they need to fire."""
    f = _inspiration(spark, sf_dir)
    w = Window.partitionBy("vault", "day").orderBy(F.col("score").desc(), "note_id", "block_index")
    top = f.withColumn("rn", F.row_number().over(w)).where("rn <= 10").groupBy("vault", "day").agg(F.sort_array(F.collect_list(F.struct("rn", "score", T.snippet(F.col("block"), 120).alias("snippet"), "roles", "domains"))).alias("top"))
    return I.inspiration_spikes(I.daily_inspiration(f, ["vault", "day"]).join(top, ["vault", "day"]), "vault")


def lif7_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each vault that gathers the question's eight best fragments of a day until it fires."""
    f = _questions(spark, sf_dir)
    w = Window.partitionBy("vault", "day").orderBy(F.col("score").desc(), "note_id", "block_index")
    top = f.withColumn("rn", F.row_number().over(w)).where("rn <= 8").groupBy("vault", "day").agg(F.sort_array(F.collect_list(F.struct("rn", "score", T.snippet(F.col("block"), 110).alias("snippet"), "role"))).alias("fragments"))
    sums = f.groupBy("vault", "day").agg(F.least(F.sum("score"), F.lit(I.QUESTION["cap"])).alias("input"), F.least(F.sum("inhibition"), F.lit(2.5)).alias("completion"))
    return M.kept_fragments(sums.join(top, ["vault", "day"]), "vault", 7.5, 0.86, 0.35)


def joi8_completed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily evidence with the completion that files of the day add (0.7 a file, 1.4 at most, 2.2 in all): a left join."""
    days = table(spark, sf_dir, "note_observations").select("day")
    signals = file_signals(table(spark, sf_dir, "files").select("path", "modified"), days, PROJECTS)
    rows = _sums(spark, sf_dir).join(signals, ["day", "state"], "left")
    more = F.least(F.coalesce("files", F.lit(0)) * 0.7, F.lit(1.4))
    return rows.select("vault", "day", "state", F.round(F.least(F.col("completion") + more, F.lit(2.2)), 6).alias("completion"), F.coalesce("files", F.lit(0)).alias("files"))


def mat12_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes after each vault's high-water mark: what a run after the one of July 2025 takes in."""
    n = notes(spark, sf_dir).select("note_id", "vault", "day")
    mark = n.where(F.col("day") <= F.lit("2025-06-30").cast("date")).groupBy("vault").agg(F.max("day").alias("last"))
    return n.join(mark, "vault", "left").where(F.col("last").isNull() | (F.col("day") > F.col("last"))).select("note_id", "vault")


def set_tag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of a note's tags and its topics."""
    none = F.array().cast("array<string>")
    rows = notes(spark, sf_dir).select("note_id", F.array_distinct(F.coalesce("tags", none)).alias("tags"), E.item_topics(F.col("text")).alias("topics"))
    return rows.select("note_id", F.size(F.array_union("tags", "topics")).alias("either"), F.size(F.array_intersect("tags", "topics")).alias("both"), F.size(F.array_except("tags", "topics")).alias("tags_only"), F.arrays_overlap("tags", "topics").alias("overlap"))


_BL = f"{NOTES}, bl as (select note_id, vault, day, (i - 1)::int as block_index, b as block, lower(b) as low from (select note_id, vault, day, unnest(x) as b, generate_subscripts(x, 1) as i from (select note_id, vault, day, {blocks_sql(_norm('target'))} as x from notes)))"
_HIT = "list_filter([" + ", ".join(
    f"case when regexp_matches(low, '(^|[^a-z0-9_]){re.escape(w.lower())}($|[^a-z0-9_])') then '{w}' end" if re.fullmatch(r"[a-z0-9_+-]+", w.lower()) else f"case when contains(low, '{w.lower()}') then '{w}' end" for w in I.QUESTION["keywords"]
) + "], lambda x: x is not null)"
_QF = f"""{_BL}, qf0 as (select *, {_HIT} as hits, {sql_any('low', I.QUESTION['conflict'])} as cf, {sql_any('low', I.QUESTION['completion'])} as cl from bl),
qf as (select *, 0.75::double + least(len(hits), 6) * 0.28::double + case when cf then 0.75::double else 0 end + case when {sql_any('low', L.ACTION)} then 0.35::double else 0 end + case when {sql_any('low', L.TIME_PRESSURE)} then 0.25::double else 0 end as score,
 case when cf then 'conflict' when cl then 'completion' else 'evidence' end as role, case when cl then 0.85::double else 0 end as inhibition from qf0 where len(hits) > 0)"""
_KINDS = lambda t: "list_filter([" + ", ".join(f"case when {sql_any('low', ws)} then '{k}' end" for k, ws in t.items()) + "], lambda x: x is not null)"
_COUNT = lambda t: "(" + " + ".join(f"len(list_filter({sql_list(ws)}, lambda w: contains(low, lower(w))))" for ws in t.values()) + ")"
_RH = lambda r: f"list_contains(roles, '{r}')"
_IF = f"""{_BL}, i0 as (select *, {_KINDS(I.ROLES)} as roles, {_COUNT(I.ROLES)} as rh, {_KINDS(I.DOMAINS)} as domains, {_COUNT(I.DOMAINS)} as dh from bl),
i1 as (select *, 0.30::double + {' + '.join(f"case when {_RH(r)} then {w}::double else 0 end" for r, w in I.ROLE_WEIGHTS.items())} + least(dh, 8) * 0.12::double + greatest(len(domains) - 1, 0) * 0.55::double + least(rh, 8) * 0.08::double
 + 0.55::double * least(1.0::double, len(regexp_extract_all(block, '[0-9]+(?:\\.[0-9]+)?')) * 0.12::double + len(list_filter(regexp_split_to_array(block, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}'))) * 0.10::double + len(list_filter({sql_list(L.SYMBOLS)}, lambda s: contains(block, s))) * 0.12::double)
 + case when {_RH('tension')} and {_RH('bridge')} then 0.65::double else 0 end + case when {_RH('compression')} and {_RH('validation')} then 0.40::double else 0 end + case when {_RH('spark')} and ({_RH('tension')} or {_RH('bridge')}) then 0.55::double else 0 end as score
 from i0 where len(roles) > 0 or len(domains) > 0), inf as (select * replace (case when len(roles) = 0 then ['domain_evidence'] else roles end as roles) from i1 where score >= 0.75)"""
_PART = lambda when, share: f"round(least(sum(case when {when} then score else 0 end), {I.CAP * share}::double), 6)"

QUERIES = {
    "mat3_question_fragments": mat3_question_fragments, "agg2_question_days": agg2_question_days, "mat4_word_counts": mat4_word_counts, "sco7_inspiration_fragments": sco7_inspiration_fragments, "agg3_daily_inspiration": agg3_daily_inspiration,
    "lif7_fragments": lif7_fragments, "lif8_inspiration_spikes": lif8_inspiration_spikes, "joi8_completed_days": joi8_completed_days, "mat12_incremental": mat12_incremental, "set_tag_overlap": set_tag_overlap,
}
ORACLE = {
    "mat3_question_fragments": f"with {_QF} select note_id, block_index, array_to_string(hits, '|') as hits, round(score, 6) as score, role, inhibition from qf",
    "agg2_question_days": f"with {_QF} select vault, day, round(least(sum(score), 6.8::double), 6) as evidence, least(sum(inhibition), 2.5::double) as inhibition, count(*)::bigint as fragments from qf group by 1, 2",
    "mat4_word_counts": f"with {NOTES}, w as (select note_id, lower(text) as low, unnest({sql_list(L.BLOCKER)}) as word from notes) select note_id, word, ((length(low) - length(replace(low, word, ''))) // length(word))::int as uses from w where contains(low, word)",
    "sco7_inspiration_fragments": f"with {_IF} select note_id, block_index, array_to_string(roles, '|') as roles, array_to_string(domains, '|') as domains, round(score, 6) as score from inf",
    "agg3_daily_inspiration": f"with {_IF} select vault, day, {_PART('true', 1.0)} as input, {_PART(_RH('tension'), 0.8)} as tension, {_PART(_RH('bridge') + ' or len(domains) >= 2', 0.8)} as bridge, {_PART(_RH('spark'), 0.65)} as spark, {_PART(_RH('validation'), 0.6)} as validation, count(*)::bigint as fragments from inf group by 1, 2",
    "joi8_completed_days": "with " + DAILY + f", sg as (select day::date as day, state, files from ({STREAM_ORACLE['src8_file_signals']})) select vault, s.day, s.state, round(least(completion + least(coalesce(files, 0) * 0.7::double, 1.4::double), 2.2::double), 6) as completion, coalesce(files, 0) as files from sums s left join sg on sg.day = s.day and sg.state = s.state",
    "mat12_incremental": f"with {NOTES}, m as (select vault, max(day) as last from notes where day <= date '2025-06-30' group by 1) select note_id, vault from notes left join m using (vault) where last is null or day > last",
    "set_tag_overlap": f"""with {NOTES}, t as (select note_id, list_distinct(coalesce(tags, [])) as tags, lower(text) as low from notes), s as (select note_id, tags, {_KINDS(L.TOPICS)} as topics from t)
select note_id, len(list_distinct(list_concat(tags, topics)))::int as either, len(list_intersect(tags, topics))::int as both, len(list_filter(tags, lambda x: not list_contains(topics, x)))::int as tags_only, len(list_intersect(tags, topics)) > 0 as overlap from s""",
}
day_as_text(QUERIES, ORACLE, ["agg2_question_days", "agg3_daily_inspiration", "lif7_fragments", "lif8_inspiration_spikes", "joi8_completed_days"])
