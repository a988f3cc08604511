"""Queries that check, rank and label what the others find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T
from ..functions.keys import term_keys, title_key
from ..operators import relations as R
from ..tables import once, table
from .common import day_as_text, notes, sql_any, sql_list
from .evidence_queries import EVIDENCE, _evidence
from .field_queries import _edges, _points, _RESOLVE, _TIME
from .orphan_queries import term_key_sql
from .relation_queries import _CELLS, _OBS, _WORDS, _FRAG, _HITS, _hits, _observations, _terms
from .stream_queries import ORACLE as STREAM_ORACLE
from .stream_queries import agg6_merged_policies

VIEWS = {"thesis": {"thesis_loop": 1.0, "experiment_loop": 0.6}, "career": {"career_transition": 1.0, "ai_memory_design": 0.5}, "load": {"emotion_load": 1.0, "thesis_loop": 0.3}}


def joi13_candidates_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation candidates, in whichever order and spelling their terms stand, beside the count and days that the fragments give: a left join on the ordered pair of keys."""
    c = once(table(spark, sf_dir, "relation_candidates"), "candidate_id").select("candidate_id", "count", "distinct_days", title_key("source").alias("a"), title_key("target").alias("b"))
    c = c.select("candidate_id", F.col("count").alias("claimed"), F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"))
    f = once(table(spark, sf_dir, "fragments"), "fragment_id").select("day", term_keys("terms").alias("terms"))
    pairs = f.select("day", "terms", F.posexplode("terms").alias("at", "source")).select("day", "source", F.explode(F.expr("slice(terms, at + 2, size(terms))")).alias("target"))
    # only the candidates' pairs are counted: a semi-join before the aggregation
    wanted = c.select("source", "target").distinct()
    n = pairs.join(wanted, ["source", "target"], "left_semi").groupBy("source", "target", "day").count().groupBy("source", "target").agg(F.sum("count").alias("found"), F.count("day").alias("found_days"))
    out = c.join(n, ["source", "target"], "left")
    return out.select("candidate_id", "claimed", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("found_days", F.lit(0)).alias("found_days"), F.coalesce(F.col("claimed") == F.col("found"), F.lit(False)).alias("holds"))


def joi15_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fragments' texts hold each of the leading concepts as a substring, and how many list it as a term."""
    scored = R.concept_scores(_terms(spark, sf_dir))
    names = [r[0] for r in scored.orderBy(F.round("score", 9).desc(), "term").limit(32).select("term").collect()]  # the number of concepts is the feature
    f = once(table(spark, sf_dir, "fragments"), "fragment_id").select("fragment_id", F.lower("text").alias("low"))
    texts = f.select(F.explode(T.matched(F.col("low"), names)).alias("term")).groupBy("term").agg(F.count("*").alias("in_text"))
    return scored.where(F.col("term").isin(names)).select("term", F.col("count").alias("listed")).join(texts, "term", "left").select("term", "listed", F.coalesce("in_text", F.lit(0)).alias("in_text"))


def top4_prediction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight greatest prediction errors (the report's size)."""
    p = _points(spark, sf_dir).select("vault", "state", "day", F.round("error", 6).alias("error"))
    return p.orderBy(F.col("error").desc(), "vault", "day", "state").limit(8)


def top4_macro_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight points that come first as macro candidates: those first, then by effective ratio, error and ratio (the report's size)."""
    p = _points(spark, sf_dir).select("vault", "state", "day", "macro", *[F.round(c, 6).alias(c) for c in ("effective", "error", "ratio")])
    return p.orderBy(F.col("macro").desc(), F.col("effective").desc(), F.col("error").desc(), F.col("ratio").desc(), "vault", "day", "state").limit(8)


def top6_notes_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five notes of most evidence for each state (the report's size); the sums come before the rank."""
    s = _evidence(spark, sf_dir).groupBy("state", "note_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("state").orderBy(F.col("score").desc(), "note_id"))).where("rank <= 5")


def sco22_note_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.5 * inbound + outbound + 0.35 * evidence of each linked note."""
    e = _edges(spark, sf_dir)
    out = e.where("target is not null").groupBy(F.col("source").alias("path")).agg(F.countDistinct("link").alias("o"))
    inn = e.where("target is not null and source <> target").groupBy(F.col("target").alias("path")).agg(F.countDistinct("source").alias("i"))
    own = _evidence(spark, sf_dir).groupBy("note_id").agg(F.sum("score").alias("s")).join(notes(spark, sf_dir).select("note_id", "path"), "note_id").groupBy("path").agg(F.sum("s").alias("s"))
    rows = out.join(inn, "path", "full").na.fill(0).join(own, "path", "left").na.fill(0.0)
    return rows.select("path", F.round(1.5 * F.col("i") + F.col("o") + 0.35 * F.col("s"), 5).alias("rank_score"))


def sco8_hit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation score of each hit, from its topics, roles and words."""
    none = F.array().cast("array<string>")
    h = once(table(spark, sf_dir, "evidence_hits"), "hit_id").select("hit_id", *[F.coalesce(c, none).alias(c) for c in ("topics", "roles", "matched_terms")])
    has = lambda *rs: F.arrays_overlap("roles", F.array(*map(F.lit, rs)))
    score = 0.6 + F.least(F.size("topics"), F.lit(4)) * 0.55 + F.least(F.size("matched_terms"), F.lit(8)) * 0.12 + F.least(F.size("roles"), F.lit(5)) * 0.35
    extra = F.when(has("conflict", "failure"), 0.35).otherwise(0.0) + F.when(has("metric"), 0.25).otherwise(0.0) + F.when(has("decision"), 0.25).otherwise(0.0) + F.when(F.size("topics") >= 2, 0.55).otherwise(0.0)
    return h.where(F.size("topics") > 0).select("hit_id", F.round(score + F.coalesce(extra, F.lit(0.0)), 6).alias("score"))


def sco10_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primitive features and intensity of each hit's snippet, between 0.15 and 2.2."""
    h = once(table(spark, sf_dir, "evidence_hits").where("snippet is not null"), "hit_id").select("hit_id", "snippet", F.size(F.coalesce("matched_terms", F.array().cast("array<string>"))).alias("n"))
    low = F.lower("snippet")
    done = T.contains_any(low, L.COMPLETION) & ~T.contains_any(low, L.INCOMPLETE)
    base = 0.55 + 0.04 * F.least("n", F.lit(25)) + F.when(T.contains_any(low, L.ACTION), 0.28).otherwise(0.0) + F.when(T.contains_any(low, L.BLOCKER), 0.35).otherwise(0.0)
    base = base + 0.22 * T.specificity(F.col("snippet"), 0.10, 0.08, 0.12, ["->", "→", "/", "%", "mV", "Hz", "Ω"]) - F.when(done, 0.18).otherwise(0.0)
    return h.select("hit_id", F.round(F.greatest(F.lit(0.15), F.least(F.lit(2.2), base)), 6).alias("intensity"))


def agg23_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vault's score in each view: the weighted sum of its dimensions' pressures, and its strongest dimension (argmax)."""
    from .relation_queries import lif9_latent_cells

    cells = lif9_latent_cells(spark, sf_dir)
    weights = spark.createDataFrame([(v, d, w) for v, m in VIEWS.items() for d, w in m.items()], "view string, dimension string, weight double")
    rows = cells.join(F.broadcast(weights), "dimension")
    return rows.groupBy("vault", "view").agg(F.round(F.sum(F.col("pressure") * F.col("weight")), 4).alias("score"), F.max_by("dimension", F.struct("pressure", "dimension")).alias("strongest"))


def joi9_effective_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each topic and day that are let through: topics joined to their policies, muted ones left out."""
    h = _hits(spark, sf_dir).select("hit_id", "day", "score", F.explode("topics").alias("topic"))
    p = agg6_merged_policies(spark, sf_dir).select("topic", "threshold", "muted")
    rows = h.join(p, "topic", "left").where(~F.coalesce("muted", F.lit(False)))
    return rows.groupBy("topic", "day").agg(F.round(F.sum("score"), 4).alias("score"), F.max(F.coalesce("threshold", F.lit(7.0))).alias("threshold"))


def txt15_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each event's JSON properties as one text; what is no object is taken as it stands."""
    values = F.array_join(F.map_values(F.from_json("props", "map<string,string>")), " ")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(values, "props").alias("flat"))


def ext7_dimension_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four commonest words of each dimension, its label."""
    w = _observations(spark, sf_dir).select(F.explode("dimensions").alias("dimension"), "words").select("dimension", F.explode("words").alias("word")).groupBy("dimension", "word").agg(F.count("*").alias("uses"))
    top = w.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(F.col("uses").desc(), "word"))).where("rank <= 4")
    return top.groupBy("dimension").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " / ").alias("label"))


_OV = lambda rs: f"len(list_intersect(roles, {sql_list(rs)})) > 0"
QUERIES = {
    "joi13_candidates_checked": joi13_candidates_checked, "joi15_annotated": joi15_annotated, "top4_prediction_errors": top4_prediction_errors, "top4_macro_candidates": top4_macro_candidates, "top6_notes_by_state": top6_notes_by_state, "sco22_note_ranks": sco22_note_ranks,
    "sco8_hit_scores": sco8_hit_scores, "sco10_intensity": sco10_intensity, "agg23_views": agg23_views, "joi9_effective_thresholds": joi9_effective_thresholds, "txt15_flattened": txt15_flattened, "ext7_dimension_words": ext7_dimension_words,
}
_RAW = "rh as (select hit_id, any_value(snippet) as snippet, coalesce(any_value(topics), []) as topics, coalesce(any_value(roles), []) as roles, coalesce(any_value(matched_terms), []) as mt from evidence_hits group by 1)"
ORACLE = {
    "joi13_candidates_checked": f"""with {_FRAG}, p as (select a.term as source, b.term as target, count(*)::bigint as found, count(distinct a.day)::bigint as found_days from tk a join tk b on a.fragment_id = b.fragment_id and a.term < b.term group by 1, 2),
c as (select candidate_id, any_value(count) as claimed, any_value(source) as s, any_value(target) as t from relation_candidates group by 1), k as (select candidate_id, claimed, {term_key_sql('s')} as a, {term_key_sql('t')} as b from c)
select candidate_id, claimed, coalesce(found, 0) as found, coalesce(found_days, 0) as found_days, coalesce(claimed = found, false) as holds from k left join p on p.source = least(a, b) and p.target = greatest(a, b)""",
    "joi15_annotated": f"""with {_FRAG}, s as (select term, count(*)::bigint as listed, count(*) * (1 + ln(1 + count(distinct day))) * (0.7::double + least(length(term), 8) / 8.0::double) as score from tk group by term having count(*) >= 3),
c as (select * from s order by round(score, 9) desc, term limit 32), t as (select fragment_id, lower(any_value(text)) as low from fragments group by 1)
select c.term, any_value(listed) as listed, count(t.fragment_id)::bigint as in_text from c left join t on contains(low, c.term) group by 1""",
    "top4_prediction_errors": _TIME + "select vault, state, day, round(error, 6) as error from p order by 4 desc, vault, day, state limit 8",
    "top4_macro_candidates": _TIME + "select vault, state, day, macro, round(effective, 6) as effective, round(error, 6) as error, round(ratio, 6) as ratio from q order by macro desc, 5 desc, 6 desc, 7 desc, vault, day, state limit 8",
    "top6_notes_by_state": "with " + EVIDENCE + ", s as (select state, note_id, round(sum(score), 6) as score from evidence group by 1, 2) select state, note_id, score, row_number() over (partition by state order by score desc, note_id)::int as rank from s qualify row_number() over (partition by state order by score desc, note_id) <= 5",
    "sco22_note_ranks": f"with {EVIDENCE}, {_RESOLVE.partition(', l as ')[1].lstrip(', ')}{_RESOLVE.partition(', l as ')[2]}" + """, ou as (select source as path, count(distinct link) as o from ed where target is not null group by 1), inn as (select target as path, count(distinct source) as i from ed where target is not null and source <> target group by 1),
ow as (select path, sum(score) as s from evidence join (select note_id, path from notes) using (note_id) group by 1)
select path, round(1.5::double * coalesce(i, 0) + coalesce(o, 0) + 0.35::double * coalesce(s, 0), 5) as rank_score from (select path, o, i from ou full join inn using (path)) left join ow using (path)""",
    "sco8_hit_scores": f"""with {_RAW} select hit_id, round(0.6::double + least(len(topics), 4) * 0.55::double + least(len(mt), 8) * 0.12::double + least(len(roles), 5) * 0.35::double + case when {_OV(['conflict', 'failure'])} then 0.35::double else 0 end
 + case when {_OV(['metric'])} then 0.25::double else 0 end + case when {_OV(['decision'])} then 0.25::double else 0 end + case when len(topics) >= 2 then 0.55::double else 0 end, 6) as score from rh where len(topics) > 0""",
    "sco10_intensity": f"""with {_RAW}, l as (select *, lower(snippet) as low from rh where snippet is not null) select hit_id, round(greatest(0.15::double, least(2.2::double, 0.55::double + 0.04::double * least(len(mt), 25) + case when {sql_any('low', L.ACTION)} then 0.28::double else 0 end + case when {sql_any('low', L.BLOCKER)} then 0.35::double else 0 end
 + 0.22::double * least(1.0::double, len(regexp_extract_all(snippet, '[0-9]+(?:\\.[0-9]+)?')) * 0.10::double + len(list_filter(regexp_split_to_array(snippet, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}'))) * 0.08::double + len(list_filter({sql_list(["->", "→", "/", "%", "mV", "Hz", "Ω"])}, lambda s: contains(snippet, s))) * 0.12::double)
 - case when {sql_any('low', L.COMPLETION)} and not {sql_any('low', L.INCOMPLETE)} then 0.18::double else 0 end)), 6) as intensity from l""",
    "agg23_views": f"select vault, view, round(sum(pressure * weight), 4) as score, first(dimension order by pressure desc, dimension desc) as strongest from ({_CELLS}) join (values {', '.join(f"('{v}', '{d}', {w}::double)" for v, m in VIEWS.items() for d, w in m.items())}) as vw(view, dimension, weight) using (dimension) group by 1, 2",
    "joi9_effective_thresholds": f"with {_HITS}, h2 as (select hit_id, day, score, unnest(topics) as topic from hits), p as ({STREAM_ORACLE['agg6_merged_policies']}) select topic, day, round(sum(score), 4) as score, max(coalesce(threshold, 7.0::double)) as threshold from h2 left join p using (topic) where topic is not null and not coalesce(muted, false) group by 1, 2",
    "ext7_dimension_words": f"""with {_OBS}, w as (select dimension, word, count(*) as uses from (select unnest(dims) as dimension, {_WORDS} as words from obs) t, unnest(t.words) as u(word) group by 1, 2),
k as (select *, row_number() over (partition by dimension order by uses desc, word) as rank from w) select dimension, string_agg(word, ' / ' order by rank) as label from k where rank <= 4 group by 1""",
    "txt15_flattened": "select event_id, case when json_type(props) = 'OBJECT' then array_to_string(list_transform(json_keys(props), lambda k: json_extract_string(props, '$.\"' || k || '\"')), ' ') else props end as flat from events",
}
day_as_text(QUERIES, ORACLE, ["top4_prediction_errors", "top4_macro_candidates", "joi9_effective_thresholds"])
