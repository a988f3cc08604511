"""Queries over terms, relation evidence, policy drafts of relations, and the graph as packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T
from ..operators import controller as C
from ..operators import evidence as E
from ..operators import memory as M
from ..operators import relations as R
from ..operators import vectors as V
from ..tables import bound, once, spread, table
from .common import arrivals, sql_any, sql_list
from .field_queries import _RESOLVE, _edges
from .insight_queries import _BL
from .relation_queries import _HITS, RULES, _hits, sco12_signals
from .text_queries import snippet_sql

UNSORTED = "自定义问题场"


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fragments").select("fragment_id", "text").where("text is not null")


def _counted(rows: DataFrame) -> DataFrame:
    """Fragments that came twice are taken once among their terms' counts."""
    each = rows.groupBy("fragment_id", "term").agg(F.first("n").alias("n"))
    return each.groupBy("term").agg(F.sum("n").alias("uses"), F.count("*").alias("fragments"))


def _terms_of(rows: DataFrame, terms) -> DataFrame:
    """fragment_id, term, n: counts within a row, so that a row's arrivals have equal ones."""
    one = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", "fragment_id", F.explode(terms).alias("term"))
    return one.groupBy("_row", "fragment_id", "term").agg(F.count("*").alias("n")).drop("_row")


def txt12_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses and fragments of every term that the fragments' texts name: n-grams of Han characters and Latin phrases, generic ones left out."""
    return _counted(_terms_of(_fragments(spark, sf_dir), T.named_terms(F.col("text"))))


def txt13_slot_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses and fragments of every token as slots take them: words, n-grams of 2 to 4 and numbers with their unit."""
    return _counted(_terms_of(_fragments(spark, sf_dir), T.slot_tokens(F.col("text"), sorted(M.SLOT_STOP))))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of notes that bear on relations; notes that came twice are taken once among them."""
    rows = E.relation_evidence(E.note_blocks(spread(arrivals(spark, sf_dir).select("note_id", "day", "text"))))
    rows = rows.select("note_id", "block_index", "day", "topics", "roles", "score", T.snippet(F.col("block"), 128).alias("snippet"))
    return rows.dropDuplicates(["note_id", "block_index"])


def ext3_relation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("note_id", "block_index", F.array_join("topics", "|").alias("topics"), F.array_join("roles", "|").alias("roles"), F.round("score", 6).alias("score"))


def top8_rule_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten pieces of evidence of each relation rule, by score, topics and roles in common and day, in order of days."""
    rows = R.rule_evidence(_evidence(spark, sf_dir), RULES, 10, ["note_id", "block_index"])
    return rows.select("name", "rank", "place", "note_id", "block_index", "overlap", "roles_met", F.round("score", 6).alias("score"))


def mat8_query_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic of each file's title as of a query: the one with most words in it, the first in the list on a tie, a name of its own for none."""
    titles = bound(table(spark, sf_dir, "files").select("title").distinct(), {"found": T.found(F.lower("title"), *V.FIELD_TOPICS.values())})
    counts = [F.struct(F.size(T.held(F.col("found"), ws)).alias("n"), F.lit(-i).alias("at"), F.lit(t).alias("topic")) for i, (t, ws) in enumerate(V.FIELD_TOPICS.items())]
    best = titles.withColumn("best", F.array_max(F.array(*counts)))
    return best.select("title", F.when(F.col("best.n") > 0, F.col("best.topic")).otherwise(UNSORTED).alias("topic"), F.col("best.n").alias("words"))


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(table(spark, sf_dir, "relation_candidates"), "candidate_id")
    return R.checked_relations(rows.withColumnRenamed("candidate_id", "seq"), 0.5)


def mat13_checked_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its type in one spelling, its confidence, and why it is passed over, if it is."""
    return _relations(spark, sf_dir).select(F.col("seq").alias("candidate_id"), "type", F.round("confidence", 6).alias("confidence"), "reason")


def agg7_policy_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draft of each topic that a kept candidate names."""
    return R.policy_drafts(_relations(spark, sf_dir).where("reason is null")).select("topic", "threshold_delta", "priority", "action", "cooldown_days", "relations", F.array_join("reasons", "|").alias("reasons"))


def top13_ranked_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty drafts that come first (the report's size): by priority, the greatest change of threshold, topic."""
    rows = R.policy_drafts(_relations(spark, sf_dir).where("reason is null"))
    return rows.orderBy("priority", F.col("unclamped").desc(), "topic").limit(20).select("topic", "priority", F.col("unclamped").alias("delta"))


def agg21_reconstruction_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each view's positive scores, at most 1."""
    h = _hits(spark, sf_dir).where("score > 0")
    return h.groupBy("view").agg(F.round(F.least(F.avg("score"), F.lit(1.0)), 3).alias("pressure"))


def set5_same_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the topics that a hit lists are, as a set, those that its snippet names."""
    none = F.array().cast("array<string>")
    h = _hits(spark, sf_dir).where("snippet is not null").select("hit_id", F.array_sort(F.array_distinct(F.coalesce("topics", none))).alias("a"), F.array_sort(E.item_topics(F.col("snippet"))).alias("b"))
    return h.select("hit_id", (F.col("a") == F.col("b")).alias("same"))


def snk2_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as a JSON object for each note with links: its path, the notes it links to in order, and how many links lead nowhere."""
    e = _edges(spark, sf_dir)
    rows = e.groupBy(F.col("source").alias("path")).agg(F.array_sort(F.collect_set("target")).alias("links"), F.countDistinct(F.when(F.col("target").isNull(), F.col("link"))).alias("unresolved"))
    return rows.select(F.to_json(F.struct("path", "links", "unresolved")).alias("packet"))


def top6_ranked_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten notes of each kind that most others lead to, or that lead to most others (the report's size), with counts above nought."""
    e = _edges(spark, sf_dir).where("target is not null and source <> target")
    out = e.groupBy(F.lit("out").alias("kind"), F.col("source").alias("path")).agg(F.countDistinct("target").alias("n"))
    inn = e.groupBy(F.lit("in").alias("kind"), F.col("target").alias("path")).agg(F.countDistinct("source").alias("n"))
    w = Window.partitionBy("kind").orderBy(F.col("n").desc(), "path")
    return out.unionAll(inn).withColumn("rank", F.row_number().over(w)).where("rank <= 10")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fragment with its signals, salience and action scores, its text's folder and day."""
    f = once(table(spark, sf_dir, "fragments").select("fragment_id", "day", "path", "text"), "fragment_id").select("fragment_id", "day", F.split("path", "/")[0].alias("vault"), "text")
    return C.action_scores(sco12_signals(spark, sf_dir).join(f, "fragment_id"))


def sco13_action_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The salience of each fragment and the score of each action."""
    return _scored(spark, sf_dir).select("fragment_id", "salience", *C.ACTIONS)


def top11_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve fragments of greatest salience, then of the best action's score (the report's size), with their signals: joined by their ids, a left-semi join."""
    rows = _scored(spark, sf_dir)
    best = F.greatest(*[F.col(a) for a in C.ACTIONS])
    top = rows.select("fragment_id", "salience", best.alias("best")).orderBy(F.col("salience").desc(), F.col("best").desc(), "fragment_id").limit(12)
    return rows.join(F.broadcast(top), "fragment_id", "left_semi").select("fragment_id", F.round("salience", 3).alias("salience"), F.round(best, 3).alias("best"))


def lif12_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each folder's fragments in order through the units: salience, mode and the action chosen."""
    rows = C.controlled(_scored(spark, sf_dir), "vault", ["day", "fragment_id"])
    return rows.select("vault", "fragment_id", F.round("salience", 3).alias("salience"), F.array_join("salient", "|").alias("salient"), "mode", "action", F.array_join("fired", "|").alias("fired"))


def agg24_action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each folder's units chose each action."""
    return lif12_actions(spark, sf_dir).groupBy("vault", "action").agg(F.count("*").alias("fragments"), F.count_if(F.col("mode") == "fine").alias("fine"))


QUERIES = {
    "sco13_action_scores": sco13_action_scores, "top11_actions": top11_actions, "lif12_actions": lif12_actions, "agg24_action_counts": agg24_action_counts,
    "txt12_terms": txt12_terms, "txt13_slot_tokens": txt13_slot_tokens, "ext3_relation_evidence": ext3_relation_evidence, "top8_rule_evidence": top8_rule_evidence, "mat8_query_topics": mat8_query_topics,
    "mat13_checked_relations": mat13_checked_relations, "agg7_policy_drafts": agg7_policy_drafts, "top13_ranked_drafts": top13_ranked_drafts, "agg21_reconstruction_pressure": agg21_reconstruction_pressure,
    "set5_same_topics": set5_same_topics, "snk2_graph": snk2_graph, "top6_ranked_counters": top6_ranked_counters,
}

_RUNS = "regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]{<least>,}')"
_NGRAMS = lambda least, most, runs: f"flatten(list_transform({runs}, lambda r: flatten(list_transform(range({least}, {most + 1}), lambda n: list_transform(range(1, greatest(length(r) - n + 2, 1)), lambda i: substring(r, i, n))))))"
_TERMS12 = f"""list_concat(list_filter({_NGRAMS(2, 6, _RUNS.replace('<least>', '2'))}, lambda t: not list_contains({sql_list(L.GENERIC)}, t) and not regexp_matches(t, '{'|'.join(L.GENERIC_PIECES)}')),
 list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_+\\-]*(?:\\s+[A-Za-z][A-Za-z0-9_+\\-]*){{0,3}}'), lambda t: trim(regexp_replace(t, '\\s+', ' ', 'g'), '-_ ')), lambda t: length(t) >= 2))"""
_TOKENS13 = f"""list_filter(flatten([list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_+\\-]+'), lambda w: lower(w)), list_filter({_RUNS.replace('<least>', '1')}, lambda r: length(r) <= 4), {_NGRAMS(2, 4, _RUNS.replace('<least>', '2'))},
 list_transform(regexp_extract_all(text, '(?i)[0-9]+(?:\\.[0-9]+)?\\s*(?:mV|V|Hz|kHz|MHz|Ω|ohm|欧姆|倍|%)'), lambda u: lower(replace(u, ' ', '')))]), lambda t: not list_contains({sql_list(sorted(M.SLOT_STOP))}, t))"""
_COUNT = lambda terms: f"with f as (select fragment_id, any_value(text) as text from fragments where text is not null group by 1) select term, count(*)::bigint as uses, count(distinct fragment_id)::bigint as fragments from (select fragment_id, unnest({terms}) as term from f) group by 1"
_TOPICS = {**L.TOPICS, **L.MORE_TOPICS}
_LABELS = lambda t: "list_filter([" + ", ".join(f"case when {sql_any('low', ws)} then '{k}' end" for k, ws in t.items()) + "], lambda x: x is not null)"
_ROLE = lambda r, ws: f"case when {sql_any('low', ws)}" + (" or regexp_matches(block, '[0-9]+(\\.[0-9]+)?\\s*(Hz|hz|mV|mv|V|Vpp|RMS|uA|μA|ms|s)($|[^\\p{L}\\p{N}_])')" if r == "metric" else "") + f" then '{r}' end"
_WORDS = "len(list_distinct(flatten([" + ", ".join(f"list_filter({sql_list(ws)}, lambda w: contains(low, lower(w)))" for ws in _TOPICS.values()) + "])))"
_OV = lambda rs: f"len(list_intersect(roles, {sql_list(rs)})) > 0"
_REL = f"""{_BL}, re0 as (select note_id, day, block_index, block, {_LABELS(_TOPICS)} as topics, {_WORDS} as words, list_filter([{', '.join(_ROLE(r, ws) for r, ws in L.RELATION_ROLES.items())}], lambda x: x is not null) as r0 from bl),
re1 as (select *, case when len(r0) = 0 then ['evidence'] else r0 end as roles from re0 where len(topics) > 0),
re as (select *, {snippet_sql('block', 128)} as snippet, 0.6::double + least(len(topics), 4) * 0.55::double + least(words, 8) * 0.12::double + least(len(roles), 5) * 0.35::double + case when {_OV(['conflict', 'failure'])} then 0.35::double else 0 end
 + case when {_OV(['metric'])} then 0.25::double else 0 end + case when {_OV(['decision'])} then 0.25::double else 0 end + case when len(topics) >= 2 then 0.55::double else 0 end as score from re1)"""
_CHECKED = f"""rc as (select candidate_id, any_value(source) as source, any_value(target) as target, any_value(relation_type) as rt, any_value(score) as score, any_value(hypothesis) as hypothesis from relation_candidates group by 1),
ty as (select *, regexp_replace(lower(trim(coalesce(rt, 'unknown'), ' ')), '[ -]', '_', 'g') as t0 from rc),
ch as (select *, case when t0 = '' then 'unknown' {' '.join(f"when t0 = '{a}' then '{b}'" for a, b in L.RELATION_TYPES.items())} else t0 end as type, case when score is null then 1.0::double when score > 1 then least(score / 10, 1.0::double) else greatest(score, 0) end as confidence from ty),
ck as (select *, case when type = 'unknown' then 'unknown relation_type' when confidence < 0.5 then 'confidence' end as reason from ch)"""
_EFFECTS = "ef(kind, side, delta, priority, action, cooldown) as (values " + ", ".join(f"('{k}', '{s}', {d}::double, '{p}', {L.ACTIONS.index(a)}, {c})" for k, es in L.RELATION_EFFECTS.items() for s, d, p, a, c in es) + ")"
_DRAFTS = f"""{_CHECKED}, {_EFFECTS}, nm as (select candidate_id as seq, type, trim(source, ' ') as source, trim(target, ' ') as target, hypothesis from ck where reason is null and trim(source, ' ') <> '' and trim(target, ' ') <> ''),
dr as (select seq, case when side = 'source' then source else target end as topic, delta, priority, action, cooldown, coalesce(nullif(trim(hypothesis, ' '), ''), source || ' -[' || type || ']-> ' || target) as reason
 from nm join ef on ef.kind = case when type in (select kind from ef) then type else '' end),
su as (select topic, round(sum(delta), 6) as delta, min(priority) as priority, max(action) as action, max(cooldown) as cooldown, count(*)::bigint as relations from dr group by 1),
rs as (select topic, string_agg(reason, '|' order by seq, reason) as reasons from (select * from (select topic, reason, min(seq) as seq from dr group by 1, 2) qualify row_number() over (partition by topic order by seq, reason) <= 8) group by 1)"""

_TIMES = lambda low, w: f"((length({low}) - length(replace({low}, '{w.lower()}', ''))) / {len(w)}::double)"
_CLIP = lambda x: f"least(1.0::double, greatest(0.0::double, {x}))"
_SIGNALS = f"""f as (select fragment_id, coalesce(any_value(text), '') as text, lower(coalesce(any_value(text), '')) as low from fragments group by 1),
tk as (select fragment_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_\\-]{{2,}}|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'))) as token from f), one as (select token from tk group by 1 having count(*) = 1),
nt as (select fragment_id, count(distinct token) as tokens, count(one.token) as rare from tk left join one using (token) group by 1),
s0 as (select f.fragment_id, low, coalesce(tokens, 0) as tokens, coalesce(rare, 0) as rare, {', '.join(_CLIP('(' + ' + '.join(_TIMES('low', w) for w in ws) + ") / 6.0::double + 0.06::double * greatest(0.15::double, least(1.0::double, ln(1 + length(text)) / ln(500)))") + f' as {n}' for n, ws in M.SIGNALS.items())} from f left join nt using (fragment_id)),
s1 as (select * replace ({_CLIP('novelty + least(rare, 12) / 30.0::double')} as novelty, case when tokens < 8 then {_CLIP('fatigue + 0.25::double')} else fatigue end as fatigue) from s0),
s2 as (select * replace (case when urgency > 0.35 or risk > 0.35 then greatest(0, fatigue - 0.15::double) else fatigue end as fatigue) from s1), sg as (select fragment_id, low, {', '.join(f'round({n} + 1e-9::double, 4) as {n}' for n in M.SIGNALS)} from s2)"""
_HITS_OF = lambda ws: "(" + " + ".join(f"((length(low) - length(replace(low, '{w}', ''))) / {len(w)}::double)" for w in ws) + ")"
_SCORE13 = {
    "fine_inspect": "0.42::double * salience + 0.25::double * conflict + 0.20::double * risk + 0.16::double * value",
    "coarse_scan": "0.26::double + 0.23::double * novelty + 0.10::double * (1 - salience)",
    "backtrack": "0.18::double + 0.35::double * conflict + 0.20::double * fatigue",
    "summarize": "0.20::double + 0.25::double * value + 0.18::double * urgency",
    "test_code": f"0.12::double + least({_HITS_OF(C.CODE_WORDS)}, 6) / 12.0::double + 0.15::double * risk",
    "write_memory": "0.16::double + 0.22::double * value + 0.22::double * novelty + 0.10::double * urgency",
    "delegate_agent": f"0.08::double + least({_HITS_OF(C.AGENT_WORDS)}, 5) / 10.0::double + 0.22::double * novelty",
    "drop_path": "0.10::double + 0.45::double * fatigue - 0.18::double * urgency - 0.18::double * risk",
}
_ACT = f"""{_SIGNALS}, sl as (select *, round({_CLIP('(' + ' + '.join(f'{w}::double * {n}' for n, w in C.WEIGHTS.items()) + ') / 3.1::double')} + 1e-9::double, 4) as salience from sg),
ac as (select fragment_id, salience, {', '.join(f'round({_CLIP(x)} + 1e-9::double, 4) as "{n}"' for n, x in _SCORE13.items())} from sl)"""

ORACLE = {
    "sco12_signals": f"with {_SIGNALS} select fragment_id, {', '.join(M.SIGNALS)} from sg",
    "sco13_action_scores": f"with {_ACT} select fragment_id, {', '.join(f'{chr(34)}{c}{chr(34)}' for c in ('salience', *C.ACTIONS))} from ac",
    "top11_actions": f"with {_ACT}, b as (select fragment_id, salience, greatest({', '.join(f'{chr(34)}{c}{chr(34)}' for c in C.ACTIONS)}) as best from ac) select fragment_id, round(salience, 3) as salience, round(best, 3) as best from (select * from b order by salience desc, best desc, fragment_id limit 12)",
    "txt12_terms": _COUNT(_TERMS12),
    "txt13_slot_tokens": _COUNT(_TOKENS13),
    "ext3_relation_evidence": f"with {_REL} select note_id, block_index, array_to_string(topics, '|') as topics, array_to_string(roles, '|') as roles, round(score, 6) as score from re",
    "top8_rule_evidence": f"""with {_REL}, ru(name, wanted, liked) as (values {', '.join(f"('{n}', {sql_list(t)}, {sql_list(list(dict.fromkeys(q + b)))})" for n, t, q, b in RULES)}),
m as (select name, note_id, block_index, day, snippet, score, len(list_intersect(topics, wanted))::int as overlap, len(list_intersect(roles, liked))::int as roles_met from re, ru where len(list_intersect(topics, wanted)) > 0),
fi as (select * from m qualify row_number() over (partition by name, snippet order by round(score, 9) desc, overlap desc, roles_met desc, day desc, note_id, block_index) = 1),
ra as (select *, row_number() over (partition by name order by round(score, 9) desc, overlap desc, roles_met desc, day desc, note_id, block_index)::int as rank from fi)
select name, rank, row_number() over (partition by name order by day, rank)::int as place, note_id, block_index, overlap, roles_met, round(score, 6) as score from ra where rank <= 10""",
    "mat8_query_topics": f"""with t as (select distinct title, lower(title) as low from files), tp(pos, topic, ws) as (values {', '.join(f"({i}, '{t}', {sql_list(ws)})" for i, (t, ws) in enumerate(V.FIELD_TOPICS.items()))}),
c as (select title, pos, topic, len(list_filter(ws, lambda w: contains(low, lower(w))))::int as n from t, tp)
select title, case when max(n) > 0 then first(topic order by n desc, pos) else '{UNSORTED}' end as topic, max(n) as words from c group by 1""",
    "mat13_checked_relations": f"with {_CHECKED} select candidate_id, type, round(confidence, 6) as confidence, reason from ck",
    "agg7_policy_drafts": f"with {_DRAFTS} select topic, greatest(-2.0::double, least(2.0::double, delta)) as threshold_delta, priority, {sql_list(L.ACTIONS)}[action + 1] as action, least(cooldown, 30) as cooldown_days, relations, reasons from su join rs using (topic)",
    "top13_ranked_drafts": f"with {_DRAFTS} select topic, priority, delta from su order by priority, delta desc, topic limit 20",
    "agg21_reconstruction_pressure": f"with {_HITS} select view, round(least(avg(score), 1.0::double), 3) as pressure from hits where score > 0 group by 1",
    "set5_same_topics": f"with {_HITS}, s as (select hit_id, list_sort(list_distinct(coalesce(topics, []))) as a, lower(snippet) as low from hits where snippet is not null) select hit_id, a = list_sort({_LABELS(L.TOPICS)}) as same from s",
    "snk2_graph": f"""with {_RESOLVE}, g as (select source as path, coalesce(list_sort(list(distinct target) filter (where target is not null)), []) as links, count(distinct case when target is null then link end)::bigint as unresolved from ed group by 1)
select to_json({{'path': path, 'links': links, 'unresolved': unresolved}})::varchar as packet from g""",
    "top6_ranked_counters": f"""with {_RESOLVE}, x as (select 'out' as kind, source as path, count(distinct target)::bigint as n from ed where target is not null and source <> target group by 2 union all
select 'in', target, count(distinct source)::bigint from ed where target is not null and source <> target group by 2) select kind, path, n, row_number() over (partition by kind order by n desc, path)::int as rank from x qualify row_number() over (partition by kind order by n desc, path) <= 10""",
}
