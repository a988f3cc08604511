"""Queries over prediction, graphs, vectors and fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T
from ..operators import diffusion as D
from ..operators import graph as G
from ..operators import groups as W
from ..operators import prediction as P
from ..operators import recurrence as R
from ..operators import vectors as V
from ..session import cut, discard
from ..tables import once, spread, table
from .common import NOTES, arrivals, day_as_text, notes, sql_any, sql_list
from .evidence_queries import DAILY, _parameters, _sums
from .text_queries import _SHINGLES

QUERY = "LIF 事件率 阈值 采样链路 频谱 drift"


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state on every day that a vault has notes, without resets."""
    days = notes(spark, sf_dir).select("vault", "day").distinct()
    grid = days.withColumn("state", F.explode(F.array(*map(F.lit, L.KEYWORDS))))
    rows = grid.join(_sums(spark, sf_dir), ["vault", "day", "state"], "left").fillna(0.0, ["evidence", "completion"])
    return R.two_timescale(rows, ["vault"], _parameters(spark))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.predicted(P.diffused(_timeline(spark, sf_dir), ["vault"]), ["vault"])


def joi5_diffused_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.diffused(_timeline(spark, sf_dir), ["vault"]).select("vault", "state", "day", F.round("ratio", 6).alias("ratio"), F.round("diffused", 6).alias("diffused"))


def lif11_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("vault", "state", "day", *[F.round(c, 6).alias(c) for c in ("predicted", "error", "error_ema", "effective")], "micro", "macro", "streak")


def agg25_homeostasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.homeostasis(_points(spark, sf_dir), ["vault"])
    return rows.select("vault", "state", "micro", "macro", F.round("threshold_delta", 6).alias("threshold_delta"), F.round("last_error", 6).alias("last_error"))


def joi6_meta_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflict, global voltage, density and energy of each point."""
    rows = P.meta_energy(_points(spark, sf_dir), ["vault"])
    return rows.select("vault", "state", "day", *[F.round(c, 6).alias(c) for c in ("conflict", "global_voltage", "micro_density", "low_completion", "energy")])


def top5_meta_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five points of most energy (the report's size), and whether they reach the meta threshold."""
    rows = P.meta_energy(_points(spark, sf_dir), ["vault"])
    return rows.orderBy(F.round("energy", 9).desc(), F.round("conflict", 9).desc(), F.round("error_ema", 9).desc(), "vault", "day", "state").limit(5).select("vault", "state", "day", F.round("energy", 6).alias("energy"), (F.col("energy") >= P.META).alias("fired"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("note_id", "path", F.explode("links").alias("link")).where("link is not null")


def joi2_resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolve(_links(spark, sf_dir), table(spark, sf_dir, "files"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    found = G.resolve(links, table(spark, sf_dir, "files"))
    return links.select(F.col("path").alias("source"), "link").join(found.withColumnRenamed("path", "target"), "link")


def joi3_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).where("target is not null and source <> target").groupBy("target").agg(F.countDistinct("source").alias("inbound"))


def agg9_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out, in and bridge degree of each note with a link either way, and its unresolved links."""
    e = _edges(spark, sf_dir)
    out = e.groupBy(F.col("source").alias("path")).agg(F.countDistinct(F.when(F.col("target").isNotNull(), F.col("link"))).alias("outbound"), F.countDistinct(F.when(F.col("target").isNull(), F.col("link"))).alias("unresolved"))
    inn = e.where("target is not null and source <> target").groupBy(F.col("target").alias("path")).agg(F.countDistinct("source").alias("inbound"))
    both = out.join(inn, "path", "full").na.fill(0)
    return both.withColumn("bridge", F.col("outbound") + F.col("inbound"))


def _nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The notes with their key, folder, day and tags, and the keys that they link to."""
    n = arrivals(spark, sf_dir).withColumn("key", F.lower(F.regexp_replace("title", r"\s+", "")))  # edges are a set: a note that arrived twice adds none
    links = n.select("note_id", F.explode("links").alias("l")).where("l is not null").select("note_id", F.lower(F.regexp_replace(G.stem(G.link_target(F.col("l"))), r"\s+", "")).alias("key")).distinct()
    return n.select("note_id", "key", F.col("vault").alias("folder"), "day", "tags"), links


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbourhood(*_nodes(spark, sf_dir))


def joi4_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree and centrality of each note in the graph of links, tags and folders."""
    d = _neighbours(spark, sf_dir).groupBy(F.col("src").alias("note_id")).agg(F.count("*").alias("degree"))
    most = d.agg(F.max("degree").alias("most"))
    return d.crossJoin(F.broadcast(most)).select("note_id", "degree", F.round(F.col("degree") / F.col("most"), 6).alias("centrality"))


def lif14_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of diffusion of the notes' topics and tags over the graph; lif14_diffused_vectors has the whole vectors."""
    n = notes(spark, sf_dir)
    low = F.lower("text")
    topics = F.array_compact(F.array(*[F.when(T.contains_any(low, ws), F.lit(f"topic:{t}")) for t, ws in V.FIELD_TOPICS.items()]))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("tag:"), t))
    rows = n.select("note_id", F.explode(F.array_union(topics, tags)).alias("feature")).where("feature is not null").select("note_id", "feature", F.lit(1.0).alias("weight"))
    return G.diffuse(G.unit(rows), _neighbours(spark, sf_dir)).select("note_id", "feature", F.round("weight", 6).alias("weight"))


def vec1_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many features each note's vector has, the weight of the greatest, and a checksum over every feature and weight."""
    v = V.sparse_vectors(notes(spark, sf_dir).select("note_id", "text", "title", "tags"))
    return v.groupBy("note_id").agg(F.count("*").alias("features"), F.round(F.max("weight"), 6).alias("greatest"), F.round(F.sum(F.col("weight") * (F.length("feature") + F.ascii(F.substring("feature", -1, 1)))), 4).alias("checksum"))


def _query_vector(spark: SparkSession) -> DataFrame:
    q = spark.createDataFrame([(0, QUERY, QUERY)], "note_id int, text string, title string").withColumn("tags", F.array().cast("array<string>"))
    return V.sparse_vectors(q)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir)
    similar = V.against(V.sparse_vectors(n.select("note_id", "text", "title", "tags")), _query_vector(spark)).withColumn("centrality", F.lit(0.0))
    return V.field_hits(V.marked(n.select("note_id", "day", "text", "links", "tags")), similar, F.lit("2025-12-31").cast("date"), time_sigma=365.0, semantic_sigma=0.75)


def vec2_field_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the query raises without the graph: similarity, score and modifiers of each note. vec2_diffused_hits has the whole field."""
    return _hits(spark, sf_dir).select("note_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), F.array_join("modifiers", "|").alias("modifiers"))


def agg16_field_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).groupBy("day").agg(F.round(F.sum("current"), 6).alias("current"), F.round(F.sum("completion"), 6).alias("completion"))


def agg17_field_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of the twelve best scores (the report's size)."""
    return _hits(spark, sf_dir).orderBy(F.col("score").desc(), "note_id").limit(12).agg(F.round(F.sum("score"), 6).alias("energy"))


def lif10_field_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field's recurrence on every calendar day."""
    daily = _hits(spark, sf_dir).groupBy("day").agg(F.sum("current").alias("current"), F.sum("completion").alias("completion")).withColumn("key", F.lit("field"))
    return R.calendar_field(daily, ["key"]).select("day", *[F.round(c, 5).alias(c) for c in ("v_fast", "v_slow", "v")], "fired")


def _blocks(spark: SparkSession, sf_dir: str, edges: DataFrame) -> tuple[DataFrame, D.Graph]:
    """The notes' whole vectors in blocks of features, and the graph that they diffuse over. Only the few notes that arrived twice are put together; no other text is shuffled."""
    rows = arrivals(spark, sf_dir).select("note_id", "text", "title", "tags")
    twice = F.broadcast(rows.where("note_id is not null").groupBy("note_id").count().where("count > 1").select("note_id"))
    each = spread(rows).join(twice, "note_id", "left_anti").unionAll(once(rows.join(twice, "note_id", "left_semi"), "note_id"))
    return D.blocks(V.feature_lists(each), D.graph(rows, edges))


def lif14_diffused_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of diffusion of the notes' whole vectors: words, numbers, shingles, topics, tags and titles with their weights."""
    rows = D.vectors(*_blocks(spark, sf_dir, _neighbours(spark, sf_dir)))
    loose = V.sparse_vectors(arrivals(spark, sf_dir).where("note_id is null").select("note_id", "text", "title", "tags"))  # notes without an id have no neighbours
    return rows.unionAll(loose.select("note_id", "feature", F.round("weight", 6).alias("weight")))


def _diffused_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits over the diffused vectors, with the bonus of the degree centrality; a note without neighbours has its own vector and no bonus. All notes of a tag or folder are
    neighbours, in place of the 25 newest that _neighbours pairs."""
    nodes, links = _nodes(spark, sf_dir)
    blocks, graph = _blocks(spark, sf_dir, G.linked(nodes, links).distinct())
    similar = W.similarities(blocks, W.whole(graph, G.grouped(nodes).select("note_id", "g").distinct()), {r["feature"]: r["weight"] for r in _query_vector(spark).collect()})
    discard(blocks)
    rows = once(V.marked(arrivals(spark, sf_dir).where("note_id is not null").select("note_id", "day", "text", "links", "tags")), "note_id")
    return V.field_hits(rows, similar, F.lit("2025-12-31").cast("date"), time_sigma=365.0, semantic_sigma=0.75)


def vec2_diffused_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the query raises over the diffused vectors, with centrality: the whole field of the survey's EXT-6."""
    return _diffused_hits(spark, sf_dir).select("note_id", F.round("similarity", 6).alias("similarity"), F.round("centrality", 6).alias("centrality"), F.round("score", 6).alias("score"), F.array_join("modifiers", "|").alias("modifiers"))


def agg16_diffused_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffused_hits(spark, sf_dir).groupBy("day").agg(F.round(F.sum("current"), 6).alias("current"), F.round(F.sum("completion"), 6).alias("completion"))


def agg17_diffused_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of the twelve best scores over the diffused vectors."""
    return _diffused_hits(spark, sf_dir).orderBy(F.col("score").desc(), "note_id").limit(12).agg(F.round(F.sum("score"), 6).alias("energy"))


def lif10_diffused_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recurrence of the diffused field on every calendar day."""
    daily = cut(_diffused_hits(spark, sf_dir).groupBy("day").agg(F.sum("current").alias("current"), F.sum("completion").alias("completion")), "daily").withColumn("key", F.lit("field"))  # the calendar reads it twice
    return R.calendar_field(daily, ["key"]).select("day", *[F.round(c, 5).alias(c) for c in ("v_fast", "v_slow", "v")], "fired")


def vec5_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed vectors of 96 places of the notes' shingles and words."""
    tokens = F.concat(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]{3,})"), 1), T.cjk_shingles(F.col("text")))
    rows = notes(spark, sf_dir).select("note_id", F.explode(tokens).alias("term"))
    return V.hashed_vectors(rows).select("note_id", "position", F.round("value", 6).alias("value"))


def vec6_dense_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest label centre by cosine. The centres are as many as there are labels."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    long = e.select("label", F.posexplode("embedding").alias("at", "x"))
    centre = long.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy(F.col("label").alias("centre")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("c"))
    scored = e.crossJoin(F.broadcast(centre)).select("vec_id", "label", "centre", F.round(V.dense_cosine(F.col("embedding"), F.col("c")), 6).alias("cosine"))
    best = scored.groupBy("vec_id", "label").agg(F.max_by("centre", F.struct("cosine", -F.col("centre"))).alias("nearest"), F.max("cosine").alias("cosine"))
    return best.select("vec_id", "label", "nearest", "cosine")


_HITV = "(0.7::double * f + 0.3::double * s) / (0.7::double + 0.3::double)"
_TIME = "with recursive " + DAILY + """, grid as (select distinct n.vault, n.day, s.state from notes n, states s),
full_days as (select g.vault, g.day, g.state, coalesce(evidence, 0) as evidence, coalesce(completion, 0) as completion from grid g left join sums using (vault, day, state)),
o as (select *, row_number() over (partition by vault, state order by day) as r, greatest(coalesce(date_diff('day', lag(day) over (partition by vault, state order by day), day), 1), 1) as gap from full_days join states using (state)),
w as (select vault, state, day, r, greatest(0, evidence - completion) as f, greatest(0, evidence * slow_input - completion * slow_completion) as s from o where r = 1
 union all select o.vault, o.state, o.day, o.r, greatest(0, pow(o.decay, o.gap) * w.f + o.evidence - o.completion), greatest(0, pow(o.slow_decay, o.gap) * w.s + o.evidence * o.slow_input - o.completion * o.slow_completion)
 from w join o on o.vault = w.vault and o.state = w.state and o.r = w.r + 1),
t as (select w.vault, w.state, w.day, w.r, """ + _HITV + " / o.theta as ratio, o.evidence, o.completion, o.theta from w join o using (vault, state, r)),\n" + "nb(state, other, weight) as (values " + ", ".join(f"('{a}', '{b}', {w}::double)" for a, m in P.NEIGHBOURS.items() for b, w in m.items()) + """),
d as (select t.vault, t.state, t.day, any_value(t.r) as r, any_value(t.ratio) as ratio, any_value(t.evidence) as evidence, any_value(t.completion) as completion, any_value(t.theta) as theta,
 any_value(t.ratio) + 0.15::double * sum(nb.weight * x.ratio) / sum(nb.weight) as diffused from t join nb on nb.state = t.state join t x on x.vault = t.vault and x.day = t.day and x.state = nb.other group by t.vault, t.state, t.day),
p as (select vault, state, day, r, ratio, diffused, evidence, completion, theta, 0.0::double as predicted, diffused as error, 0.28::double * diffused as ema, case when diffused + 0.45::double * 0.28::double * diffused >= 0.55 then 1 else 0 end as streak from d where r = 1
 union all select vault, state, day, r, ratio, diffused, evidence, completion, theta, predicted, abs(diffused - predicted), 0.72::double * ema + 0.28::double * abs(diffused - predicted),
 case when diffused + 0.45::double * (0.72::double * ema + 0.28::double * abs(diffused - predicted)) >= 0.55 then streak + 1 else 0 end from (
 select d.*, p.ema, p.streak, least(greatest(p.diffused * 0.86::double + least(greatest(p.evidence / p.theta, 0), 1.5::double) * 0.16::double - least(greatest(p.completion / p.theta, 0), 1.5::double) * 0.12::double + p.ema * 0.28::double, 0), 2.5::double) as predicted
 from p join d on d.vault = p.vault and d.state = p.state and d.r = p.r + 1)),
q as (select *, diffused + 0.45::double * ema as effective, diffused + 0.45::double * ema >= 0.55 as micro, ratio >= 1 or (streak >= 3 and diffused + 0.45::double * ema >= 0.82) as macro from p),
cf(state, other, weight) as (values """ + ", ".join(f"('{a}', '{b}', {w}::double), ('{b}', '{a}', {w}::double)" for (a, b), w in P.CONFLICTS.items()) + """),
dayv as (select vault, day, avg(greatest(ratio, 0)) as g, avg(micro::int::double) as m from q group by 1, 2),
c as (select q.vault, q.day, q.state, sum(cf.weight * greatest(q.effective, 0) * greatest(x.effective, 0)) as conflict from q join cf on cf.state = q.state join q x on x.vault = q.vault and x.day = q.day and x.state = cf.other group by 1, 2, 3),
e as (select q.*, coalesce(conflict, 0) as conflict, g as global_voltage, m as micro_density, least(greatest((0.25::double - q.completion / q.theta) / 0.25::double, 0), 1) as low_completion from q join dayv using (vault, day) left join c using (vault, day, state)),
z as (select *, 0.55::double * ema + 0.85::double * conflict + 0.35::double * global_voltage + 0.45::double * low_completion + 0.25::double * micro_density as energy from e)
"""
_R = lambda *cs: ", ".join(f"round({c}, 6) as {c}" for c in cs)
_TARGET = r"trim(regexp_replace(link, '(?s)[#|^].*$', ''), ' ')"
_STEM = lambda x: rf"regexp_replace(regexp_replace({x}, '^.*/', ''), '(.)\.[^.]*$', '\1')"
_RESOLVE = f"""{NOTES}, l as (select path as source, unnest(links) as link from notes), wanted as (select distinct link, {_TARGET} as target from l where link is not null and {_TARGET} <> ''),
al as (select distinct path, len(string_split(path, '/')) as depth, unnest([{_STEM('path')}, regexp_replace(path, '^.*/', ''), regexp_replace(path, '\\.[^./]*$', '')]) as alias from (select distinct path from files)),
best as (select alias, first(path order by depth, path) as path from al group by 1),
res as (select w.link, coalesce(a.path, b.path) as path from wanted w left join best a on a.alias = w.target left join best b on b.alias = {_STEM('w.target')}),
ed as (select source, l.link, res.path as target from l join res using (link))"""
_KEY = r"lower(regexp_replace({0}, '\s+', '', 'g'))"
_NEIGH = f"""{NOTES}, n as (select *, {_KEY.format('title')} as key from notes), lk as (select distinct note_id, {_KEY.format(_STEM(_TARGET))} as key from (select note_id, unnest(links) as link from notes) where link is not null),
le as (select lk.note_id as src, n.note_id as dst from lk join n using (key) where lk.note_id <> n.note_id),
gr as (select distinct note_id, day, g from (select note_id, day, '#' || unnest(tags) as g from n union all select note_id, day, '/' || vault from n) where g is not null),
kp as (select * from gr qualify row_number() over (partition by g order by day desc, note_id desc) <= 25),
nbr as (select src, dst from le union select dst, src from le union select a.note_id, b.note_id from kp a join kp b using (g) where a.note_id <> b.note_id)"""


def _round_sql(prev: str, k: int) -> str:
    return f"""nr{k} as (select src as note_id, feature, sum(weight) as weight from nbr join {prev} v on v.note_id = nbr.dst group by 1, 2),
nu{k} as (select note_id, feature, weight / sqrt(sum(weight * weight) over (partition by note_id)) as weight from nr{k}),
mx{k} as (select note_id, feature, sum(weight) as weight from (select v.note_id, feature, case when exists (select 1 from nbr where src = v.note_id) then weight * 0.65::double else weight end as weight from {prev} v union all select note_id, feature, weight * 0.35::double from nu{k}) group by 1, 2),
v{k} as (select note_id, feature, weight / sqrt(sum(weight * weight) over (partition by note_id)) as weight from mx{k})"""


_TOPIC_TAGS = "list_distinct(list_concat(list_filter([" + ", ".join(f"case when {sql_any('lower(text)', ws)} then 'topic:{t}' end" for t, ws in V.FIELD_TOPICS.items()) + "], lambda x: x is not null), list_transform(coalesce(tags, []), lambda t: 'tag:' || t)))"
_DIFFUSE = f"with {_NEIGH}, v00 as (select note_id, unnest({_TOPIC_TAGS}) as feature, 1.0::double as weight from notes), v0 as (select note_id, feature, weight / sqrt(sum(weight * weight) over (partition by note_id)) as weight from v00 where feature is not null), {_round_sql('v0', 1)}, {_round_sql('v1', 2)} select note_id, feature, round(weight, 6) as weight from v2"
_SH = lambda c: _SHINGLES.replace("(text,", f"({c},")
_W = lambda toks, w, pre="": f"list_transform({toks}, lambda t: {{'feature': '{pre}' || lower(t), 'weight': {w}::double}})"


def _features_sql(src: str) -> str:
    topics = ", ".join(
        f"case when {sql_any('lower(text)', ws)} then list_concat([{{'feature': lower('topic:{t}'), 'weight': 3.0::double}}], {_W(f'list_filter({sql_list(ws)}, lambda w: length(w) >= 2 and contains(lower(text), lower(w)))', 1.4)}) else [] end" for t, ws in V.FIELD_TOPICS.items()
    )
    title = "coalesce(title, '')"
    return f"""select note_id, unnest(flatten([{_W("regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_\\-]+')", 1.0)}, {_W("regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')", 0.25, 'num:')}, {_W(_SHINGLES, 0.55)}, {topics}, {_W("coalesce(tags, [])", 2.0, 'tag:')},
{_W(f"regexp_extract_all({title}, '[A-Za-z][A-Za-z0-9_\\-]+')", 1.5, 'title:')}, {_W(_SH(title), 1.2, 'title:')}])) as x from {src}"""


def _vectors_sql(name: str, src: str) -> str:
    return f"{name}0 as (select note_id, x.feature as feature, sum(x.weight) as weight from ({_features_sql(src)}) group by 1, 2), {name} as (select note_id, feature, weight / sqrt(sum(weight * weight) over (partition by note_id)) as weight from {name}0)"


_FIELD = f"""with recursive {NOTES}, qs as (select 0 as note_id, '{QUERY}' as text, '{QUERY}' as title, []::varchar[] as tags), {_vectors_sql('vv', 'notes')}, {_vectors_sql('qv', 'qs')},
sim as (select vv.note_id, greatest(sum(vv.weight * qv.weight), 0) as similarity from vv join qv using (feature) group by 1),
sc as (select n.*, lower(text) as low, similarity, similarity * exp(-pow(1 - least(similarity, 1), 2) / (2 * 0.75::double * 0.75::double)) * exp(-pow(greatest(date_diff('day', day, date '2025-12-31'), 0), 2)::double / (2 * 365.0::double * 365.0::double)) as score from notes n join sim using (note_id) where similarity > 0),
h as (select *, list_filter([case when {sql_any('low', V.FIELD_ACTION)} then 'action' end, case when {sql_any('low', V.FIELD_BLOCKER)} then 'blocker' end, case when {sql_any('low', V.FIELD_COMPLETION)} then 'completion_signal' end, case when {sql_any('low', V.FIELD_NOVELTY)} then 'novelty' end,
 case when len(links) > 0 then 'wikilinked' end, case when len(tags) > 0 then 'tagged' end], lambda x: x is not null) as m from sc where score > 0.001),
hits as (select *, score * (1 + case when list_contains(m, 'action') then 0.2::double else 0 end + case when list_contains(m, 'blocker') then 0.3::double else 0 end + case when list_contains(m, 'novelty') then 0.25::double else 0 end) as current,
 case when list_contains(m, 'completion_signal') and not {sql_any('low', ['未完成', '没有完成', '还没', '尚未'])} then 0.45::double else 0 end as completion from h)"""

QUERIES = {
    "joi5_diffused_ratios": joi5_diffused_ratios, "lif11_prediction": lif11_prediction, "agg25_homeostasis": agg25_homeostasis, "joi6_meta_energy": joi6_meta_energy, "top5_meta_spikes": top5_meta_spikes,
    "joi2_resolved_links": joi2_resolved_links, "joi3_inbound": joi3_inbound, "agg9_degrees": agg9_degrees, "joi4_neighbourhood": joi4_neighbourhood, "lif14_diffusion": lif14_diffusion,
    "vec1_sparse": vec1_sparse, "vec2_field_hits": vec2_field_hits, "agg16_field_days": agg16_field_days, "agg17_field_energy": agg17_field_energy, "lif10_field_calendar": lif10_field_calendar,
    "lif14_diffused_vectors": lif14_diffused_vectors, "vec2_diffused_hits": vec2_diffused_hits, "agg16_diffused_days": agg16_diffused_days, "agg17_diffused_energy": agg17_diffused_energy, "lif10_diffused_calendar": lif10_diffused_calendar,
    "vec5_hashed": vec5_hashed, "vec6_dense_cosine": vec6_dense_cosine,
}
ORACLE = {
    "joi5_diffused_ratios": _TIME + f"select vault, state, day, {_R('ratio', 'diffused')} from d",
    "lif11_prediction": _TIME + f"select vault, state, day, {_R('predicted', 'error')}, round(ema, 6) as error_ema, {_R('effective')}, micro, macro, streak from q",
    "agg25_homeostasis": _TIME + "select vault, state, count_if(micro)::bigint as micro, count_if(macro)::bigint as macro, round(least(greatest(0.08::double * (avg(micro::int::double) - 0.35::double), 0.35::double - 0.55::double), 0.85::double - 0.55::double), 6) as threshold_delta, round(arg_max(ema, day), 6) as last_error from q group by 1, 2",
    "joi6_meta_energy": _TIME + f"select vault, state, day, {_R('conflict', 'global_voltage', 'micro_density', 'low_completion', 'energy')} from z",
    "top5_meta_spikes": _TIME + "select vault, state, day, round(energy, 6) as energy, z.energy >= 2.15::double as fired from z order by round(z.energy, 9) desc, round(conflict, 9) desc, round(ema, 9) desc, vault, day, state limit 5",
    "joi2_resolved_links": f"with {_RESOLVE} select link, path from res",
    "joi3_inbound": f"with {_RESOLVE} select target, count(distinct source)::bigint as inbound from ed where target is not null and source <> target group by 1",
    "agg9_degrees": f"""with {_RESOLVE}, ou as (select source as path, count(distinct case when target is not null then link end)::bigint as outbound, count(distinct case when target is null then link end)::bigint as unresolved from ed group by 1),
inn as (select target as path, count(distinct source)::bigint as inbound from ed where target is not null and source <> target group by 1)
select path, coalesce(outbound, 0) as outbound, coalesce(unresolved, 0) as unresolved, coalesce(inbound, 0) as inbound, coalesce(outbound, 0) + coalesce(inbound, 0) as bridge from ou full join inn using (path)""",
    "joi4_neighbourhood": f"with {_NEIGH} select src as note_id, count(*)::bigint as degree, round(count(*)::double / max(count(*)) over (), 6) as centrality from nbr group by 1",
    "lif14_diffusion": _DIFFUSE,
    "vec1_sparse": f"with {NOTES}, {_vectors_sql('vv', 'notes')} select note_id, count(*)::bigint as features, round(max(weight), 6) as greatest, round(sum(weight * (length(feature) + unicode(right(feature, 1)))), 4) as checksum from vv group by 1",
    "vec2_field_hits": _FIELD + " select note_id, round(similarity, 6) as similarity, round(score, 6) as score, array_to_string(m, '|') as modifiers from hits",
    "agg16_field_days": _FIELD + " select day, round(sum(current), 6) as current, round(sum(completion), 6) as completion from hits group by 1",
    "agg17_field_energy": _FIELD + " select round(sum(score), 6) as energy from (select score from hits order by score desc, note_id limit 12)",
    "lif10_field_calendar": _FIELD + """, dy as (select day, sum(current) as current, sum(completion) as completion from hits group by 1), gr as (select unnest(generate_series(min(day), max(day), interval 1 day))::date as day from dy),
gg as (select g.day, coalesce(current, 0) * 4 as x, coalesce(completion, 0) as c, row_number() over (order by g.day) as r from gr g left join dy on dy.day = g.day),
w as (select day, r, greatest(0, x - c) as f, greatest(0, x * 0.42::double - c * 0.3::double) as s from gg where r = 1
 union all select g.day, g.r, greatest(0, w.f * case when w.f * 0.65::double + w.s * 0.35::double >= 5 then 0.4::double else 1 end * 0.76::double + g.x - g.c), greatest(0, w.s * case when w.f * 0.65::double + w.s * 0.35::double >= 5 then 0.4::double else 1 end * 0.94::double + g.x * 0.42::double - g.c * 0.3::double)
 from w join gg g on g.r = w.r + 1)
select day, round(f, 5) as v_fast, round(s, 5) as v_slow, round(f * 0.65::double + s * 0.35::double, 5) as v, f * 0.65::double + s * 0.35::double >= 5 as fired from w""",
    "vec5_hashed": f"""with {NOTES}, h(term, hash, sgn) as (select term, list_reduce(list_transform(string_split(term, ''), lambda c: unicode(c)::bigint), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::bigint), list_reduce(list_transform(string_split(term || '#sign', ''), lambda c: unicode(c)::bigint), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::bigint)
 from (select distinct unnest(list_concat(regexp_extract_all(lower(text), '[a-z]{{3,}}'), {_SHINGLES})) as term from notes)),
t as (select note_id, term, count(*) as n from (select note_id, unnest(list_concat(regexp_extract_all(lower(text), '[a-z]{{3,}}'), {_SHINGLES})) as term from notes) group by 1, 2),
v as (select note_id, (hash % 96)::int as position, sum(case when sgn % 2 = 0 then 1 else -1 end * (1 + ln(1 + n))) as x from t join h using (term) group by 1, 2)
select note_id, position, round(x / (case when sum(x * x) over (partition by note_id) > 0 then sqrt(sum(x * x) over (partition by note_id)) else 1 end), 6) as value from v""",
    "vec6_dense_cosine": """with l as (select label, generate_subscripts(embedding, 1) as pos, unnest(embedding)::double as x from embeddings), c as (select label, pos, avg(x) as x from l group by 1, 2), ce as (select label as centre, list(x order by pos) as c from c group by 1),
s as (select vec_id, e.label, centre, round(list_cosine_similarity(embedding::double[], c), 6) as cosine from embeddings e, ce)
select vec_id, label, first(centre order by cosine desc, centre) as nearest, max(cosine) as cosine from s group by 1, 2""",
}
day_as_text(QUERIES, ORACLE, ["joi5_diffused_ratios", "lif11_prediction", "joi6_meta_energy", "top5_meta_spikes", "agg16_field_days", "lif10_field_calendar", "agg16_diffused_days", "lif10_diffused_calendar"])
