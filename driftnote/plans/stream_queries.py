"""Queries that run as streams to their end, and those over policies and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as L
from ..operators.policy import adjusted_threshold, closure_status, folded_feedback, label_effect, merged_policies, recalled, remembered
from ..sources.sinks import markdown, packets
from ..sources.vault import file_signals
from ..session import scratch_path
from ..streaming.stateful import event_sessions, event_windows, spiking_stream
from ..tables import once, table
from .common import day_as_text
from .evidence_queries import ORACLE as EVIDENCE_ORACLE
from .evidence_queries import _sums


PROJECTS = ["agent"]


def _drain(stream: DataFrame, path: str, mode: str) -> None:
    """Run a stream over all there is; each batch replaces (complete) or extends (append) the result."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()


def lif6_streamed_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recurrence with resets over two batches of days, state carried from one to the next: the same rows as in one batch."""
    daily = _sums(spark, sf_dir).select("vault", "state", "day", "evidence", "completion")
    source, out = scratch_path(spark, "daily"), scratch_path(spark, "streamed")
    middle = F.lit("2025-01-01").cast("date")
    daily.where(F.col("day") < middle).coalesce(1).write.parquet(f"{source}/a")
    daily.where(F.col("day") >= middle).coalesce(1).write.parquet(f"{source}/b")
    for part in ("a", "b"):  # one run a batch, as after a restart: state and offsets come from the checkpoint
        stream = spark.readStream.schema(daily.schema).parquet(f"{source}/{'{a}' if part == 'a' else '{a,b}'}")
        _drain(spiking_stream(stream, L.NEURONS), out, "append")
    return spark.read.parquet(out).select("vault", "state", "day", *[F.round(c, 6).alias(c) for c in ("v_fast", "v_slow", "v")], "fired")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def str1_event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, from a stream with a watermark."""
    out = scratch_path(spark, "windows")
    _drain(event_windows(_event_stream(spark, sf_dir)), out, "complete")
    return spark.read.parquet(out).select(F.col("start").cast("date").cast("string").alias("start"), "event_type", "events", F.round("mean", 6).alias("mean"))


def str2_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sessions of how many events each user has, as a batch: the same plan runs as a stream."""
    rows = event_sessions(table(spark, sf_dir, "events").where("user_id is not null"))
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


def src8_file_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "note_observations").select("day")
    return file_signals(table(spark, sf_dir, "files").select("path", "modified"), days, PROJECTS)


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels for topics: the hits' roles stand for them."""
    h = once(table(spark, sf_dir, "evidence_hits"), "hit_id")
    label = F.when(F.array_contains("roles", "completion"), "done").when(F.array_contains("roles", "blocker"), "too_late").when(F.array_contains("roles", "question"), "too_early").when(F.col("score") > 1.5, "useful").otherwise("seen")
    return h.select(F.col("hit_id").alias("seq"), F.explode("topics").alias("topic"), label.alias("label")).where("topic is not null")


def dec4_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels folded in order, by topic and week, which keeps each fold short."""
    days = once(table(spark, sf_dir, "evidence_hits"), "hit_id").select(F.col("hit_id").alias("seq"), F.date_format(F.trunc("day", "week"), "yyyy-MM-dd").alias("week"))
    rows = _feedback(spark, sf_dir).join(days, "seq").select("seq", F.concat_ws("@", "topic", "week").alias("topic"), "label")
    return folded_feedback(rows)


def agg6_merged_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policies that single labels make, merged by topic, and the threshold that comes of it."""
    e = label_effect(F.col("label"))
    rows = _feedback(spark, sf_dir).withColumn("e", e).select(
        "seq", "topic", F.coalesce("e.delta", F.lit(0.0)).alias("threshold_delta"), F.col("e.priority").alias("priority"), F.col("e.action").alias("action"), F.coalesce("e.mute", F.lit(False)).alias("muted"),
        F.coalesce("e.least", F.lit(0)).alias("cooldown_days"), F.lit(1).alias("feedback_count"),
    )
    m = merged_policies(rows)
    return m.withColumn("threshold", F.round(adjusted_threshold(F.lit(7.0), F.col("threshold_delta"), F.col("cooldown_days")), 6))


def _closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of topics as closed by what the hits say of them: the roles stand for the status, the score for the feedback."""
    h = once(table(spark, sf_dir, "evidence_hits"), "hit_id").select("hit_id", "day", "score", "roles", F.explode(F.array_distinct("topics")).alias("topic")).where("topic is not null")
    has = lambda r: F.array_contains("roles", r)
    status = F.when(has("completion"), "已完成").when(has("blocker"), "Downgraded").when(has("question"), "推迟").when(has("action"), "ignored").otherwise("open")
    feedback = F.when(F.col("score") > 1.5, "有用").when(F.col("score") < 0.5, "Too Late")
    return h.select(F.col("hit_id").alias("seq"), "topic", F.concat_ws("-", F.col("day").cast("string"), "topic").alias("spike_id"), closure_status(status, F.lit(False)).alias("status"), feedback.alias("feedback"), F.col("day").alias("closed_on"))


def agg28_feedback_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory of each topic: the record of its last closure and how many events it has."""
    m = remembered(_closures(spark, sf_dir), F.lit("2025-12-31").cast("date"))
    return m.select("topic", "status", "threshold_delta", "priority", "action", "muted", "cooldown_days", F.col("cooldown_until").cast("string").alias("cooldown_until"), F.size("spike_ids").alias("events"))


def src10_recalled_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the memory holds two days after each topic's last closure's cooldown began."""
    m = remembered(_closures(spark, sf_dir), F.lit("2025-12-31").cast("date"))
    return recalled(m, F.lit("2025-12-29").cast("date"))


def joi7_closed_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every topic and day that has hits, as an event, with the last closure of that event: a left join."""
    c = _closures(spark, sf_dir)
    spikes = c.select("spike_id", "topic").distinct()
    last = c.where("status <> 'open'").groupBy("spike_id").agg(F.max_by(F.struct("status", "feedback"), "seq").alias("c"))
    return spikes.join(last, "spike_id", "left").select("spike_id", "topic", F.coalesce("c.status", F.lit("open")).alias("status"), F.col("c.feedback").alias("feedback"))


def snk1_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "hub_notes").select("title", "path", F.col("created").cast("string").alias("created"))
    return packets(rows)


def snk5_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "hub_notes").select("title", "path")
    return markdown(rows, "Index notes", [F.col("title"), F.col("path")])


_FEED = "h as (select hit_id as seq, any_value(day) as day, any_value(topics) as topics, any_value(roles) as roles, any_value(score) as score from evidence_hits group by 1), f as (select seq, day, unnest(topics) as topic, case when list_contains(roles, 'completion') then 'done' when list_contains(roles, 'blocker') then 'too_late' when list_contains(roles, 'question') then 'too_early' when score > 1.5 then 'useful' else 'seen' end as label from h)"
# a late label of a closure lowers the threshold and asks for P1, a useful one lowers it
_CLOSED = """c as (select seq, topic, day as closed_on, day::varchar || '-' || topic as spike_id, case when list_contains(roles, 'completion') then 'done' when list_contains(roles, 'blocker') then 'downgraded' when list_contains(roles, 'question') then 'postponed' when list_contains(roles, 'action') then 'ignored' else 'open' end as status,
 case when score > 1.5 then '有用' when score < 0.5 then 'Too Late' end as feedback from (select hit_id as seq, day, roles, score, unnest(list_distinct(topics)) as topic from (select hit_id, any_value(day) as day, any_value(roles) as roles, any_value(score) as score, any_value(topics) as topics from evidence_hits group by 1)) where topic is not null),
p as (select *, case feedback when '有用' then -0.25::double when 'Too Late' then -0.75::double else 0 end + case status when 'done' then 0.5::double when 'downgraded' then 1.0::double when 'ignored' then 0.75::double else 0.25::double end as threshold_delta,
 case when status in ('downgraded', 'ignored') then 'P2' when feedback = 'Too Late' then 'P1' when status = 'done' then 'P2' end as priority, case status when 'downgraded' then 'downgrade' when 'postponed' then null else 'stop' end as action, false as muted,
 case status when 'done' then 2 when 'downgraded' then 7 when 'ignored' then 3 else 1 end as cooldown_days from c where status <> 'open'),
m as (select topic, first(status order by seq desc) as status, first(threshold_delta order by seq desc) as threshold_delta, first(priority order by seq desc) as priority, first(action order by seq desc) as action, false as muted, first(cooldown_days order by seq desc) as cooldown_days,
 first(closed_on + cooldown_days order by seq desc) as cooldown_until, count(distinct spike_id)::int as events from p group by 1)"""
QUERIES = {
    "lif6_streamed_spikes": lif6_streamed_spikes, "str1_event_days": str1_event_days, "str2_sessions": str2_sessions, "src8_file_signals": src8_file_signals, "dec4_feedback": dec4_feedback, "agg6_merged_policies": agg6_merged_policies,
    "agg28_feedback_memory": agg28_feedback_memory, "src10_recalled_policies": src10_recalled_policies, "joi7_closed_spikes": joi7_closed_spikes,
    "snk1_packets": snk1_packets, "snk5_markdown": snk5_markdown,
}
ORACLE = {
    "lif6_streamed_spikes": EVIDENCE_ORACLE["lif4_spikes"],
    "str1_event_days": "select strftime(ts, '%Y-%m-%d') as start, event_type, count(*)::bigint as events, round(avg(value), 6) as mean from events group by 1, 2",
    "str2_sessions": """with o as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minutes then 0 else 1 end as n from events where user_id is not null),
s as (select user_id, sum(n) over (partition by user_id order by ts, n desc rows unbounded preceding) as k from o), c as (select user_id, k, count(*) as events from s group by 1, 2) select user_id, count(*)::bigint as sessions, max(events)::bigint as longest from c group by 1""",
    "src8_file_signals": """with f as (select path, modified as day, lower(path) as p, regexp_extract(lower(path), '(\\.[^./]*)$', 1) as s from files),
c as (select *, case when s in ('.csv', '.xlsx', '.xls', '.png', '.jpg', '.jpeg', '.svg') and regexp_matches(p, '实验|数据|wave|figure|plot|result') then 'Experiment' when s in ('.docx', '.tex', '.md', '.pdf') and regexp_matches(p, '论文|thesis|章节|盲审') then 'Thesis'
 when s in ('.pdf', '.docx') and regexp_matches(p, '简历|resume|cv') then 'Career' when s in ('.py', '.md', '.json') and contains(p, 'agent') then 'AI_Memory' end as state from f)
select day, state, count(distinct path)::bigint as files from c where state is not null and day in (select day from note_observations) group by 1, 2""",
    "dec4_feedback": f"""with recursive {_FEED}, g as (select topic || '@' || strftime(date_trunc('week', day), '%Y-%m-%d') as topic, label, row_number() over (partition by topic || '@' || strftime(date_trunc('week', day), '%Y-%m-%d') order by seq, label) as r from f where topic is not null),
e as (select topic, r, case label when 'useful' then -0.25::double when 'too_early' then 0.75::double when 'too_late' then -0.75::double else 0 end as d, case label when 'too_early' then 2 when 'done' then 7 else 0 end as le, case when label in ('useful', 'too_late') then -1 else 0 end as st,
 case label when 'done' then 'P2' when 'too_late' then 'P1' end as pr, case label when 'done' then 'stop' end as ac from g),
w as (select topic, r, d as threshold_delta, greatest(greatest(0, st), le) as cooldown_days, pr as priority, ac as action from e where r = 1
 union all select e.topic, e.r, w.threshold_delta + e.d, greatest(greatest(w.cooldown_days + e.st, 0), e.le), coalesce(e.pr, w.priority), coalesce(e.ac, w.action) from w join e on e.topic = w.topic and e.r = w.r + 1)
select topic, threshold_delta, cooldown_days::int as cooldown_days, false as muted, priority, action, r::int as feedback_count from w qualify row_number() over (partition by topic order by r desc) = 1""",
    "agg6_merged_policies": f"""with {_FEED} select topic, sum(case label when 'useful' then -0.25::double when 'too_early' then 0.75::double when 'too_late' then -0.75::double else 0 end) as threshold_delta, arg_max(case label when 'done' then 'P2' when 'too_late' then 'P1' end, seq) filter (where label in ('done', 'too_late')) as priority,
arg_max('stop', seq) filter (where label = 'done') as action, false as muted, max(case label when 'done' then 7 when 'too_early' then 2 else 0 end)::int as cooldown_days, count(*)::bigint as feedback_count,
round(greatest(0.5::double, 7 + sum(case label when 'useful' then -0.25::double when 'too_early' then 0.75::double when 'too_late' then -0.75::double else 0 end) + 0.15::double * least(max(case label when 'done' then 7 when 'too_early' then 2 else 0 end), 7)), 6) as threshold from f where topic is not null group by 1""",
    "agg28_feedback_memory": f"with {_CLOSED} select topic, status, threshold_delta, priority, action, muted, cooldown_days, cooldown_until::varchar as cooldown_until, events from m",
    "src10_recalled_policies": f"""with {_CLOSED}, n as (select *, greatest(date_diff('day', date '2025-12-29', cooldown_until), 0)::int as lft from m)
select topic, case when status = 'downgraded' then greatest(threshold_delta, 1.0::double) when status = 'ignored' and lft > 0 then greatest(threshold_delta, 0.75::double) when status = 'done' and lft > 0 then greatest(threshold_delta, 0.5::double) else threshold_delta end as threshold_delta,
case when status = 'downgraded' or (status = 'ignored' and lft > 0) then 'P2' when status = 'done' and lft > 0 then coalesce(priority, 'P2') else priority end as priority,
case when status = 'downgraded' then 'downgrade' when status = 'ignored' and lft > 0 then 'stop' when status = 'done' and lft > 0 then coalesce(action, 'stop') else action end as action, muted, lft as cooldown_days, 1 as feedback_count from n""",
    "joi7_closed_spikes": f"""with {_CLOSED}, l as (select spike_id, first(status order by seq desc) as status, first(feedback order by seq desc) as feedback from c where status <> 'open' group by 1)
select s.spike_id, s.topic, coalesce(l.status, 'open') as status, l.feedback from (select distinct spike_id, topic from c) s left join l using (spike_id)""",
    "snk1_packets": "select to_json({'title': title, 'path': path, 'created': created::varchar})::varchar as packet from hub_notes",
    "snk5_markdown": "select (row_number() over (order by title, path) + 3)::int as line_no, '| ' || title || ' | ' || path || ' |' as line from hub_notes union all select 0, '# Index notes' union all select 1, '' union all select 2, '| title | path |' union all select 3, '| --- | --- |'",
}
day_as_text(QUERIES, {}, ["lif6_streamed_spikes"])
day_as_text(QUERIES, ORACLE, ["src8_file_signals"])
