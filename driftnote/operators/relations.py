"""Concepts and relations from what occurs together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L

RELATIONS = ["blocker", "action", "question", "completion"]
RELATION_NAMES = {"blocker": "blocks", "action": "suggests_action_for", "question": "questions", "completion": "partly_closes"}


def concept_scores(terms: DataFrame, least: int = 3) -> DataFrame:
    """term, count, days, score of (fragment, day, term): count * (1 + ln(1 + days)) * (0.7 + min(length, 8) / 8), of terms in at least ``least`` fragments."""
    c = terms.distinct().groupBy("term").agg(F.count("*").alias("count"), F.countDistinct("day").alias("days")).where(F.col("count") >= least)
    return c.withColumn("score", F.col("count") * (1 + F.log1p("days")) * (0.7 + F.least(F.length("term"), F.lit(8)) / 8))


def selected_concepts(scored: DataFrame, top: int = 32, pool: int = 2000) -> list[str]:
    """The ``top`` concepts taken greedily by score: a term is passed over if it lies within a taken one, or holds a taken one that is at least as frequent.

    The greedy choice is on the driver, over ``pool`` ranked concepts at a time. If they don't fill the list, the next by rank follow, without those that a taken one
    rules out, until it is full or the table ends.
    """
    taken: list[tuple[str, int]] = []
    rest = scored.select("term", "count", F.round("score", 9).alias("rank"))
    while True:
        rows = rest.orderBy(F.col("rank").desc(), F.col("term").desc()).limit(pool).collect()
        for r in rows:
            if any(r["term"] in t and len(r["term"]) < len(t) for t, _ in taken) or any(t in r["term"] and n >= r["count"] for t, n in taken):
                continue
            taken.append((r["term"], r["count"]))
            if len(taken) >= top:
                break
        if len(taken) >= top or len(rows) < pool:
            return [t for t, _ in taken]
        rank, term = rows[-1]["rank"], rows[-1]["term"]
        rest = scored.select("term", "count", F.round("score", 9).alias("rank")).where((F.col("rank") < rank) | ((F.col("rank") == rank) & (F.col("term") < term)))
        for t, n in taken:
            rest = rest.where(~(F.contains(F.lit(t), "term") & (F.length("term") < len(t))) & ~(F.contains("term", F.lit(t)) & (F.col("count") <= n)))


def relation_scores(pairs: DataFrame) -> DataFrame:
    """score of pairs (count, distinct_days, n_a, n_b): count * (1 + ln(1 + days)) * (1 + 10 / sqrt(n_a * n_b))."""
    return pairs.withColumn("score", F.col("count") * (1 + F.log1p("distinct_days")) * (1 + 10 / F.sqrt(F.greatest(F.col("n_a").cast("double") * F.col("n_b"), F.lit(1.0)))))


def relation_of(roles: Column) -> Column:
    """What a hit's roles make of the topics that it joins."""
    return F.coalesce(*[F.when(F.array_contains(roles, r), F.lit(RELATION_NAMES[r])) for r in RELATIONS], F.lit("supports"))


def topic_edges(hits: DataFrame) -> DataFrame:
    """source, target, relation, weight, paths: the topics of each hit (topics, roles, score, path) paired in their order, by two nested explodes."""
    rows = hits.where(F.size("topics") >= 2).select("path", "score", relation_of(F.coalesce("roles", F.array().cast("array<string>"))).alias("relation"), "topics", F.posexplode("topics").alias("at", "source"))
    rows = rows.select("path", "score", "relation", "source", F.explode(F.expr("slice(topics, at + 2, size(topics))")).alias("target"))
    return rows.groupBy("source", "target", "relation").agg(F.sum(F.greatest("score", F.lit(0.2))).alias("weight"), F.countDistinct("path").alias("paths"))


def topic_nodes(hits: DataFrame, keys: list[str], threshold: float = 3.0, preferred: list[str] | None = None) -> DataFrame:
    """keys, topic, voltage, evidence, dominant_role, threshold, spike. The commonest role of a topic, the first by name on a tie, lowers its threshold if it blocks."""
    each = hits.select(*keys, F.explode("topics").alias("topic"), "roles", "score")
    sums = each.groupBy(*keys, "topic").agg(F.sum("score").alias("voltage"), F.count("*").alias("evidence"))
    roles = each.select(*keys, "topic", F.explode("roles").alias("role")).groupBy(*keys, "topic", "role").count()
    w = Window.partitionBy(*keys, "topic").orderBy(F.col("count").desc(), "role")
    first = roles.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*keys, "topic", "role")
    rows = sums.join(first, [*keys, "topic"], "left").withColumn("dominant_role", F.coalesce("role", F.lit("evidence"))).drop("role")
    level = F.lit(threshold) * F.when(F.col("topic").isin(preferred or [""]), 0.92).otherwise(1.0) * F.when(F.col("dominant_role") == "blocker", 0.88).otherwise(1.0)
    return rows.withColumn("threshold", level).withColumn("spike", F.col("voltage") >= F.col("threshold"))


def rule_scores(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """name, coverage, bridges, score of each rule (name, topics, required, boost) over all hits.

    Hits meet rules on their topics, exploded: an equi-join with a table of rules of fixed size; per rule only sums come out.
    """
    wanted = rules.select("name", F.size("topics").alias("n_topics"), "required", "boost", F.explode("topics").alias("topic"))
    met = hits.select("hit_id", "score", F.coalesce("roles", F.array().cast("array<string>")).alias("roles"), F.explode("topics").alias("topic")).distinct().join(F.broadcast(wanted), "topic")
    per_hit = met.groupBy("name", "n_topics", "required", "boost", "hit_id", "roles").agg(F.count("*").alias("overlap"), F.collect_set("topic").alias("covered"))
    s = per_hit.groupBy("name", "n_topics", "required", "boost").agg(
        F.count_if(F.col("overlap") >= 2).alias("bridges"), F.array_distinct(F.flatten(F.collect_set("covered"))).alias("covered"), F.array_distinct(F.flatten(F.collect_set("roles"))).alias("roles")
    )
    has = lambda r: F.array_contains("roles", r)
    extra = F.when(has("conflict") & has("decision"), 0.65).otherwise(0.0) + F.when(has("failure") & has("claim"), 0.55).otherwise(0.0) + F.when(has("metric") & has("claim"), 0.45).otherwise(0.0)
    coverage = F.size("covered") / F.col("n_topics")
    score = coverage * 4.0 + F.least("bridges", F.lit(4)) * 0.65 + F.size(F.array_intersect("required", "roles")) * 0.85 + F.size(F.array_intersect("boost", "roles")) * 0.35 + extra
    return s.select("name", coverage.alias("coverage"), "bridges", score.alias("score"))


def rule_evidence(evidence: DataFrame, rules: list[tuple[str, list[str], list[str], list[str]]], top: int, order: list[str]) -> DataFrame:
    """The ``top`` evidence (topics, roles, score, day, snippet) of each rule (name, topics, required, boost): by score, topics and roles in common and day, a snippet once; place is by day.

    Rules are a literal of fixed size, so evidence meets them in a projection; ranks are kept to ``top`` before anything is shuffled.
    """
    words = lambda ws: F.array(*map(F.lit, ws)) if ws else F.expr("cast(array() as array<string>)")
    each = F.array(*[F.struct(F.lit(n).alias("name"), words(t).alias("wanted"), words(q + [x for x in b if x not in q]).alias("liked")) for n, t, q, b in rules])
    rows = evidence.withColumn("r", F.explode(each)).where(F.arrays_overlap("topics", "r.wanted"))
    rows = rows.withColumn("name", F.col("r.name")).withColumn("overlap", F.size(F.array_intersect("topics", "r.wanted"))).withColumn("roles_met", F.size(F.array_intersect("roles", "r.liked"))).drop("r")
    best = [F.round("score", 9).desc(), F.col("overlap").desc(), F.col("roles_met").desc(), F.col("day").desc(), *order]
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("name", "snippet").orderBy(*best))).where("rn = 1")
    kept = first.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(*best))).where(F.col("rank") <= top)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("day", "rank"))).drop("rn")


def checked_relations(relations: DataFrame, least: float = 0.0, confirmed: str | None = None) -> DataFrame:
    """The relations (relation_type, score, ...) with type (in one spelling), confidence and reason: why one is passed over, null where it is kept."""
    kind = F.regexp_replace(F.lower(F.trim(F.coalesce("relation_type", F.lit("unknown")))), "[ -]", "_")
    alias = F.create_map(*[F.lit(x) for kv in L.RELATION_TYPES.items() for x in kv])
    kind = F.when(kind == "", "unknown").otherwise(F.coalesce(F.try_element_at(alias, kind), kind))
    sure = F.when(F.col("score").isNull(), 1.0).when(F.col("score") > 1, F.least(F.col("score") / 10, F.lit(1.0))).otherwise(F.greatest("score", F.lit(0.0)))
    reason = F.when(F.col("type") == "unknown", "unknown relation_type").when(F.col("confidence") < least, "confidence")
    if confirmed:
        reason = reason.when(~F.coalesce(F.col(confirmed), F.lit(False)), "not confirmed")
    return relations.withColumn("type", kind).withColumn("confidence", sure).withColumn("reason", reason)


def policy_drafts(relations: DataFrame) -> DataFrame:
    """One draft a topic from kept relations (seq, source, target, type, hypothesis): deltas add up, the longest cooldown, the strongest priority and action hold; the first eight
    different reasons. Deltas are kept within 2 either way, cooldowns within 30 days."""
    effect = lambda es: F.array(*[F.struct(F.lit(side).alias("side"), F.lit(d).alias("delta"), F.lit(p).alias("priority"), F.lit(L.ACTIONS.index(a)).alias("action"), F.lit(c).alias("cooldown")) for side, d, p, a, c in es])
    table = F.create_map(*[x for k, es in L.RELATION_EFFECTS.items() for x in (F.lit(k), effect(es))])
    named = relations.select("seq", "type", F.trim("source").alias("source"), F.trim("target").alias("target"), "hypothesis").where("source <> '' and target <> ''")
    rows = named.withColumn("e", F.explode(F.coalesce(F.try_element_at(table, F.col("type")), table[F.lit("")])))
    name = F.concat("source", F.lit(" -["), "type", F.lit("]-> "), "target")
    rows = rows.select("seq", F.when(F.col("e.side") == "source", F.col("source")).otherwise(F.col("target")).alias("topic"), "e.*", F.coalesce(F.nullif(F.trim("hypothesis"), F.lit("")), name).alias("reason"))
    sums = rows.groupBy("topic").agg(F.round(F.sum("delta"), 6).alias("delta"), F.min("priority").alias("priority"), F.max("action").alias("action"), F.max("cooldown").alias("cooldown"), F.count("*").alias("relations"))
    # a topic may have any number of relations: reasons are ranked before they are put together
    first = rows.groupBy("topic", "reason").agg(F.min("seq").alias("seq")).withColumn("rn", F.row_number().over(Window.partitionBy("topic").orderBy("seq", "reason"))).where("rn <= 8")
    reasons = first.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "reason"))), lambda x: x["reason"]).alias("reasons"))
    names = F.array(*map(F.lit, L.ACTIONS))
    return sums.join(reasons, "topic").select(
        "topic", F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("delta"))).alias("threshold_delta"), "priority", names[F.col("action")].alias("action"), F.least("cooldown", F.lit(30)).alias("cooldown_days"), "relations", "reasons",
        F.col("delta").alias("unclamped"),
    )
