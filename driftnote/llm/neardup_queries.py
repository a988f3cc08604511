"""Queries of problem 2: near-duplicate snippets within notes and within evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import text_keys
from ..operators.components import components
from ..plans.orphan_queries import text_key_sql
from ..tables import spread, table
from .neardup import NearDuplicates

SOURCES = {"note_observations": "obs_id", "evidence_items": "item_id"}


def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, id, key; arrivals of one id have equal snippets, so they fall together as copies of one id."""
    parts = [spread(table(spark, sf_dir, name).select(key, "snippet").where("snippet is not null")).select(F.lit(name).alias("scope"), F.col(key).alias("id"), text_keys("snippet").alias("key")) for name, key in SOURCES.items()]
    return reduce(DataFrame.unionAll, parts)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(_snippets(spark, sf_dir)).all_pairs()


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, group_id, links: every record that has a near-duplicate or a copy, the least id of its group, and how many other texts it is linked to."""
    found = NearDuplicates(_snippets(spark, sf_dir))
    edges = found.pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = components(edges)
    links = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).groupBy("id").count().withColumnRenamed("count", "links")
    copies = found.members.select(F.col("representative").alias("id"), F.col("id").alias("record_id"))
    linked = groups.join(links, "id")
    every = linked.select(F.col("id").alias("record_id"), "id").unionAll(copies.select("record_id", "id")).distinct()
    return every.join(linked, "id", "left").select("record_id", F.coalesce("component", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
_KEYS = " union ".join(f"select '{name}' as scope, {key} as id, {text_key_sql('snippet')} as k from {name} where snippet is not null" for name, key in SOURCES.items())
#: the substrings of all snippets meet each other: for small tables only
_SIMILAR = f"""k as (select * from ({_KEYS}) where length(k) >= 20), g as (select distinct scope, id, substring(k, i, 3) as g from (select scope, id, k, unnest(range(1, length(k) - 1)) as i from k)), n as (select scope, id, count(*) as n from g group by 1, 2),
c as (select a.scope, a.id as x, b.id as y, count(*) as c from g a join g b on a.scope = b.scope and a.g = b.g and a.id < b.id group by 1, 2, 3),
s as (select x as id_a, y as id_b from c join n p on p.scope = c.scope and p.id = x join n q on q.scope = c.scope and q.id = y where c.c >= 0.65::double * (p.n + q.n - c.c))"""
ORACLE = {
    "p2_found": f"with {_SIMILAR} select id_a, id_b from s",
    # the least id of each text stands for it; groups are what the pairs connect, grown from every end until nothing is added
    "p2_groups": f"""with recursive {_SIMILAR}, rep as (select id, min(id) over (partition by scope, k) as rep from (select distinct scope, id, k from k)), two as (select id_a as a, id_b as b from s union all select id_b, id_a from s),
reach(id, other) as (select distinct a, a from two union select r.id, t.b from reach r join two t on t.a = r.other),
grp as (select id, min(other) as group_id from reach group by 1), lk as (select p.rep, count(distinct q.rep) as links from two join rep p on p.id = a join rep q on q.id = b where p.rep <> q.rep group by 1)
select grp.id as record_id, group_id, coalesce(links, 0)::bigint as links from grp join rep using (id) left join lk on lk.rep = rep.rep""",
}
