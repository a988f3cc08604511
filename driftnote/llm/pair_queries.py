"""Queries of problem 1: pairs of terms in fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.orphan_queries import term_key_sql
from ..session import scratch_path
from ..tables import table
from .pair_table import PairTable


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fragments").select("fragment_id", "day", "terms", "ingested_at")


def _pairs(spark: SparkSession, sf_dir: str) -> PairTable:
    pairs = PairTable(spark, scratch_path(spark, "pairs"))
    pairs.apply(_fragments(spark, sf_dir), "fragment_id", "day", "terms")
    return pairs


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = "count >= 5 and distinct_days >= 3 and count * n_records >= 12 * n_a * n_b"
    return _pairs(spark, sf_dir).scores().where(case).select("term_a", "term_b")


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with its counts and its lift."""
    return _pairs(spark, sf_dir).scores()


def p1_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table built in two batches: what arrived before July 2025, then the rest, arrivals of known ids included."""
    rows = _fragments(spark, sf_dir)
    late = F.col("ingested_at") >= F.lit("2025-07-01").cast("timestamp_ntz")
    pairs = PairTable(spark, scratch_path(spark, "pairs"))
    for part in (rows.where(~late), rows.where(late)):
        pairs.apply(part, "fragment_id", "day", "terms")
    return pairs.scores()


def p1_revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after a second batch that revises baskets: fragments with numbers hold these as terms too, those of the last quarter of 2025 are withdrawn (no terms any more)."""
    rows = table(spark, sf_dir, "fragments").select("fragment_id", "day", "terms", "numbers")
    pairs = PairTable(spark, scratch_path(spark, "pairs"))
    pairs.apply(rows, "fragment_id", "day", "terms")
    none = F.array().cast("array<string>")
    late = F.col("day") >= F.lit("2025-10-01").cast("date")
    terms = F.when(late, none).otherwise(F.concat(F.coalesce("terms", none), F.coalesce("numbers", none)))
    pairs.apply(rows.where(late | (F.size("numbers") > 0)).withColumn("terms", terms), "fragment_id", "day", "terms")
    return pairs.scores()


_FRAGMENTS = "f as (select fragment_id, any_value(day) as day, any_value(terms) as terms from fragments group by 1)"
_REVISED = "f0 as (select fragment_id, any_value(day) as day, any_value(terms) as terms, any_value(numbers) as numbers from fragments group by 1), f as (select fragment_id, day, case when day >= date '2025-10-01' then [] when len(numbers) > 0 then list_concat(coalesce(terms, []), numbers) else terms end as terms from f0)"
_PAIRS = f"""with {_FRAGMENTS},
k as (select distinct fragment_id, day, {term_key_sql('t')} as k from (select fragment_id, day, unnest(terms) as t from f)),
n as (select k, count(*)::bigint as n from k where k is not null group by 1),
p as (select a.k as term_a, b.k as term_b, count(*)::bigint as count, count(distinct a.day)::bigint as distinct_days
  from k a join k b on a.fragment_id = b.fragment_id and a.k < b.k group by 1, 2),
s as (select term_a, term_b, count, distinct_days, x.n as n_a, y.n as n_b, (select count(*) from f)::bigint as n_records
  from p join n x on x.k = term_a join n y on y.k = term_b)
"""
_SCORES = _PAIRS + "select *, count * n_records::double / (n_a::double * n_b) as lift from s"

QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p1_incremental": p1_incremental, "p1_revised": p1_revised}
ORACLE = {
    "p1_found": _PAIRS + "select term_a, term_b from s where count >= 5 and distinct_days >= 3 and count * n_records >= 12 * n_a * n_b",
    "p1_pairs": _SCORES,
    "p1_incremental": _SCORES,
    "p1_revised": _SCORES.replace(_FRAGMENTS, _REVISED),
}
