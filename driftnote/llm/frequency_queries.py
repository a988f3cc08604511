"""Queries of problem 5: frequency of every term and keyword."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.orphan_queries import term_key_sql
from ..tables import table
from .frequency import term_frequencies

FIELDS = {"fragments.terms": ("fragments", "fragment_id", "terms"), "evidence_items.keywords": ("evidence_items", "item_id", "keywords")}


def p5_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, term, occurrences, records, n_records, mark of every distinct term."""
    parts = [
        term_frequencies(table(spark, sf_dir, name), key, terms, "ingested_at").select(F.lit(field).alias("field_name"), "term", "occurrences", "records", "n_records", "mark")
        for field, (name, key, terms) in FIELDS.items()
    ]
    return parts[0].unionAll(parts[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_frequencies(spark, sf_dir).where("mark is not null").select("field_name", "term", "mark")


_ALL = " union all ".join(
    f"""select '{field}' as field_name, k as term, count(*)::bigint as occurrences, count(distinct id)::bigint as records, (select count(distinct {key}) from {name})::bigint as n_records
from (select id, {term_key_sql('t')} as k from (select id, unnest(v) as t from (select {key} as id, any_value({terms}) as v from {name} group by {key}))) where k is not null group by k"""
    for field, (name, key, terms) in FIELDS.items()
)
_MARKED = f"select *, case when records < 3 then 'rare' when records * 20 >= n_records then 'common' end as mark from ({_ALL})"

QUERIES = {"p5_found": p5_found, "p5_frequencies": p5_frequencies}
ORACLE = {"p5_found": f"select field_name, term, mark from ({_MARKED}) where mark is not null", "p5_frequencies": _MARKED}
