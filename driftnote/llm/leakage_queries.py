"""Queries of problem 7: evaluation items in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.orphan_queries import text_key_sql
from ..tables import spread, table
from .leakage import leaked_passages


def _items(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    """The held-out items: a fixed table of 240 rows; the operator checks its size."""
    return [(r[0], r[1]) for r in table(spark, sf_dir, "eval_items").select("item_id", "text").orderBy("item_id").toLocalIterator()]


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, where the passage lies, its edits and the longest exact run."""
    return leaked_passages(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", _items(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_passages(spark, sf_dir).where(F.col("exact_run") >= 40).select("doc_id", "item_id")


def p7_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leaked item the documents that hold a passage of it, and how many hold one unchanged."""
    return p7_passages(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.count_if(F.col("exact_run") >= 40).alias("exact"), F.max("exact_run").alias("longest_run"))


QUERIES = {"p7_found": p7_found, "p7_passages": p7_passages, "p7_by_item": p7_by_item}
_GRAMS = "select {0}, substring(k, i, 40) as g from (select {0}, k, unnest(range(1, length(k) - 38)) as i from (select {0}, {1} as k from {2}) where length(k) >= 40)"
ORACLE = {
    "p7_found": f"with e as (select distinct item_id, g from ({_GRAMS.format('item_id', text_key_sql('text'), 'eval_items')})), d as ({_GRAMS.format('doc_id', text_key_sql('text'), 'documents')}) select distinct doc_id, item_id from d join e using (g)",
}
