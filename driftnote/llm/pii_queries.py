"""Queries of problem 4: personal information in notes and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import latest, spread, table
from .pii import find_personal, redact_personal

MOST_PARTS = 5000
FIELDS = {"note_observations": ("obs_id", "text"), "evidence_items": ("item_id", "snippet")}


def _parts(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, str]]:
    """name_parts is a fixed table of 54 rows; a pattern of more than some thousands would want another generator."""
    rows = table(spark, sf_dir, "name_parts").where("name_part is not null").select("name_part", "part_kind", "script").limit(MOST_PARTS + 1).collect()
    if len(rows) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} name parts")
    return [tuple(r) for r in rows]


def p4_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_table, source_id, kind, occurrence, start, length of every find; arrivals of one id are equal and count once."""
    parts = _parts(spark, sf_dir)
    found = [find_personal(spread(table(spark, sf_dir, name).select(key, text)), key, text, parts).select(F.lit(name).alias("source_table"), F.col("id").alias("source_id"), "kind", "occurrence", "start", "length") for name, (key, text) in FIELDS.items()]
    return found[0].unionAll(found[1]).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_spans(spark, sf_dir).select("source_table", "source_id", "kind", "occurrence")


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_table, source_id and the text with placeholders, for every record with a text."""
    parts = _parts(spark, sf_dir)
    out = []
    for name, (key, text) in FIELDS.items():
        rows = latest(table(spark, sf_dir, name).select(key, text, "ingested_at"), key, "ingested_at").where(F.col(text).isNotNull())
        out.append(redact_personal(rows, key, text, parts).select(F.lit(name).alias("source_table"), F.col("id").alias("source_id"), "redacted"))
    return out[0].unionAll(out[1])


QUERIES = {"p4_found": p4_found, "p4_spans": p4_spans, "p4_redacted": p4_redacted}
ORACLE: dict[str, str] = {}
