"""Queries of problem 3: links to notes that don't exist on their record's day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import link_keys, title_key
from ..operators.orphans import orphan_references
from ..session import cut
from ..tables import table

SOURCES = {"note_observations": ("obs_id", "links"), "evidence_hits": ("hit_id", "outgoing_links")}


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record and link key: source_table, source_id, day, target_key. Arrivals of one id count once."""
    parts = []
    for name, (key, links) in SOURCES.items():
        rows = table(spark, sf_dir, name).where(f"size({links}) > 0").select(F.lit(name).alias("source_table"), F.col(key).alias("source_id"), "day", links)
        parts.append(rows.select("source_table", "source_id", "day", F.explode(link_keys(links)).alias("target_key")))
    return cut(parts[0].unionAll(parts[1]).distinct(), "references")  # keyed once: they are read to be checked and to get the verdict back


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time in which a title names an existing note."""
    both = [table(spark, sf_dir, t).select("title", "created", "removed_on") for t in ("files", "hub_notes")]
    return both[0].unionAll(both[1]).select(title_key("title").alias("target_key"), "created", "removed_on").where("target_key is not null and created is not null")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(references(spark, sf_dir), notes(spark, sf_dir), ["target_key"], match="partial", at="day", since="created", until="removed_on")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("source_table", "source_id", "target_key")


def p3_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per table and month: the records and the keys concerned, and the orphan references."""
    return (
        _orphans(spark, sf_dir)
        .groupBy("source_table", F.date_format("day", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("orphans"), F.countDistinct("source_id").alias("records"), F.countDistinct("target_key").alias("keys"))
    )



# DuckDB has no NFKC: nfc_normalize plus a full-width fold covers what links and titles are written with
_FOLD = "translate(nfc_normalize({0}), '" + "".join(chr(c) for c in range(0xFF01, 0xFF5F) if c != 0xFF07) + "　', '" + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F) if c != 0xFF07) + " ')"
_TERM = "nullif(regexp_replace(lower({0}), '[\\s\\p{Z}\\p{Cf}]', '', 'g'), '')"


def term_key_sql(expr: str) -> str:
    return _TERM.replace("{0}", _FOLD.replace("{0}", expr))


def text_key_sql(expr: str) -> str:
    return r"regexp_replace(lower({0}), '[^\p{L}\p{N}]', '', 'g')".replace("{0}", _FOLD.replace("{0}", expr))


def link_key_sql(expr: str) -> str:
    cut = f"trim(regexp_replace({expr}, '[#|^](.|\\n)*$', ''), ' \t\r\n　 ')"
    tail = f"regexp_replace(regexp_replace({cut}, '^(.|\\n)*/', ''), '\\.[mM][dD]$', '')"
    return f"case when {expr} is null or contains({expr}, '://') then null else {term_key_sql(tail)} end"


_REFS_SQL = " union ".join(
    f"select distinct '{name}' as source_table, {key} as source_id, day, {link_key_sql('l')} as target_key from (select {key}, day, unnest({links}) as l from {name})"
    for name, (key, links) in SOURCES.items()
)
_ORPHANS_SQL = f"""with refs as ({_REFS_SQL}),
notes as (select {term_key_sql('title')} as k, created, removed_on from (select title, created, removed_on from files union all select title, created, removed_on from hub_notes)),
orphans as (select * from refs r where target_key is not null and not exists
  (select 1 from notes n where n.k = r.target_key and n.created <= r.day and (n.removed_on is null or n.removed_on > r.day)))
"""

def p3_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by a key of two columns that is null in part: documents (title, day) against the notes of that title and day. A document without a title is met by any note of its day, one
    without either by anything."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "title", "day")
    parents = table(spark, sf_dir, "note_observations").select(F.col("title").alias("note_title"), F.col("day").alias("note_day"))
    return orphan_references(docs, parents, ["title", "day"], ["note_title", "note_day"], match="partial").select("doc_id", "title")


QUERIES = {"p3_found": p3_found, "p3_by_month": p3_by_month, "p3_composite": p3_composite}
ORACLE = {
    "p3_found": _ORPHANS_SQL + "select source_table, source_id, target_key from orphans",
    "p3_composite": "select doc_id, title from documents d where not (title is null and day is null) and not exists (select 1 from note_observations n where (d.title is null or n.title = d.title) and (d.day is null or n.day = d.day))",
    "p3_by_month": _ORPHANS_SQL
    + "select source_table, strftime(day, '%Y-%m') as month, count(*) as orphans, count(distinct source_id) as records, count(distinct target_key) as keys from orphans group by all",
}
