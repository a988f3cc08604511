"""What several query modules share: the notes of the vault, and lexicons as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import once, table


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``notes``, with the few notes that arrived twice: for queries that reduce a text before they take each note once, so that no text is shuffled."""
    rows = table(spark, sf_dir, "note_observations").where("text is not null")
    return rows.select(F.col("obs_id").alias("note_id"), F.split("rel_path", "/")[0].alias("vault"), "day", F.col("rel_path").alias("path"), "title", "text", "tags", "links")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id, vault (the first folder), day, path, title, text, tags, links: each note once."""
    return once(arrivals(spark, sf_dir), "note_id")


NOTES = """notes as (select obs_id as note_id, string_split(any_value(rel_path), '/')[1] as vault, any_value(day) as day, any_value(rel_path) as path, any_value(title) as title,
  any_value(text) as text, any_value(tags) as tags, any_value(links) as links from note_observations where text is not null group by obs_id)"""


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_matched(lowered: str, words: list[str]) -> str:
    return f"list_filter({sql_list(list(dict.fromkeys(words)))}, lambda w: contains({lowered}, lower(w)))"


def sql_any(lowered: str, words: list[str]) -> str:
    return f"(len({sql_matched(lowered, words)}) > 0)"


def day_as_text(queries: dict, oracle: dict, names: list[str]) -> None:
    """Give the ``day`` of these queries and of their SQL twins as text: engines differ in how they hand out dates."""

    def wrapped(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(spark, sf_dir).withColumn("day", F.col("day").cast("string"))

        run.__name__, run.__doc__ = query.__name__, query.__doc__
        return run

    for name in names:
        queries[name] = wrapped(queries[name])
        if name in oracle:
            oracle[name] = f"select * replace (day::varchar as day) from ({oracle[name]})"
