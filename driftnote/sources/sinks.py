"""Writing packets, reports and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import file_system


def packets(rows: DataFrame) -> DataFrame:
    """Each row as a JSON object in the column ``packet``; null fields are left out."""
    return rows.select(F.to_json(F.struct("*")).alias("packet"))


def write_packets(rows: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as there are partitions."""
    packets(rows).write.mode("overwrite").text(path)


def cell(value: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.regexp_replace(value.cast("string"), r"\s+", " "), r"\|", "\\\\|"), F.lit(""))


def markdown(rows: DataFrame, title: str, order: list[Column]) -> DataFrame:
    """line_no, line of a Markdown table of a report's rows: a title, a head, and a line a row in the given order."""
    from pyspark.sql import Window

    body = rows.select(F.row_number().over(Window.orderBy(*order)).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(f"`{c}`")) for c in rows.columns]), F.lit(" |")).alias("line"))
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    top = rows.sparkSession.createDataFrame(list(enumerate(head)), "line_no int, line string")
    return top.unionAll(body.select((F.col("n") + len(head) - 1).cast("int"), "line"))


def write_markdown(rows: DataFrame, title: str, order: list[Column], path: str) -> None:
    markdown(rows, title, order).orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)


def save_state(state: DataFrame, path: str) -> None:
    """A table of states, whole, for the next run. The table read may not be the one written: give each run its own path."""
    state.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that ``save_state`` wrote; None where there is none."""
    fs, p = file_system(spark, path)
    return spark.read.parquet(path) if fs.exists(p) else None
