"""Reading JSON packets whose shape isn't fixed, and Markdown sections of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: where lists of records are kept
KEYS = ["feedback", "items", "lif_spikes", "spikes", "tasks", "tensions", "claims", "nodes", "observations", "frontier", "relations"]


def read_packets(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """source, position, item (variant): the records of JSON files that hold a list, or an object with lists under any of ``keys``. Broken files give none."""
    docs = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v")).where("v is not null")
    lists = [F.struct(F.lit("").alias("source"), F.expr("try_cast(v as array<variant>)").alias("items"))]
    lists += [F.struct(F.lit(k).alias("source"), F.try_variant_get("v", f"$.{k}", "array<variant>").alias("items")) for k in keys or KEYS]
    rows = docs.select(F.explode(F.array(*lists)).alias("l")).where("l.items is not null")
    return rows.select("l.source", F.posexplode("l.items").alias("position", "item"))


def fields(packets: DataFrame, names: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Columns of a packet: for each name a type and the keys that it may stand under, the first that is there."""
    cols = [F.coalesce(*[F.try_variant_get("item", f"$.{k}", kind) for k in keys]).alias(name) for name, (kind, keys) in names.items()]
    return packets.select("source", "position", *cols)


def first_of_each(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key: the first by (source, position)."""
    one = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct("source", "position")).alias("r"))
    return one.select("r.*")


def checked_records(lines: DataFrame) -> DataFrame:
    """record, checked, title and the fields of records in lines (line_no, line): a checkbox line opens a record, ``key: value`` lines fill it.

    A record's number is the running count of checkbox lines, so the lines are one ordered stream: those of a report.
    """
    from pyspark.sql import Window

    opens = F.rlike("line", F.lit(r"^\s*- \[[ xX]\]"))
    w = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("record", F.sum(opens.cast("int")).over(w)).where("record > 0")
    parts = rows.select(
        "record",
        F.when(opens, F.rlike("line", F.lit(r"\[[xX]\]"))).alias("checked"),
        F.when(opens, F.trim(F.regexp_replace("line", r"^\s*- \[[ xX]\]\s*", ""))).alias("title"),
        F.when(~opens, F.trim(F.regexp_extract("line", r"^\s*[-*]?\s*([^:：]+)[:：]", 1))).alias("key"),
        F.when(~opens, F.trim(F.regexp_extract("line", r"^[^:：]+[:：](.*)$", 1))).alias("value"),
    )
    pairs = F.map_from_entries(F.collect_list(F.when(F.col("key") != "", F.struct("key", "value"))))
    return parts.groupBy("record").agg(F.max("checked").alias("checked"), F.max("title").alias("title"), pairs.alias("fields"))
