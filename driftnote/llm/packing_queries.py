"""Queries of problem 6: documents in containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import spread, table
from .packing import pack, token_pieces

CAPACITY = 2048


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, size, container, position, start, unused."""
    return pack(token_pieces(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", CAPACITY), CAPACITY).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, pieces, tokens, the room left over and the share filled."""
    rows = p6_packing(spark, sf_dir).where("container is not null")
    each = rows.groupBy("container").agg(F.count("*").alias("pieces"), F.sum("size").alias("tokens"))
    return each.agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.sum(CAPACITY - F.col("tokens")).alias("unused")).withColumn(
        "filled", F.try_divide(F.col("tokens"), F.col("containers") * CAPACITY)
    )


QUERIES = {"p6_packing": p6_packing, "p6_fill": p6_fill}
ORACLE: dict[str, str] = {}
